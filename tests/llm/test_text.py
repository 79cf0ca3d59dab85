"""Tokens, packing, languages, secrets, media, rollups and WARC against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import bpe, language_id, media, packing, secret_scan, token_counts, warc
from lexmill.llm.common import scratch_path
from lexmill.llm.tokens import BYTE_BPE, byte_bpe, encode, tokenizer_path

from .conftest import DOCS, corpus

BYTES = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
WORDS = Tokenizer.from_file(tokenizer_path(bpe.WORD_BPE))
MINE = bpe.word_bpe(tokenizer_path(bpe.WORD_BPE))
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abethin é'<|>/w\n 0")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_ids_are_the_librarys(text):
    assert encode(byte_bpe(tokenizer_path(BYTE_BPE)), text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [*(c * 5_000_000 + end for c in " \n\t\u3000" for end in ("", "x")), "q" * 1_000_000, "a  " + "\r\n" * 400_000 + "<|endoftext|>"], ids=range(10))
def test_long_runs_have_the_librarys_byte_ids(text):
    assert np.array_equal(encode(byte_bpe(tokenizer_path(BYTE_BPE)), text), BYTES.encode(text, add_special_tokens=False).ids)


def test_long_runs_pass_through_packing_and_counts(spark):
    rows = [(1, " " * 1_000_000 + "x", "en", "s", 1), (2, "\n" * 900_000, "en", "s", 1), (3, "word " * 200_000, "en", "s", 1)]
    table = spark.createDataFrame(rows, DOCS)
    check_packing(packing.pack_documents(table, tokenizer_path(BYTE_BPE)).collect(), rows)
    assert sorted(r["n_words"] for r in token_counts.counted(table, tokenizer_path(BYTE_BPE)).collect()) == [0, 1, 200_000]


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_word_ids_and_decoding_are_the_librarys(text):
    ids = WORDS.encode(text, add_special_tokens=False).ids
    assert MINE.encode(text) == ids and MINE.decode(ids) == WORDS.decode(ids, skip_special_tokens=False)


def test_long_words_and_special_tokens():
    for text in ("a" * 3000, "banana" * 400, "x<|endoftext|>Y<|startoftext|>", "ΣΑΣ İ ẞ", "'S don't WE'LL", "日本" * 50):
        assert MINE.encode(text) == WORDS.encode(text, add_special_tokens=False).ids


def test_words_take_time_in_proportion_and_the_cache_is_bounded(monkeypatch):
    import time

    draw = random.Random(2)
    took = []
    for n in (50_000, 400_000):
        word = "".join(draw.choices("abcdefghij", k=n))
        start = time.process_time()
        got = MINE.encode(word)
        took.append(time.process_time() - start)
        assert got == WORDS.encode(word, add_special_tokens=False).ids
    assert took[1] < 24 * took[0]
    monkeypatch.setattr(bpe, "CHARACTERS", 1000)
    for k in range(5):
        MINE.learn([[f"x{k}" * 400]])
    assert len(MINE.known) == 1


def test_encode_documents(spark, docs, empty):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in corpus():
        ids = WORDS.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(WORDS.decode(ids, skip_special_tokens=False)))] += 1
    got = bpe.encode_documents(docs, tokenizer_path(bpe.WORD_BPE))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want
    assert bpe.encode_documents(empty, tokenizer_path(bpe.WORD_BPE)).count() == 0


def check_packing(rows, docs):
    ids = defaultdict(list)
    for i, t, *_ in docs:
        ids[i].append(np.array([*BYTES.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = Counter((i, a, len(x[a : a + 1024]), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for i, xs in ids.items() for x in xs for a in range(0, len(x), 1024))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(n for parts in sequences.values() for _, n in parts)


def test_packing(spark, docs, empty, sf_dir):
    check_packing(packing.pack_documents(docs, tokenizer_path(BYTE_BPE)).collect(), corpus())
    assert packing.pack_documents(empty, tokenizer_path(BYTE_BPE)).count() == 0
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, tokens = check_packing(packing.pack_documents(table, tokenizer_path(BYTE_BPE)).collect(), [tuple(r) for r in table.collect()])
    assert n * 1024 - tokens < 0.02 * tokens


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_all_of_the_histogram_is_placed(histogram):
    placed = Counter()
    for pattern, count in packing.shortest_pack_first(histogram, 64):
        assert sum(pattern) <= 64 and count > 0
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram)


def test_patterns_do_not_grow_with_the_documents():
    sizes = [len(packing.shortest_pack_first({k: n * (k % 7 + 1) for k in range(1, 1025)}, 1024)) for n in (1, 1000)]
    assert sizes[1] < 2 * sizes[0] + 1024


def test_language_of_held_out_documents(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(table)
    said = {r["doc_id"]: r for r in language_id.identify(table, model).collect()}
    rows = [r for r in table.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and len(r["text"]) > 50]
    assert sum(said[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    odd = language_id.identify(docs, model).collect()
    for r, text in [(r, t) for r in odd for i, t, *_ in corpus() if i == r["doc_id"] and i not in (None, 12)]:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r["score"] <= 1
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and all(any(map(str.isalpha, r["text"])) for r in kept.collect())
    blank = language_id.fit(empty)
    assert language_id.identify(empty, blank).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, blank).collect()} == {"und"}


def test_labels_of_held_out_documents_are_not_learned(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoiled = table.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert language_id.fit(spoiled).languages == language_id.fit(table).languages


def test_codewords_are_apart():
    for n in (1, 2, 4, 6, 9, 20):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "=", ": ", '"', "api_key", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "é", "ſecret", "x.y", "\n", "passwd='"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    base, spans = secret_scan.find(text, secret_scan.trained())
    assert secret_scan.written(base) == slow_base(text) and set(base) <= set(spans)


def test_secrets(spark, docs, empty):
    net = secret_scan.trained()
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs, net).collect()}
    assert (rows[16]["n_assign"], rows[16]["n_access"], rows[16]["n_hex"]) == (1, 1, 1) and rows[1]["spans"] == ""
    clean = secret_scan.redact(docs, net)
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[16]["text"] == '[SECRET]" [SECRET]' and got[16]["n_chars"] == len(got[16]["text"]) and got[6]["text"] is None and got[1]["text"] == corpus()[0][1]
    assert secret_scan.scan(empty, net).count() == 0 == secret_scan.redact(empty, net).count()
    x, y = secret_scan.generated(800, 77)
    hit = np.array([net.accepts(n, p) for n, p in zip(x[:, 1].sum(1), net.probability(x))])
    assert hit[y == 1].mean() > 0.9 and hit[y == 0].mean() < 0.03
    scored = {r["doc_id"]: r["scores"] for r in secret_scan.scan(docs, net).collect()}
    assert {s.split(":")[0] for s in scored[16].split(",")} == {"assign", "access", "hex"} and rows[16]["n_candidates"] == 3


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=5000))
def test_matroska_round_trip(payload):
    stored = media.mux(payload)
    read = media.demux(stored)
    assert read.error is None and b"".join(stored[o : o + n] for _, _, o, n, _, _ in read.packets) == payload
    times = [p[1] for p in read.packets]
    assert times == [k * media.FRAME_MS for k in range(len(times))]


def test_matroska_parts():
    stored = media.mux(bytes(range(256)) * 2000)
    read = media.demux(stored)
    assert len(read.clusters) == len(read.cues) > 1 and [c[2] for c in read.cues] == [c[0] for c in read.clusters]
    assert read.tracks[1]["codec"] == "A_PCM/INT/LIT" and read.tracks[1]["bits"] == 8 and read.duration_ms == 64000
    cut = media.demux(stored[:-100])
    assert cut.error
    assert media.demux(b"nothing").error and media.demux(b"").error
    # Unknown sizes, a block group and EBML lacing of unequal frames.
    frames = [b"a" * 10, b"b" * 300, b"c" * 7]
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block(2, 5, frames, media.EBML_LACING)))
    odd = media.element(media.EBML, b"") + media.element_id(media.SEGMENT) + b"\xff" + media.element_id(media.CLUSTER) + b"\xff" + media.unsigned(media.TIMESTAMP, 1000) + group
    odd += media.element_id(media.CLUSTER) + b"\xff" + media.unsigned(media.TIMESTAMP, 2000) + media.element(media.SIMPLE_BLOCK, media.block(2, 0, frames, media.XIPH))
    read = media.demux(odd)
    assert read.error is None and [odd[o : o + n] for _, _, o, n, _, _ in read.packets] == frames * 2
    assert [p[1] for p in read.packets] == [1005] * 3 + [2000] * 3 and [p[4] for p in read.packets] == [0] * 3 + [1] * 3


def foreign():
    """A file as other programs write them: two tracks, block groups with and without references, durations, tags, unknown sizes."""
    e, u = media.element, media.unsigned
    track = lambda n, *more: e(media.TRACK_ENTRY, u(media.TRACK_NUMBER, n) + u(media.TRACK_TYPE, 1) + b"".join(more))
    bare = lambda track, at, frame: media.vint(track) + at.to_bytes(2, "big", signed=True) + b"\0" + frame
    laced = media.vint(2) + (40).to_bytes(2, "big") + bytes([media.FIXED << 1, 3]) + b"wxyz"
    group = lambda body, *more: e(media.BLOCK_GROUP, e(media.BLOCK, body) + b"".join(more))
    head = e(media.EBML, b"") + media.element_id(media.SEGMENT) + b"\x01" + b"\xff" * 7
    head += e(media.SEEK_HEAD, b"\xec\x81\0") + e(media.INFO, u(media.TIMESTAMP_SCALE, 1_000_000)) + e(media.TRACKS, track(1, u(media.DEFAULT_DURATION, 20_000_000)) + track(2))
    first = media.element_id(media.CLUSTER) + b"\xff" + u(media.TIMESTAMP, 500) + group(bare(1, 0, b"key")) + group(bare(1, -20, b"next"), e(media.REFERENCE_BLOCK, b"\xec"))
    first += group(laced, u(media.BLOCK_DURATION, 80))
    tags = e(media.TAGS, e(0x7373, b"\x67\xc8\x80"))
    second = media.element_id(media.CLUSTER) + b"\xff" + u(media.TIMESTAMP, 900) + e(media.SIMPLE_BLOCK, bare(1, 0, b"plain")) + e(0xEC, b"pad")
    return head + first + tags + second


def test_foreign_files():
    data = foreign()
    read = media.demux(data)
    assert read.error is None and len(read.clusters) == 2 and sorted(read.tracks) == [1, 2]
    assert [(t, when, data[o : o + n], c, key) for t, when, o, n, c, key in read.packets] == [
        (1, 500, b"key", 0, True), (1, 480, b"next", 0, False),
        (2, 540, b"w", 0, True), (2, 560, b"x", 0, True), (2, 580, b"y", 0, True), (2, 600, b"z", 0, True), (1, 900, b"plain", 1, False),
    ]


def test_media_features(spark, docs, empty):
    want = Counter()
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    got = media.media_features(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["media_sha256"], r["feature"]) for r in got}) == len({t or "" for _, t, *_ in corpus()})
    assert media.media_features(empty).count() == 0


def test_packet_table(spark):
    rows = spark.createDataFrame([(1, media.mux(b"x" * 1000)), (2, b"bad"), (3, None)], "key bigint, media binary")
    got = media.packet_table(rows, "key", "media").collect()
    assert [r["byte_length"] for r in got if r["key"] == 1] == [192] * 5 + [40] and all(r["in_cues"] for r in got if r["key"] == 1)
    assert all(r["error"] and r["packet"] is None for r in got if r["key"] != 1) and len(got) == 8


def test_token_ledger(spark, docs, empty):
    counts = token_counts.counted(docs, tokenizer_path(BYTE_BPE))
    want = Counter()
    number = Counter()
    for _, t, lang, source, _ in corpus():
        want[(source, lang)] += len(BYTES.encode(t or "", add_special_tokens=False).ids)
        number[(source, lang)] += 1
    rows = counts.select("source", "lang", F.lit("b").alias("version"), F.col("n_bpe").alias("tokens"))
    words = counts.select("source", "lang", F.lit("w").alias("version"), F.col("n_words").alias("tokens"))
    ledger = token_counts.Ledger(spark, scratch_path(spark, "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("one", token_counts.inserts(words)) and not ledger.commit("one", token_counts.inserts(words))
    assert sum(r["tokens"] for r in ledger.totals().collect()) == sum(len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for _, t, *_ in corpus())
    assert ledger.commit("two", token_counts.revisions(words, rows)) and not ledger.commit("two", token_counts.revisions(words, rows))
    got = ledger.totals().collect()
    assert {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in got} == {k: (number[k], n) for k, n in want.items()} and {r["version"] for r in got} == {"b"}
    ledger.commit("three", token_counts.deletes(rows))
    assert ledger.totals().count() == 0
    assert ledger.commit("none", token_counts.inserts(token_counts.counted(empty, tokenizer_path(BYTE_BPE)).select("source", "lang", F.lit("b").alias("version"), F.col("n_bpe").alias("tokens"))))
    with pytest.raises(ValueError):
        ledger.commit("a/b", rows)
    with pytest.raises(ValueError):
        ledger.commit("one", token_counts.inserts(rows))


def test_drafts_of_lost_committers_do_not_count(spark, docs):
    rows = token_counts.counted(docs, tokenizer_path(BYTE_BPE)).select("source", "lang", F.lit("w").alias("version"), F.col("n_words").alias("tokens"))
    ledger = token_counts.Ledger(spark, scratch_path(spark, "ledger"))
    assert ledger.commit("one", token_counts.inserts(rows))
    before = sorted(map(str, ledger.totals().collect()))
    draft = spark.createDataFrame([("s", "en", "w", 5, 5)], token_counts.COMMIT)
    draft.write.parquet(f"{ledger.path}/data/draft=dlost")
    assert sorted(map(str, ledger.totals().collect())) == before


def test_token_report(spark, docs, empty):
    want = Counter()
    for _, t, lang, source, _ in corpus():
        for version, n in (("words-1", len((t or "").encode().split())), ("byte_bpe_50k", len(BYTES.encode(t or "", add_special_tokens=False).ids))):
            want[source, lang, version, "documents"] += 1
            want[source, lang, version, "tokens"] += n
    got = token_counts.token_report(docs).collect()
    assert {(r["source"], r["lang"], r["version"], k): r[k] for r in got for k in ("documents", "tokens")} == dict(want)
    assert token_counts.token_report(empty).count() == 0


RECORDS = "record_id bigint, warc_type string, uri string, at timestamp, http_headers string, payload_digest string"


def test_revisits(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    day = lambda n: t0 + timedelta(days=n)
    rows = [
        (1, "response", "http://www.A.example/x/", day(0), 'ETag: "v1"\r\nServer: one\r\nVary: a', "d1"),
        (2, "response", "https://a.example/x?utm_source=q", day(5), 'ETag: "v2"\nLast-Modified: L2', "d2"),
        (3, "revisit", "http://a.example/x#top", day(3), 'ETag: W/"v1"\nVary: b\nServer: two', None),
        (4, "revisit", "http://a.example/x", day(9), 'ETag: "v1"', None),
        (5, "revisit", "http://a.example/x", day(9), "Last-Modified: L2", None),
        (6, "revisit", "http://a.example/x", day(-1), 'ETag: "v1"', None),
        (7, "revisit", "http://a.example/x", day(9), "Server: q", None),
        (8, "revisit", None, day(9), None, None),
        (9, "revisit", "http://a.example/x", None, 'ETag: "v1"', None),
        (10, "request", "http://a.example/x", day(1), "", None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert [got[k]["outcome"] for k in range(1, 11)] == ["response", "response", "resolved", "validator mismatch", "resolved", "no earlier response", "no validator", "no earlier response", "no earlier response", "other"]
    assert got[3]["source_id"] == 1 and got[3]["payload_digest"] == "d1" and got[3]["headers"] == 'etag: W/"v1"\nserver: one\nvary: b'
    assert got[5]["source_id"] == 2
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_by_brute_force(spark):
    from datetime import datetime, timedelta

    draw = random.Random(4)
    rows = []
    for k in range(400):
        url = "http://hot.example/" if draw.random() < 0.5 else f"http://h{draw.randrange(9)}.example/p"
        rows.append((k, draw.choice(["response", "revisit"]), url, datetime(2024, 1, 1) + timedelta(hours=draw.randrange(400)), f'ETag: "{draw.randrange(3)}"', f"d{k}"))
    got = {r["record_id"]: (r["outcome"], r["source_id"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    for k, kind, url, at, tag, _ in rows:
        before = [(r[3], r[0], r[4]) for r in rows if r[1] == "response" and r[2] == url and (r[3], r[0]) < (at, k)]
        if kind == "response":
            assert got[k] == ("response", k)
        elif not before:
            assert got[k] == ("no earlier response", None)
        else:
            assert got[k] == (("resolved", max(before)[1]) if max(before)[2] == tag else ("validator mismatch", None))


def test_revisits_that_repeat(spark):
    """Repeated rows, a response whose id, URL and time repeat with another digest, a hot response, extra columns, a long header block."""
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    long = "".join(f"X-{k % 4000}: {k}\r\n" for k in range(8000)) + 'ETag: "a"'
    rows = [(1, "response", "http://a.example/", t0, long, "d1"), (1, "response", "http://a.example/", t0, 'ETag: "a"', "d2"), (1, "response", "http://b.example/", t0, 'ETag: "b"', "d3")]
    rows += [(2, "revisit", "http://a.example/", t0 + timedelta(days=1), 'ETag: "a"', None)] * 3 + [(2, "revisit", "http://b.example/", t0 + timedelta(days=2), 'ETag: "b"', None)]
    rows += [(k, "revisit", "http://b.example/", t0 + timedelta(days=9), 'ETag: "b"', None) for k in range(10, 3000)]
    table = spark.createDataFrame(rows, RECORDS)
    for name in ("row", "url", "headers", "source", "tie", "block", "stored", "uses", "full"):
        table = table.withColumn(name, F.lit("extra"))
    got = warc.resolve_revisits(table.repartition(3)).collect()
    assert len(got) == len(rows) and all(r["outcome"] in ("response", "resolved") for r in got)
    second = [r for r in got if r["record_id"] == 2]
    assert len({tuple(r) for r in second if r["url"] == "a.example"}) == 1 and len(second) == 4
    assert {r["payload_digest"] for r in got if r["url"] == "b.example"} == {"d3"}
    assert max(len(r["headers"].split("\n")) for r in got) == 4001 and {r["headers"] for r in got if "x-1: " in r["headers"]} == {max((r["headers"] for r in got), key=len)}


def test_all_outcomes_in_the_history(spark, sf_dir):
    got = Counter(r["outcome"] for r in warc.op10_warc(spark, sf_dir).collect())
    assert set(got) == {"response", "resolved", "validator mismatch", "no validator", "no earlier response"}


def test_warc_files_are_read(spark, tmp_path):
    """Files of a folder, plain, gzip by record, cut off and no WARC, give the records that went in."""
    import gzip

    one = [warc._record(k, "response" if k % 2 else "revisit", f"http://a.example/{k}", "2024-01-02T03:04:05Z", f"ETag: {k}\r\n", "sha", "é" * k) for k in range(6)]
    other = one[0].replace(b"server-not-modified", b"identical-payload-digest").replace(b"<urn:record:0>", b"<urn:uuid:x>")
    (tmp_path / "a.warc").write_bytes(b"".join(one))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one[:4]))
    (tmp_path / "c.warc").write_bytes(one[1] + one[3][:-20])
    (tmp_path / "d.warc").write_bytes(b"nothing")
    (tmp_path / "e.warc").write_bytes(other)
    rows = warc.read_warc(spark, f"file://{tmp_path}", bodies=True).collect()
    of = defaultdict(list)
    for r in rows:
        of[r["path"].rsplit("/", 1)[1]].append(r)
    assert [r["record_id"] for r in of["a.warc"]] == list(range(6)) and [r["body"].decode() for r in of["a.warc"]] == ["é" * k for k in range(6)]
    assert [r["record_id"] for r in of["b.warc.gz"]] == list(range(4)) and str(of["a.warc"][0]["at"]) == "2024-01-02 03:04:05"
    plain = b"".join(one)
    assert all(plain[r["record_offset"] :].startswith(b"WARC/1.1") and r["record_offset"] + r["record_length"] <= len(plain) for r in of["a.warc"])
    assert [r["warc_type"] for r in of["c.warc"]] == ["response", "error"] and [r["warc_type"] for r in of["d.warc"]] == ["error"]
    assert of["e.warc"][0]["warc_type"] == "revisit of another profile" and len(warc.resolve_revisits(warc.read_warc(spark, f"file://{tmp_path}")).collect()) == len(rows)


def test_parse_warc():
    import gzip

    body = b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nhello"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    for data in (record * 2, gzip.compress(record) * 2):
        got = list(warc.parse_warc(data))
        assert len(got) == 2 and got[0]["body"] == b"hello" and "ETag: x" in got[0]["http_headers"] and got[0]["warc"]["warc-type"] == "response"
    assert DOCS
