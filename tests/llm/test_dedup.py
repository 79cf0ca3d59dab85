"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import exact_dedup, near_dedup, substring_dedup
from lexmill.llm.components import components
from lexmill.llm.queries import ORACLE_SQL, QUERIES

from .conftest import DOCS, corpus

SPLIT = r"[\x20\x09-\x0D]+"


def key(x):
    return (x is None, x if x is not None else 0)


def test_exact_marks(spark, docs):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(SPLIT, "", t or "")].append((i, t or ""))
    want = Counter()
    for norm, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1]), key(r[0])))
        for i, t in rows:
            want[(i, best[0], len(rows), i == best[0] and len(t) == len(best[1]), hashlib.sha256(norm.encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.open_index(spark).mark(docs).collect())
    assert got == want


def test_exact_deduplicate_keeps_one_row_and_all_columns(spark, docs, empty):
    got = exact_dedup.open_index(spark).deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    norms = [re.sub(SPLIT, "", r["text"] or "") for r in rows]
    assert len(norms) == len(set(norms)) == len({re.sub(SPLIT, "", t or "") for _, t, *_ in corpus()})
    assert exact_dedup.open_index(spark).deduplicate(empty).count() == 0 == exact_dedup.open_index(spark).mark(empty).count()


def test_index_persists_and_repeats_add_nothing(spark, docs, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    index = exact_dedup.open_index(spark, path, 4)
    first = index.mark(docs.filter("doc_id < 5")).count()
    size = index.read().count()
    index.mark(docs.filter("doc_id < 5")).count()
    assert index.read().count() == size and first == 4
    spark.sql(f"DROP TABLE {index.table}")
    again = exact_dedup.open_index(spark, path, 4)
    assert again.read().count() == size
    later = again.mark(spark.createDataFrame([(50, corpus()[0][1], "en", "s", 1)], DOCS)).first()
    assert later["keep_id"] == 2 and not later["kept"]


def test_index_merges_its_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILES", 2)
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    index = exact_dedup.open_index(spark, path, 3)
    for k in range(5):
        index.mark(spark.createDataFrame([(k, f"text {i}", "en", "s", 1) for i in range(10 * k, 10 * k + 30)], DOCS)).count()
    assert index.generation > 0 and index.read().count() == 70 == index.read().select("digest").distinct().count()
    again = exact_dedup.open_index(spark, path, 3)
    assert again.generation == index.generation and again.read().count() == 70
    assert sorted(map(str, again.mark(docs).collect())) == sorted(map(str, exact_dedup.open_index(spark).mark(docs).collect()))
    later = again.mark(spark.createDataFrame([(90, "text 1", "en", "s", 1), (91, "text 1", "en", "s", 1)], DOCS)).collect()
    assert {(r["keep_id"], r["group_size"], r["kept"]) for r in later} == {(0, 1, False)}  # as of the batch that brought the text


def test_scratch_is_dropped_once_results_are_written(spark, docs):
    from lexmill.llm.common import drop_scratch

    rows = exact_dedup.open_index(spark).mark(docs).collect()
    words = substring_dedup.remove_repeats(docs, whole=False).collect()
    tables = {t.name for t in spark.catalog.listTables()}
    assert drop_scratch(spark) >= 4 and drop_scratch(spark) == 0
    assert not {t for t in tables & {t.name for t in spark.catalog.listTables()} if t.startswith("text_chunks_")}
    assert len(rows) == len(words) == len(corpus())


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(SPLIT, text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def closed(values):
    """Component of each value under links of 3 or fewer bits, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark, docs, texts, empty):
    prints = [slow_fingerprint(t) for t in texts]
    assert [near_dedup.fingerprint(t) for t in texts] == prints
    roots = closed(prints)
    ids = [i for i, *_ in corpus()]
    least = {r: min((i for i, q in zip(ids, roots) if q == r and i is not None), default=None) for r in roots}
    want = Counter((i, f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, roots))
    rows = near_dedup.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    assert Counter(tuple(r) for r in rows) == want
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert near_dedup.near_duplicates(empty).count() == 0 == near_dedup.deduplicate(empty).count()


def slow_set(text, shingle=5):
    words = [w for w in re.split(SPLIT, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(sets, similarity=0.8):
    """Component of each set under links of at least this share of the union, by comparing all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def families(draw):
    """Texts in families of near copies of many degrees, and texts alone."""
    word = lambda: f"w{draw.randrange(3000)}"
    rows = []
    for size in (1, 2, 2, 3, 5, 9, 40, 90):
        for _ in range(4):
            base = [word() for _ in range(draw.randint(30, 250))]
            for k in range(size):
                copy = list(base)
                for _ in range(k and draw.choice((0, 1, 1, 2, len(copy) // 40, len(copy) // 15))):
                    copy[draw.randrange(len(copy))] = word()
                rows.append(" ".join(copy))
    draw.shuffle(rows)
    return rows


def same(found, want):
    return len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_similar_documents(spark, docs, texts, empty):
    want = alike([slow_set(t) for t in texts])
    rows = near_dedup.similar_documents(docs)
    least = {r: min((i for (i, *_), q in zip(corpus(), want) if q == r and i is not None), default=None) for r in want}
    assert Counter((r["doc_id"], r["component_id"]) for r in rows.collect()) == Counter((i, least[q]) for (i, *_), q in zip(corpus(), want))
    kept = near_dedup.deduplicate_similar(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want))
    assert near_dedup.similar_documents(empty).count() == 0 == near_dedup.deduplicate_similar(empty).count()


@pytest.mark.parametrize("crowd, small, copy", [(1 << 15, 48, 1000), (20, 8, 3)])
def test_similar_documents_by_brute_force(spark, monkeypatch, crowd, small, copy):
    """No link is wrong; of what all pairs would join at 0.8, 95 of 100 are joined (pairs that share no segment are missed)."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "PAIRS_A_COPY", copy)
    texts = families(random.Random(3))
    want = alike([slow_set(t) for t in texts])
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    root = {r["doc_id"]: r["component_id"] for r in near_dedup.similar_documents(rows).collect()}
    got = [root[i] for i in range(len(texts))]
    again = near_dedup.similar_documents(rows.orderBy(F.desc("text")).coalesce(2))
    assert {r["doc_id"]: r["component_id"] for r in again.collect()} == root
    assert all(len({want[i] for i in range(len(texts)) if got[i] == c}) == 1 for c in set(got))
    assert len(texts) - len(set(got)) >= 0.95 * (len(texts) - len(set(want))) > 100


def test_pairs_of_a_crowded_bucket(spark, monkeypatch):
    """Pairs whose only equal segment is that of a crowded bucket, in sizes of one class, of two beside each other, and at the bounds of classes."""
    monkeypatch.setattr(near_dedup, "CROWD", 20)
    monkeypatch.setattr(near_dedup, "SLICE", 5)
    draw, rows, want = random.Random(4), [], set()
    for i in range(60):
        bits = draw.getrandbits(512) >> 16 << 16 | 0xABCD
        other = bits
        for k in range(1, 32):
            other ^= 1 << 16 * k + draw.randrange(16)
        size = draw.choice((1, 4, 5, 16, 100, 125, 4000))
        for node, n, ring in ((2 * i, size, bits), (2 * i + 1, draw.choice((size, -(-size * 4 // 5), size * 5 // 4)), other)):
            rows.append((node, n, *np.frombuffer(ring.to_bytes(64, "little"), "<i8").tolist()))
        want.add((2 * i, 2 * i + 1))
    nodes = spark.createDataFrame(rows, "node bigint, n_shingles int, " + ", ".join(f"{c} bigint" for c in near_dedup.RING_COLUMNS))
    assert {tuple(r) for r in near_dedup._ring_pairs(nodes.repartition(3)).collect()} == want


def test_fingerprints_of_very_long_texts():
    draw = random.Random(6)
    text = " ".join(f"w{draw.randrange(5000)}" for _ in range(150_000))
    assert near_dedup.fingerprint(text) == slow_fingerprint(text)
    hashes = near_dedup.shingle_set(text, 5)
    assert len(hashes) == len(slow_set(text)) and near_dedup.fingerprint(" " * 3_000_000) == 0
    bits = np.unpackbits(near_dedup.ring(hashes).view(np.uint8), bitorder="little")
    for word in range(near_dedup.RING):
        mixed = near_dedup._mixed(hashes + np.uint64((word + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for bit in (0, 17, 63):
            assert bits[64 * word + bit] == (2 * int((mixed >> np.uint64(bit) & np.uint64(1)).sum()) > len(hashes))


def test_links_of_dense_and_chained_fingerprints(spark):
    draw = random.Random(5)
    values = set()
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(60):
            values.add(at)
            for _ in range(draw.randint(1, 5)):
                at ^= 1 << draw.randrange(64)
    values |= {draw.getrandbits(64) for _ in range(200)}
    centre = draw.getrandbits(64)
    values |= {centre ^ (1 << b) for b in range(64)}
    values = sorted(values)
    roots = closed(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components(near_dedup.links(nodes)).collect()}
    mine = [found.get(v, v) for v in signed]
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


def test_crowded_buckets_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    draw = random.Random(9)
    values = sorted({(0xABCD << 48) ^ draw.getrandbits(20) for _ in range(400)})
    roots = closed(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    found = {r["node"]: r["root"] for r in components(near_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))).collect()}
    mine = [found.get(v, v) for v in signed]
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (1, 2), (2, 1)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in range(200, 260)) and found[2] == 1 and 3 not in found
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removed(rows):
    """Words covered by a 13-word window that starts in a document with a smaller id."""
    first, words = {}, []
    order = lambda i: (1 << 62) if i is None else i
    for i, t, *_ in rows:
        w = [x for x in re.split(SPLIT, t or "") if x]
        words.append((i, w))
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            first[s] = min(first.get(s, 1 << 63), order(i))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(i):
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    return out


def test_substring_dedup(spark, docs, empty):
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got) == removed(corpus())
    assert any(r["removed"] for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed, fan", [(1, 2048), (2, 2048), (1, 8), (3, 12)])
def test_substring_dedup_over_many_chunks(spark, seed, fan, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    draw = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(draw.randint(8, 40))] for k in range(20)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(draw.randint(0, 6)):
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            words += draw.choice([p, p[a:], p[:a], [f"u{i}x{k}" for k in range(draw.randint(1, 30))]])
        rows.append((i, " ".join(words), "en", "s", 0))
    draw.shuffle(rows)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(12), chunk_bytes=400, bucket_words=50).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got) == removed(rows)


def test_rows_that_a_chunk_sends_are_bounded(spark, monkeypatch):
    """More buckets than routes: a chunk and a cell send no more rows than there are routes and groups."""
    draw = random.Random(7)
    rows = [(i, " ".join(f"w{draw.randrange(500)}" for _ in range(300)), "en", "s", 0) for i in range(60)]
    chunks = substring_dedup.pack_chunks(spark.createDataFrame(rows, DOCS).repartition(4), 2000)
    for fan in (8, 64):
        sent = substring_dedup._probes(chunks, fan, 40)
        assert sent.groupBy("chunk").count().agg(F.max("count")).first()[0] <= fan
        assert sent.agg(F.max("bucket")).first()[0] < fan


def test_substring_dedup_of_a_very_long_text(spark):
    draw = random.Random(8)
    long = [f"w{draw.randrange(10**9)}" for _ in range(400_000)]
    rows = [(1, " ".join(long), "en", "s", 0), (2, " ".join(long[1000:1100] + ["x"] * 20 + long[399_000:]), "en", "s", 0), (3, "short", "en", "s", 0)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got) == removed(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(result.fetchall())
