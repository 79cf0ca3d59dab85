"""Substring dedup by fixed-block anchors.

Repeats of at least WINDOW = 13 words hold a whole aligned block of BLOCK = 7 words of either text. So the non-overlapping
blocks of every text are the index, and every rolling window of 7 words of every text probes it. A probe that finds a block
elsewhere is an anchor; hits extend to exact repeats: of the 13-word windows around anchors the least doc_id is taken for
each word sequence, and the windows that a smaller doc_id has too run together to maximal exact repeats, whose words go.

Texts travel once, packed in chunks of whole documents, and are kept in a table bucketed by chunk. Between chunks only
sorted, delta-coded hashes move: each chunk sends a hash once, however often it holds it, so a passage of a third of all
documents comes to its bucket as often as there are chunks. Answers come back as the hashes that were hit; positions are
never sent, as a chunk can find them again. Buckets grow in number with the words, not in size.

A chunk sends at most FAN rows. Where there are more buckets than that, cells stand between: a cell takes one of FAN routes from a
group of chunks, about as many hashes as a bucket, merges equal ones and sends what is left to at most as many buckets as
there are groups, and the answers take the same way back. So rows stay a share of 1/FAN of a chunk or cell, however long the
text is, and a passage that every chunk has comes to its bucket once for each group.

Words are equal if their 64-bit hashes are, windows likewise: over n windows an accidental match has a chance of about
n^2 / 2^65 in all. Anchor hashes are shorter; their accidental matches only cost time, as the longer windows decide.

Null and empty texts have no words. A text is handled whole in one task. Rows that repeat a doc_id are no smaller than each
other and remove nothing of each other; a null doc_id is greater than all others. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, scratch_path, scratch_table, shuffle_partitions

WINDOW, BLOCK = 13, 7
#: Bytes of text that make a chunk full, words of all texts for one bucket, and the least bits of an anchor's hash.
CHUNK, BUCKET, ANCHOR_BITS = 2 << 20, 1 << 21, 40
#: Routes that a chunk's hashes take at most; FAN * FAN buckets, about 10^13 words, need no larger buckets.
FAN = 2048
LAST = np.iinfo(np.int64).max
_SLICE = 4 << 20

U = np.uint64
_BASE, _WIDE, _NARROW = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def _encode(values: np.ndarray) -> bytes:
    """A sorted array of unsigned integers."""
    steps = np.diff(values, prepend=U(0)).astype("<u8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word text[start:end], from prefix sums over slices of the text."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        base, n = starts[at], int(ends[to - 1] - starts[at])
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(n + 1, _BASE, np.uint64))
            back = np.cumprod(np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64))
            sums = np.concatenate(([U(0)], np.cumsum((text[base : base + n].astype(np.uint64) + U(1)) * powers[:n])))
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = _mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Chunk:
    """Whole documents of a chunk: their words' hashes and where each begins."""

    def __init__(self, body: bytes, ids: bytes):
        self.raw = zstandard.decompress(body)
        self.ids = np.frombuffer(ids, "<i8")
        text = np.frombuffer(self.raw, np.uint8)
        cuts = np.flatnonzero((text == 32) | (text == 10))
        starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(text)]))
        real = ends > starts
        lines = np.flatnonzero(text == 10)
        self.lines = np.concatenate(([0], lines + 1)), np.concatenate((lines, [len(text)]))
        self.doc = np.searchsorted(lines, starts[real])
        self.first = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        self.words = _word_hashes(text, starts[real], ends[real])

    def windows(self, size: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of `size` words within one document, and their hashes."""
        n = len(self.words) - size + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        acc = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                acc = acc * U(factor) + self.words[k : k + n]
            starts = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
            return starts, _mix(acc[starts])


def pack_chunks(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """chunk, n_words, ids and body: documents in order, words joined by a space, documents by a line end, compressed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size, words = [], [], 0, 0

        def full() -> pa.RecordBatch:
            body = zstandard.compress(b"\n".join(texts), 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([body], pa.binary())],
                names=["chunk", "n_words", "ids", "body"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = (text.as_py() or "").encode().split()
                ids.append(LAST if doc is None else doc)
                texts.append(b" ".join(own))
                size, words = size + len(texts[-1]), words + len(own)
                if size >= chunk_bytes:
                    yield full()
                    ids, texts, size, words, number = [], [], 0, 0, number + 1
        if ids:
            yield full()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(rows, "chunk bigint, n_words bigint, ids binary, body binary")


class Probes:
    """Hashes of 7 words with two flags below: a sender has it as a block; it has it more than once. Hit are blocks that occur at two places or more."""

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        return keys >> U(2)

    @staticmethod
    def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        every = np.concatenate(keys)
        value, place = np.unique(every >> U(2), return_inverse=True)
        times = np.bincount(place, 1 + (every & U(1)).astype(np.int64), len(value))
        block = np.zeros(len(value), bool)
        block[place[(every & U(2)) > 0]] = True
        return value, place, times, block

    @classmethod
    def hits(cls, keys: list[np.ndarray], _: list[np.ndarray]) -> list[np.ndarray]:
        """For each sender its hashes that were hit."""
        _, place, times, block = cls._counted(keys)
        hit = (block & (times > 1))[place]
        ends = np.cumsum([len(k) for k in keys])
        return [k[hit[e - len(k) : e]] >> U(2) for k, e in zip(keys, ends)]

    @classmethod
    def merged(cls, keys: list[np.ndarray], _: list[np.ndarray]) -> tuple[np.ndarray, None]:
        """What several senders have together, as of one."""
        value, _, times, block = cls._counted(keys)
        return value << U(2) | block.astype(np.uint64) << U(1) | (times > 1).astype(np.uint64), None

    @classmethod
    def shared(cls, keys: list[np.ndarray], _: list[np.ndarray], hit: np.ndarray) -> list[np.ndarray]:
        """For each sender its part of what was hit for all of them together."""
        return [(k >> U(2))[_among(k >> U(2), hit)] for k in keys]


class Owners(Probes):
    """Hashes of 13 words with the least doc_id that a sender has of each. Hit are those that another sender has with a smaller one."""

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        return keys

    @staticmethod
    def _least(keys: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner = np.concatenate(owners)
        value, place = np.unique(np.concatenate(keys), return_inverse=True)
        least = np.full(len(value), LAST)
        np.minimum.at(least, place, owner)
        return value, place, owner, least

    @classmethod
    def hits(cls, keys: list[np.ndarray], owners: list[np.ndarray]) -> list[np.ndarray]:
        return cls.shared(keys, owners, np.empty(0, np.uint64))

    @classmethod
    def merged(cls, keys: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, _, _, least = cls._least(keys, owners)
        return value, least

    @classmethod
    def shared(cls, keys: list[np.ndarray], owners: list[np.ndarray], hit: np.ndarray) -> list[np.ndarray]:
        _, place, owner, least = cls._least(keys, owners)
        gone = (owner > least[place]) | _among(np.concatenate(keys), hit)
        ends = np.cumsum([len(k) for k in keys])
        return [k[gone[e - len(k) : e]] for k, e in zip(keys, ends)]


Answer = Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _extra(row: tuple) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(row[3]), "<i8") if row[3] else np.empty(0, np.int64)


def _together(sent: DataFrame, by: str) -> DataFrame:
    # Buckets are a multiple of the partitions, so dealing them in turn gives each partition as many.
    parts = shuffle_partitions(sent.sparkSession)
    return sent.repartitionById(parts, (F.col(by) % parts).cast("int"))


def _answers(sent: DataFrame, answer: Answer) -> DataFrame:
    """Bring the rows (bucket, sender, hashes, extra) of a bucket together; rows (sender, hashes) with what answer names for it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            found = answer([_decode(r[2]) for r in held], [_extra(r) for r in held])
            out = [(r[1], _encode(f)) for r, f in zip(held, found) if len(f)]
            for at in range(0, len(out), 1000):
                c, f = zip(*out[at : at + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.binary())], names=["chunk", "hashes"])

    near = _together(sent, "bucket").sortWithinPartitions("bucket").select("bucket", "chunk", "hashes", "extra")
    return near.mapInArrow(rows, "chunk bigint, hashes binary")


def _exchange(sent: DataFrame, buckets: int, kind: type[Probes]) -> DataFrame:
    """Rows (chunk, answers: a list of coded arrays of the hashes that were hit), for rows (bucket, chunk, hashes, extra) on routes."""
    routes = _routes(buckets)
    if routes == buckets:
        found = _answers(sent, kind.hits)
    else:
        groups = -(-buckets // routes)
        cells = materialize(sent.withColumn("cell", F.col("bucket") + routes * F.pmod(F.xxhash64("chunk"), F.lit(groups))), "cells")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _groups(batches):
                keys, extra = kind.merged([_decode(r[2]) for r in held], [_extra(r) for r in held])
                place = kind.hashes(keys) // U(routes) % U(groups) * U(routes) + U(held[0][0] % routes)
                yield _send(held[0][0], keys, place, extra)

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _groups(batches):
                back = [_decode(r[2]) for r in held if r[1] is None]
                chunks = [r for r in held if r[1] is not None]
                hit = np.sort(np.concatenate(back)) if back else np.empty(0, np.uint64)
                found = kind.shared([_decode(r[2]) for r in chunks], [_extra(r) for r in chunks], hit)
                out = [(r[1], _encode(f)) for r, f in zip(chunks, found) if len(f)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["chunk", "hashes"])

        own = cells.select("cell", "chunk", "hashes", "extra")
        up = _together(own, "cell").sortWithinPartitions("cell").mapInArrow(merge, SENT)
        down = _answers(up, kind.hits).select(F.col("chunk").alias("cell"), F.lit(None).cast("bigint").alias("chunk"), "hashes", F.lit(None).cast("binary").alias("extra"))
        found = _together(own.unionByName(down), "cell").sortWithinPartitions("cell").mapInArrow(share, "chunk bigint, hashes binary")
    return found.groupBy("chunk").agg(F.collect_list("hashes").alias("answers"))


def _routes(buckets: int) -> int:
    return min(buckets, FAN)


def _send(sender: int, keys: np.ndarray, place: np.ndarray, extra: np.ndarray | None) -> pa.RecordBatch:
    """Sorted keys, a row for each place that has any."""
    order = np.argsort(place, kind="stable")
    sorted_place = place[order]
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], sorted_place[1:] != sorted_place[:-1]))), [len(keys)])) if len(keys) else np.zeros(1, int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = order[a:b]
        out.append((int(sorted_place[a]), sender, _encode(keys[part]), None if extra is None else zstandard.compress(extra[part].astype("<i8").tobytes(), 1)))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)], names=["bucket", "chunk", "hashes", "extra"])


SENT = "bucket bigint, chunk bigint, hashes binary, extra binary"


def _probes(chunks: DataFrame, routes: int, bits: int) -> DataFrame:
    """Each chunk's distinct hashes of 7 words, with two flags: the chunk has it as a block; it has it more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, body in zip(*[c.to_pylist() for c in batch.columns]):
                chunk = Chunk(body, ids)
                starts, h = chunk.windows(BLOCK, _NARROW)
                aligned = (starts - chunk.first[chunk.doc[starts]]) % BLOCK == 0
                key, place, n = np.unique(h >> U(64 - bits), return_inverse=True, return_counts=True)
                block = np.zeros(len(key), bool)
                block[place[aligned]] = True
                yield _send(number, key << U(2) | block.astype(np.uint64) << U(1) | (n > 1).astype(np.uint64), key % U(routes), None)

    return chunks.select("chunk", "ids", "body").mapInArrow(rows, SENT)


def _candidates(joined: DataFrame, routes: int, bits: int) -> DataFrame:
    """Each chunk's distinct hashes of the 13-word windows that hold an anchor, with the least doc_id of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, body, answers in zip(*[c.to_pylist() for c in batch.columns]):
                chunk = Chunk(body, ids)
                anchors = np.sort(np.concatenate([_decode(a) for a in answers]))
                starts, h = chunk.windows(BLOCK, _NARROW)
                hit = np.zeros(len(chunk.words) + 1, np.int64)
                hit[starts[_among(h >> U(64 - bits), anchors)] + 1] = 1
                hit = np.cumsum(hit)
                starts, h = chunk.windows(WINDOW, _WIDE)
                near = hit[starts + WINDOW - BLOCK + 1] > hit[starts]
                h, owner = h[near], chunk.ids[chunk.doc[starts[near]]]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
                yield _send(number, h[first], h[first] % U(routes), owner[first])

    return joined.select("chunk", "ids", "body", "answers").mapInArrow(rows, SENT)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed string, kept string"


def _cut(joined: DataFrame, whole: bool) -> DataFrame:
    fields = RESULT.split(", ") if whole else RESULT.split(", ")[:4]
    names = [f.split()[0] for f in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()] * 3
        for batch in batches:
            for ids, body, answers in zip(*[c.to_pylist() for c in batch.columns]):
                chunk = Chunk(body, ids)
                gone = _gone(chunk, np.sort(np.concatenate([_decode(a) for a in answers])) if answers else np.empty(0, np.uint64))
                out = []
                for k, (begin, end) in enumerate(zip(*chunk.lines)) if len(chunk.ids) else ():
                    raw, drop = chunk.raw[begin:end], gone[chunk.first[k] : chunk.first[k + 1]]
                    kept = b" ".join([w for w, d in zip(raw.split(), drop.tolist()) if not d]) if drop.any() else raw
                    row = (None if chunk.ids[k] == LAST else int(chunk.ids[k]), len(drop), int(drop.sum()), hashlib.sha256(kept).hexdigest())
                    out.append((*row, _ranges(drop), kept.decode()) if whole else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return joined.select("ids", "body", "answers").mapInArrow(rows, ", ".join(fields))


def _ranges(drop: np.ndarray) -> str:
    """Removed words as first:end, maximal repeats in order."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(np.int8), [0]))))
    return ",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2))


def _gone(chunk: Chunk, earlier: np.ndarray) -> np.ndarray:
    """Which words a window covers whose sequence also starts in a document with a smaller doc_id."""
    starts, h = chunk.windows(WINDOW, _WIDE)
    owner = chunk.ids[chunk.doc[starts]]
    order = np.lexsort((owner, h))
    sorted_h = h[order]
    first = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1])) if len(h) else np.empty(0, bool)
    least = np.empty(len(h), np.int64)
    least[order] = owner[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(h) else 0
    hit = starts[(owner > least) | _among(h, earlier)]
    cover = np.zeros(len(chunk.words) + WINDOW + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return np.cumsum(cover)[: len(chunk.words)] > 0


def remove_repeats(docs: DataFrame, whole: bool = True, chunk_bytes: int = CHUNK, bucket_words: int = BUCKET) -> DataFrame:
    """A row for each row of docs; with whole also the removed word ranges and the text that is left.

    A task holds about 30 bytes for each byte of a chunk and for each word of a bucket; both may grow with the executors' memory.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    name = scratch_table(f"text_chunks_{uuid.uuid4().hex}")
    path = scratch_path(spark, "chunks")
    packed = pack_chunks(docs, chunk_bytes).repartition(parts, "chunk")
    packed.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(parts, "chunk").sortBy("chunk").saveAsTable(name)
    chunks = spark.read.table(name)
    words = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = parts * max(1, -(-words // (bucket_words * parts)))
    bits = min(62, max(ANCHOR_BITS, words.bit_length() + 10))
    routes = _routes(buckets)
    anchors = materialize(_exchange(_probes(chunks, routes, bits), buckets, Probes), "anchors")
    hits = materialize(_exchange(_candidates(chunks.hint("merge").join(anchors, "chunk"), routes, bits), buckets, Owners), "hits")
    return _cut(chunks.hint("merge").join(hits, "chunk", "left"), whole)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), whole=False)
