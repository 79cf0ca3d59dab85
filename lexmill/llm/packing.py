"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised and cut into full sequences and a remainder. The histogram of piece lengths (at most SIZE rows) goes
to the driver, where lengths are placed longest first into the pattern with the fewest tokens that has room. Every pattern
is a list of lengths and a count; a piece finds its place by its rank among the pieces of its length.
Ranks come from a range-partitioned sort, so a length that a third of all pieces have is spread over many tasks.

Null text is empty text: a document of one id, the separator. Texts of any length are cut into pieces. Repeated rows are
packed each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from .tokens import BYTE_BPE, byte_bpe, encode, tokenizer_path

SIZE, SEPARATOR = 1024, 0

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """A row for each piece: its place in the document's ids, its length and the CRC-32 of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        names = [part.split()[0] for part in PIECES.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(encoder, text.as_py()), np.uint32(separator)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (each of at most `size` together) and how often each is used; all of the histogram is placed.

    Lengths go longest first; a length goes to the pattern with the fewest tokens, if it has room, or else opens a new one,
    which then is the shortest and takes the same length until it is full. A step splits at most one pattern and opens at
    most two, so the list is bounded by the number of lengths, not by that of documents.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    roomiest: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in open_packs:
            open_packs[room] = []
            heapq.heappush(roomiest, -room)
        open_packs[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and roomiest and -roomiest[0] >= length:
            room = -roomiest[0]
            pattern, count = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                heapq.heappop(roomiest)
            used = min(left, count)
            if count > used:
                put(room, pattern, count - used)
            put(room - length, (*pattern, length), used)
            left -= used
        full, rest = divmod(left, size // length)
        for times, count in ((size // length, full), (rest, 1)):
            if times and count:
                put(size - times * length, (length,) * times, count)
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """By length and rank: the first rank of each run of pieces, the sequence of its first piece and its offset there."""
    next_rank: dict[int, int] = {}
    runs, first = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = next_rank.get(length, 0)
            runs.append((length, rank, first, offset))
            next_rank[length] = rank + count
            offset += length
        first += count
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 4).T
    return {"key": columns[0] << 48 | columns[1], "rank": columns[1], "sequence": columns[2], "offset": columns[3]}


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """parts (rows of `pieces`) with sequence_id and offset."""
    parts = materialize(parts, "pieces")  # the range partitioning below samples it
    order = ["length", "doc_id", "start"]
    ranked = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    ranked = materialize(ranked, "ranked")
    # A range partition holds a run of lengths, so these are at most as many rows as lengths and partitions together.
    runs = ranked.groupBy(F.shiftright("row", 33).alias("part"), "length").agg(F.min("row").alias("first"), F.count("*").alias("n")).orderBy("part", "length").collect()
    before: dict[int, int] = {}
    starts = []
    for run in runs:
        starts.append((run["first"], before.get(run["length"], 0)))
        before[run["length"]] = before.get(run["length"], 0) + run["n"]
    starts.sort()
    first_row, first_rank = (np.array(c, np.int64) for c in (zip(*starts) if starts else ((), ())))
    table = places(shortest_pack_first(before, size))
    schema = f"{PIECES}, sequence_id bigint, offset bigint"
    names = [part.split()[0] for part in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, length = batch.column("row").to_numpy(), batch.column("length").to_numpy()
            run = np.searchsorted(first_row, row, "right") - 1
            rank = row - first_row[run] + first_rank[run]
            slot = np.searchsorted(table["key"], length << 48 | rank, "right") - 1
            extra = [pa.array(table["sequence"][slot] + rank - table["rank"][slot]), pa.array(table["offset"][slot])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:5]] + extra, names=names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    return pack(pieces(docs, path, size), size)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))
