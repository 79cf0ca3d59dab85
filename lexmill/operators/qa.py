"""Curation of question-answer records."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import quality as Q
from lexmill.functions import text as X
from lexmill.operators.metrics import _lcs

FIELDS = ("question", "answer", "label", "paragraph_id", "quality_score")


def validated(records: DataFrame, min_score: float = Q.MIN_SCORE) -> DataFrame:
    """records with reject_reason, null for those that pass."""
    return records.withColumn("reject_reason", Q.record_reject_reason({k: F.col(k) for k in FIELDS}, min_score))


def normalized(records: DataFrame) -> DataFrame:
    """Clean texts, label, score and trimmed id; rows whose label or score is none are dropped."""
    done = records.select(
        "ord",
        *[X.collapse_spaces(F.col(c)).alias(c) for c in ("question", "answer", "paragraph", "sentence")],
        X.normalize_label(F.col("label")).alias("label"),
        F.col("quality_score").cast("string").try_cast("double").alias("quality_score"),
        F.trim("paragraph_id").alias("paragraph_id"),
        F.coalesce(F.lower("language"), F.lit("en")).alias("language"),
    )
    return done.filter("label IS NOT NULL AND quality_score IS NOT NULL").withColumn("qa_hash", X.pair_hash(F.col("question"), F.col("answer")))


def first_of_each(records: DataFrame, key: str = "qa_hash", order: str = "ord") -> DataFrame:
    """The first record of each key in order; min_by keeps one row for each key and task, so a key of many rows is no burden."""
    names = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.min_by(F.struct(*names), F.col(order)).alias("_row"))
    return best.select(key, "_row.*").select(*records.columns)


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


#: Characters are counted modulo BINS, and runs of characters by GRAM_BINS hashes; sums of minima over bins are never under those over what is counted.
BINS, GRAM_BINS = 64, 512
#: From this length of its second text on, SequenceMatcher starts no block at a character that makes up over a hundredth of it.
POPULAR = 200
#: Lengths of the runs that are counted in shorter texts and in others; longest text whose counts fit 16 bits.
SHORT_RUN, RUN, COUNTED = 2, 8, 60_000
_MIX = 0x9E3779B97F4A7C15


class _Text:
    """A text in lower case and what bounds of the ratio need of it."""

    def __init__(self, text: str | None):
        self.low = (text or "").lower()
        self.size = len(self.low)
        self.codes = np.frombuffer(self.low.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._seen = None

    def runs(self, length: int) -> np.ndarray:
        """A hash of each run of so many characters, a power of two."""
        h, step, power = self.codes.astype(np.uint64) + np.uint64(1), 1, _MIX
        while step < length and len(h) > step:
            h = h[:-step] * np.uint64(power) + h[step:]
            step, power = 2 * step, power * power & (1 << 64) - 1
        return h * np.uint64(_MIX) if step >= length else np.empty(0, np.uint64)

    def counted(self) -> np.ndarray:
        return np.bincount(self.codes % BINS, minlength=BINS).astype(np.int32)

    def run_counts(self, length: int) -> np.ndarray:
        counts = np.bincount((self.runs(length) >> np.uint64(55)).astype(np.int64), minlength=GRAM_BINS)
        return np.minimum(counts, 65535).astype(np.uint16)

    def rare(self) -> int:
        """How many characters may start a block if this is the second text."""
        counts = np.unique(self.codes, return_counts=True)[1]
        return int(counts[counts <= self.size // 100 + 1].sum()) if self.size >= POPULAR else self.size

    def shares(self, other: str) -> int:
        """At least as many as the runs of RUN characters of the other text that are here too."""
        bits = np.uint64(64 - (16 if self.size < 8000 else 20))
        if self._seen is None:
            self._seen = np.zeros(1 << 64 - int(bits), bool)
            self._seen[self.runs(RUN) >> bits] = True
        return int(np.count_nonzero(self._seen[_Text(other).runs(RUN) >> bits]))


class _Kept:
    """Texts kept so far with counts, from which upper bounds of the ratio to all of them are taken at once.

    The ratio is twice the characters in matching blocks over both lengths. Blocks lie apart by a character of one text at least, so there is at most
    one more of them than unmatched characters. From POPULAR on, each has a rare character of the second text but for one at the very beginning.
    Runs of q characters shared are at least the matched characters less q - 1 for each block.
    """

    def __init__(self, runs: bool):
        self.texts: list[str] = []
        self.sizes, self.rare, self.counts = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros((256, BINS), np.int32)
        self.runs = np.zeros((256, GRAM_BINS), np.uint16) if runs else None

    def add(self, text: _Text) -> None:
        k = len(self.texts)
        if k == len(self.sizes):
            grown = lambda x: np.concatenate((x, np.zeros((k // 2, *x.shape[1:]), x.dtype)))
            self.sizes, self.rare, self.counts = grown(self.sizes), grown(self.rare), grown(self.counts)
            self.runs = grown(self.runs) if self.runs is not None else None
        self.sizes[k], self.rare[k], self.counts[k] = text.size, text.rare(), text.counted()
        if self.runs is not None:
            self.runs[k] = text.run_counts(SHORT_RUN if text.size < POPULAR else RUN)
        self.texts.append(text.low)

    def by_size(self, at: np.ndarray | None, text: _Text, threshold: float) -> np.ndarray:
        """Positions whose length alone leaves room for the threshold."""
        sizes = self.sizes[: len(self.texts)] if at is None else self.sizes[at]
        ok = np.flatnonzero(2 * np.minimum(sizes, text.size) >= (threshold - 1e-9) * (sizes + text.size))
        return ok if at is None else at[ok]

    def by_counts(self, at: np.ndarray, text: _Text, threshold: float) -> np.ndarray:
        """Those of the positions whose shared characters leave room, as in quick_ratio."""
        if not len(at):
            return at
        shared = np.minimum(self.counts[at], text.counted()).sum(1, dtype=np.int64)
        return at[2 * shared >= (threshold - 1e-9) * (self.sizes[at] + text.size)]

    def least_runs(self, at: np.ndarray, text: _Text, threshold: float) -> np.ndarray:
        """How many runs texts of the threshold share with each: of SHORT_RUN characters with shorter ones, else of RUN."""
        both = self.sizes[at] + text.size
        matched = (threshold - 1e-9) / 2 * both
        short = SHORT_RUN * matched - (SHORT_RUN - 1) * (both - matched + 1)
        return np.where(self.sizes[at] < POPULAR, short, matched - (RUN - 1) * (self.rare[at] + 1))

    def by_runs(self, at: np.ndarray, text: _Text, threshold: float) -> np.ndarray:
        """Those of the positions whose shared runs leave room."""
        if not len(at) or text.size > COUNTED:
            return at
        ok = self.sizes[at] > COUNTED
        for short in (True, False):
            of = np.flatnonzero((self.sizes[at] < POPULAR) == short)
            if len(of):
                shared = np.minimum(self.runs[at[of]], text.run_counts(SHORT_RUN if short else RUN)).sum(1, dtype=np.int64)
                ok[of] |= shared >= self.least_runs(at[of], text, threshold)
        return at[ok]

    def room(self, k: int, text: _Text, threshold: float) -> bool:
        """Whether the runs that the text at position k has in this one leave room; always if it is short."""
        return len(self.texts[k]) < POPULAR or text.low == self.texts[k] or text.shares(self.texts[k]) >= self.least_runs(np.array([k]), text, threshold)[0]

    def alike(self, k: int, text: _Text, threshold: float) -> bool:
        """Whether the ratio to the text at position k reaches the threshold; the longest common subsequence bounds it."""
        other = self.texts[k]
        if other == text.low:
            return True
        return 2 * _lcs(text.low, other) >= (threshold - 1e-9) * (text.size + len(other)) and _reaches(text.low, other, threshold)


def _any_alike(at: list[int], questions: _Kept, q: _Text, answers: _Kept, a: _Text, threshold: float) -> bool:
    sides = ((questions, q), (answers, a))
    return any(all(s.room(k, x, threshold) for s, x in sides) and all(s.alike(k, x, threshold) for s, x in sides) for k in at)


def near_duplicates_removed(records: DataFrame, threshold: float = 0.85, block: str = "paragraph_id") -> DataFrame:
    """Greedy and in order, as published: a record goes if a kept one of its paragraph is alike in whole question and answer. Null counts as empty.

    A paragraph is handled by one task, as each decision needs those before it; rows come to it sorted and it holds the kept ones. Exact upper bounds
    by length and by counts of characters and of runs of them leave most comparisons out.
    """

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, questions, answers = object(), None, None
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i in range(batch.num_rows):
                paragraph, q, a = batch.column(block)[i].as_py(), _Text(batch.column("question")[i].as_py()), _Text(batch.column("answer")[i].as_py())
                if questions is None or paragraph != current:
                    current, questions, answers = paragraph, _Kept(True), _Kept(False)
                at = answers.by_size(questions.by_size(None, q, threshold), a, threshold)
                at = questions.by_runs(questions.by_counts(at, q, threshold), q, threshold)
                at = answers.by_counts(at, a, threshold)
                keep[i] = not _any_alike(at.tolist(), questions, q, answers, a, threshold)
                if keep[i]:
                    questions.add(q)
                    answers.add(a)
            yield batch.filter(pa.array(keep))

    return records.repartition(block).sortWithinPartitions(block, "ord").mapInArrow(greedy, records.schema)


def _reaches(a: str, b: str, threshold: float) -> bool:
    """Whether ratio() of texts that are in lower case reaches the threshold: SequenceMatcher's blocks, the largest ranges first, until that is settled."""
    matcher, both, matched, room = difflib.SequenceMatcher(None, a, b), len(a) + len(b), 0, 0
    ranges: list[tuple[int, ...]] = []

    def push(*of: int) -> int:
        size = min(of[1] - of[0], of[3] - of[2])
        if size:
            heapq.heappush(ranges, (-size, *of))
        return size

    room += push(0, len(a), 0, len(b))
    while ranges and 2.0 * matched / both < threshold <= 2.0 * (matched + room) / both:
        size, alo, ahi, blo, bhi = heapq.heappop(ranges)
        room += size
        i, j, k = matcher.find_longest_match(alo, ahi, blo, bhi)
        if k:
            matched += k
            room += push(alo, i, blo, j) + push(i + k, ahi, j + k, bhi)
    return not both or 2.0 * matched / both >= threshold


def structural_issues(records: DataFrame) -> DataFrame:
    """ord and a list of what is wrong with a record's structure."""
    issues = [
        F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in ("question", "answer", "label", "paragraph_id")
    ] + [F.when(X.normalize_label(F.col("label")).isNull() & F.col("label").isNotNull(), F.lit("invalid label")), F.when(~F.col("quality_score").between(0, 1), F.lit("score out of range"))]
    return records.select("ord", F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("issues"))


def accepted_attempts(attempts: DataFrame, k: int) -> DataFrame:
    """Of each sentence the first attempt with at least half of k valid pairs: (sentence_id, attempt, valid)."""
    counted = attempts.groupBy("sentence_id", "attempt").agg(F.count_if("valid").alias("valid"))
    good = counted.filter(F.col("valid") >= 0.5 * k)
    first = Window.partitionBy("sentence_id").orderBy("attempt")
    return good.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
