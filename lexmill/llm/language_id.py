"""Language identification with error-correcting output codes.

Each language has a codeword; a logistic classifier over hashed byte n-grams predicts each of its bits. Decoding takes the
codeword with the least loss, each bit weighted by what its classifier reached on rows kept back from its training, and
flags a text as ambiguous if two codewords are close or if the hard bits are further off than the code can correct.

The classifiers are fitted on labelled rows of every language, the first of each by a hash of doc_id and text: at most
PER_LANGUAGE distinct rows, or fewer if that makes more than SAMPLE rows of all languages, but at least one of each; everything
else reads all rows and whole texts. Rows without text are not learned from. Null text and text without letters give `und`, score 0,
not ambiguous; so does every text if there are no labelled rows. Rows with a null doc_id are never learned from and count
as held out. Ids may repeat. Repeated rows are learned once; each gets its answer; ties in loss go to the language that sorts first. Extra columns are not
read; `keep_identified` returns them as they are.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lookup

PER_LANGUAGE, SAMPLE, FEW = 300, 12_000, 30
#: Languages up to which their thresholds, and sampled rows up to which these, are broadcast.
BROADCAST_LANGUAGES, BROADCAST_ROWS = 10_000, 50_000
DIMENSIONS, STEPS, RATE, DECAY, CLOSE, REJECT = 4096, 250, 2.0, 1e-4, 1.0, 0.5
UNKNOWN = "und"
BLOCK, BLOCK_ROWS = 1 << 20, 1024

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def counts(raw: bytes) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams of folded bytes; runs of anything but letters count as one space."""
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw), BLOCK):
        a = _FOLD[np.frombuffer(raw, np.uint8, min(BLOCK + 2, len(raw) - at), at)]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
        a = a[keep]
        two = a[:-1] << np.uint32(8) | a[1:]
        three = two[:-1] << np.uint32(8) | a[2:]
        for gram, salt in ((a, 0x9E3779B1), (two, 0x85EBCA6B), (three, 0xC2B2AE35)):
            total += np.bincount((gram + np.uint32(1)) * np.uint32(salt) >> np.uint32(20), minlength=DIMENSIONS)
    return total


def features(raw: bytes) -> np.ndarray:
    x = np.sqrt(counts(raw)).astype(np.float32)
    return x / max(1e-6, float(np.linalg.norm(x)))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: the exhaustive code up to 6 classes, beyond that seeded random columns."""
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c] or [(1,)]
        return np.array(columns, np.float32).T
    draw = np.random.default_rng(7)
    width = 10 * int(np.ceil(np.log2(n)))
    return max((np.where(draw.random((n, width)) < 0.5, -1, 1).astype(np.float32) for _ in range(20)), key=closest)


def closest(code: np.ndarray) -> int:
    """Bits in which the two closest of the codewords differ; 1 if there is just one."""
    n, width = code.shape
    least = width if n > 1 else 1
    for at in range(0, n, BLOCK_ROWS):
        alike = code[at : at + BLOCK_ROWS] @ code.T
        alike[np.arange(len(alike)), at + np.arange(len(alike))] = -width
        least = min(least, int(width - alike.max()) // 2)
    return least


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    #: Bits in which the two closest codewords differ.
    apart: int = 1

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the decision is ambiguous."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        margin = features(text.encode()) @ self.weights + self.bias
        loss = (np.logaddexp(0, -self.code * margin) * self.bit_weight).sum(1)
        order = np.argsort(loss, kind="stable")
        likely = np.exp(loss[order[0]] - loss)
        score = float(1 / likely.sum())
        if len(order) == 1:
            return self.languages[0], score, False
        wrong = (np.sign(margin) != self.code[order[0]]).sum()
        return self.languages[order[0]], score, bool(loss[order[1]] - loss[order[0]] < CLOSE or wrong > (self.apart - 1) // 2)


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    """Fit a classifier for each bit; every fourth row of a language is kept back to weigh the bits."""
    places = {lang: k for k, lang in enumerate(sorted({lang for lang, _ in rows}))}
    languages = list(places)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    code = codewords(len(languages))
    x = np.stack([v for _, v in rows]).astype(np.float32)
    y = code[[places[lang] for lang, _ in rows]]
    seen = Counter()
    back = np.zeros(len(rows), bool)
    for k, (lang, _) in enumerate(rows):
        back[k] = seen[lang] % 4 == 3
        seen[lang] += 1
    fit_x, fit_y = x[~back], y[~back]
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moved_w, moved_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        pull = -fit_y / (1 + np.exp(np.clip(fit_y * (fit_x @ w + b), -30, 30))) / len(fit_x)
        moved_w = 0.9 * moved_w - 10 * RATE * (fit_x.T @ pull + DECAY * w)
        moved_b = 0.9 * moved_b - RATE * pull.sum(0)
        w, b = w + moved_w, b + moved_b
    right = (np.sign(x[back] @ w + b) == y[back]).mean(0) if back.any() else np.ones(len(b))
    return Model(languages, code, w, b, np.clip(2 * right - 1, 0.05, 1).astype(np.float32), closest(code))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _sample(docs: DataFrame) -> DataFrame:
    """lang, rank and text of the rows to learn from: of each language those with the least hashes of doc_id and text."""
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", rank.alias("rank"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("rank").alias("distinct"), F.count("*").alias("n"))
    languages, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    # Hashes of distinct rows are even over 64 bits, so this share of them holds about twice the rows that are wanted, whatever
    # the table's size, and some rows for sure of a language of few. What is left to be ranked is small.
    share = F.least(F.lit(1.0), F.lit(2.0 * max(each, FEW)) / F.col("distinct"))
    below = sizes.select("lang", (share * 2.0**64 - 2.0**63).alias("below"), "n")
    ranks = known.select("lang", "rank")
    ranks = ranks.join(F.broadcast(below), "lang") if languages <= BROADCAST_LANGUAGES else lookup(ranks, below, "lang", "n", total)
    top = Window.partitionBy("lang").orderBy("rank")
    chosen = ranks.filter("rank <= below").select("lang", "rank").distinct().withColumn("n", F.row_number().over(top)).filter(F.col("n") <= each).select("lang", "rank")
    chosen = F.broadcast(chosen) if languages * each <= BROADCAST_ROWS else chosen.hint("merge")
    return known.join(chosen, ["lang", "rank"]).dropDuplicates(["lang", "rank"])


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded sample of the rows that are not held out."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.encode()).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(x, pa.binary())], names=["lang", "rank", "x"])

    # At most SAMPLE rows of 8 KB come to the driver, or one of each language.
    found = _sample(docs).select("lang", "rank", "text").mapInArrow(vectors, "lang string, rank bigint, x binary").collect()
    rows = sorted(found, key=lambda r: (r["rank"], r["lang"], bytes(r["x"])))
    return train([(r["lang"], np.frombuffer(r["x"], np.float16)) for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for every row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(rows, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, but those without letters and those whose best codeword has a score under REJECT."""

    @F.pandas_udf("boolean")
    def clear(texts):
        said = map(model.predict, texts)
        return texts.__class__([lang != UNKNOWN and score >= REJECT for lang, score, _ in said], dtype="bool")

    return docs.filter(clear(docs["text"]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
