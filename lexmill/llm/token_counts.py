"""Token counts: rollups by source, language and tokenizer version that are maintained from signed changes.

A batch of inserts, deletes and revised counts becomes signed rows, is summed by source, language and version, and written as
a draft in the ledger's folder. It counts once a small file of the batch's name says which draft is its own: that file is
created only if there is none, so of two committers one wins, and a batch that is given twice, or whose job is run again after it
was lost, counts once. Drafts that no file names are not read. The file keeps a digest of the sums: a name that comes again
with other sums is an error. Creating a file only if it is absent is atomic on HDFS and on stores with conditional writes.

Null text has no tokens; texts of any length are counted whole. Null source, language and version are groups of their own. A revision takes away the old count under
its old source, language and version and adds the new one, so rows may move between groups. Groups without documents left
are not reported. Empty batches commit nothing but their name. Repeated rows count each. Extra columns are not read. A group may hold any share
of the rows: sums are partial before they are shuffled.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, scratch_path
from .tokens import BYTE_BPE, byte_bpe, encode, tokenizer_path

GROUP = ["source", "lang", "version"]
COMMIT = "source string, lang string, version string, documents bigint, tokens bigint"
COMMIT_COLUMNS = [*GROUP, "documents", "tokens"]


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows for counts (source, lang, version, tokens) that are new."""
    return counts.select(*GROUP, F.lit(1).cast("bigint").alias("documents"), F.col("tokens").cast("bigint"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows for counts that no longer hold."""
    return counts.select(*GROUP, F.lit(-1).cast("bigint").alias("documents"), (-F.col("tokens")).cast("bigint").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows for counts `old` that become `new`; each has a row for each document."""
    return deletes(old).unionByName(inserts(new))


class Ledger:
    """Committed batches under a folder: drafts in `data`, the batches' files in `commits`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop.Path

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("batch string, draft string, digest string").json(f"{self.path}/commits")

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False if it is there already. A batch of its name with other sums is a ValueError."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"a batch's name must be usable for a file: {batch!r}")
        files, path = self._files()
        final = path(f"{self.path}/commits/{batch}")
        totals = signed.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 OR tokens <> 0")
        if files.exists(final):
            self._check(batch, _digest(totals))
            return False
        draft = f"d{uuid.uuid4().hex}"
        folder = f"{self.path}/data/draft={draft}"
        totals.write.parquet(folder)
        digest = _digest(self.spark.read.schema(COMMIT).parquet(folder))
        try:
            stream = files.create(final, False)
            stream.write(bytearray(json.dumps({"batch": batch, "draft": draft, "digest": digest}).encode()))
            stream.close()
        except Py4JJavaError:
            files.delete(path(folder), True)
            if not files.exists(final):
                raise
            self._check(batch, digest)  # another committer was first
            return False
        return True

    def _check(self, batch: str, digest: str) -> None:
        known = self._commits().filter(F.col("batch") == batch).first()
        if known["digest"] != digest:
            raise ValueError(f"batch {batch!r} is committed with other sums")

    def totals(self) -> DataFrame:
        files, path = self._files()
        if not files.exists(path(f"{self.path}/commits")):
            return self.spark.createDataFrame([], COMMIT)
        rows = self.spark.read.schema(f"{COMMIT}, draft string").parquet(f"{self.path}/data")
        rows = rows.join(self._commits().select("draft").hint("merge"), "draft", "left_semi")
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0")


def _digest(totals: DataFrame) -> str:
    """Rows and a hash of them in any order."""
    row = totals.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*COMMIT_COLUMNS)), F.lit(0))).first()
    return f"{row[0]}:{row[1]}"


def counted(docs: DataFrame, path: str) -> DataFrame:
    """source, lang, n_words and n_bpe of every row: words between white space and byte-level BPE ids of the whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for batch in batches:
            words, ids = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                words.append(len(text.encode().split()))
                ids.append(len(encode(encoder, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.int64()), pa.array(ids, pa.int64())], names=["source", "lang", "n_words", "n_bpe"])

    return docs.select(docs["source"], docs["lang"], docs["text"]).mapInArrow(rows, "source string, lang string, n_words bigint, n_bpe bigint")


def token_report(docs: DataFrame) -> DataFrame:
    """All documents come in with word counts under two versions; then the estimate is revised to BPE counts; the first batch comes twice."""
    spark = docs.sparkSession
    counts = materialize(counted(docs, tokenizer_path(BYTE_BPE)), "counts")
    of = lambda version, n: counts.select("source", "lang", F.lit(version).alias("version"), F.col(n).alias("tokens"))
    words, estimate, exact = of("words-1", "n_words"), of("estimate-0", "n_words"), of("byte_bpe_50k", "n_bpe")
    ledger = Ledger(spark, scratch_path(spark, "token-ledger"))
    load = inserts(words).unionByName(inserts(estimate))
    ledger.commit("load", load)
    ledger.commit("revise", revisions(estimate, exact))
    ledger.commit("load", load)
    return ledger.totals()


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(documents(spark, sf_dir))
