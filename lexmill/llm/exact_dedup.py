"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

A batch is reduced to one row for each digest, the rows whose digests the index lacks are found by a sort-merge
anti-join against the bucketed table (which is not shuffled for it) and appended. Appending a batch again adds nothing.
Every batch adds a file to each bucket; beyond FILES of them a bucket's files are merged into one, in a folder beside the old
one, which counts once it is complete.

Null text counts as empty; empty texts form one group. An empty batch leaves the index as it is and gives no rows.
Rows that agree in doc_id and text tie fully: `mark` gives them the same answer, `deduplicate` keeps one of them.
Of equal texts within a batch the one with the most code points stays, then the smallest doc_id (a null doc_id is last).
A text that the index has from an earlier batch keeps the document of that batch, and the group_size that it had there: a batch
that comes again must change nothing. Texts of any length are hashed whole. Other columns are not looked at;
`deduplicate` returns them as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, keep_rows, lookup, scratch_path, scratch_table, shuffle_partitions, text_hash

#: The white space that normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"

KEYS = "doc_id bigint, n_points int, text_hash bigint, digest binary"
INDEX = "digest BINARY, keep_id BIGINT, keep_hash BIGINT, keep_rows BIGINT, group_size BIGINT"


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, code points, hash of the text as it is and SHA-256 of the normalised text of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint"),
        F.length(text).alias("n_points"),
        text_hash().alias("text_hash"),
        F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)).alias("digest"),
    )


#: Files of a bucket that an index lets come together before it merges them.
FILES = 16


class DigestIndex:
    """An external Parquet table in `buckets` buckets by digest, in the last complete generation under path; later sessions open it with the same arguments."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        self._open(self._generation())

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop.Path

    def _generation(self) -> int:
        """The greatest number of a complete generation; 0 if there is none."""
        files, path = self._files()
        if not files.exists(path(self.path)):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path(self.path))]
        numbers = [int(n.removeprefix("generation-")) for n in names if n.startswith("generation-")]
        return max((n for n in numbers if files.exists(path(f"{self.path}/generation-{n}/_SUCCESS"))), default=0)

    def _open(self, generation: int) -> None:
        self.generation, self.place = generation, f"{self.path}/generation-{generation}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._create(self.table, self.place)

    def _create(self, table: str, place: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({INDEX}) USING parquet LOCATION '{place}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def _append(self, rows: DataFrame, table: str, place: str) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").option("path", place).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def compact(self) -> None:
        """Merge the files of each bucket. Results that still read the old generation stay readable; the generation before it goes."""
        files, path = self._files()
        after, table = self.generation + 1, f"{self.table}_next"
        place = f"{self.path}/generation-{after}"
        files.delete(path(place), True)  # of a merge that was lost
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._create(table, place)
        self._append(self.read(), table, place)
        self.spark.sql(f"DROP TABLE {table}")
        files.delete(path(f"{self.path}/generation-{self.generation - 1}"), True)
        self._open(after)

    def _crowded(self) -> bool:
        files, path = self._files()
        return files.exists(path(self.place)) and files.getContentSummary(path(self.place)).getFileCount() > FILES * self.buckets

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, int]:
        """Append the digests of `batch` (rows of `keys`) that are new; returns the batch's groups and its number of rows."""
        rows = batch.groupBy("digest", "doc_id", "n_points", "text_hash").agg(F.count("*").alias("n"))
        best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus_id"), "text_hash", "n")).alias("best")
        groups = checkpoint(rows.groupBy("digest").agg(best, F.sum("n").alias("n_rows")))
        total = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        fresh = groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        kept = fresh.select(
            "digest",
            (-F.col("best.minus_id")).alias("keep_id"),
            F.col("best.text_hash").alias("keep_hash"),
            F.col("best.n").alias("keep_rows"),
            F.col("n_rows").alias("group_size"),
        )
        self._append(kept, self.table, self.place)
        if self._crowded():
            self.compact()
        return groups.select("digest", "n_rows"), total

    def mark(self, docs: DataFrame) -> DataFrame:
        """Ingest docs; one row for each row of docs with the document that stays for its text."""
        batch = checkpoint(keys(docs))
        groups, total = self.ingest(batch)
        found = self.read().hint("merge").join(groups.hint("merge"), "digest")
        return lookup(batch, found, "digest", "n_rows", total).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """Ingest docs; the rows of docs that stay, with all their columns."""
        batch = checkpoint(keys(docs))
        groups, _ = self.ingest(batch)
        kept = self.read().hint("merge").join(groups.hint("merge"), "digest")
        return keep_rows(docs, kept.select("keep_id", "keep_hash", "keep_rows"))


def open_index(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """The index at path, or a new one in the shared folder with as many buckets as the session has shuffle partitions."""
    index = DigestIndex(spark, path or scratch_path(spark, "digests"), buckets or shuffle_partitions(spark))
    if path is None:
        scratch_table(index.table)
    return index


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_index(spark).mark(documents(spark, sf_dir))


#: DuckDB SQL for op9_exact_dedup.
ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM k
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
