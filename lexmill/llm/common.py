"""What the operators of this package share: inputs, shared scratch space and skew-safe lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import also_drop, shared_folder

#: A group is hot if it holds more than 1/HOT_PARTS of all rows, so there are fewer than HOT_PARTS hot groups.
HOT_PARTS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Paths and tables that operators of this process have made for their results.
_scratch: list[str] = []
_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _scratch.append(f"{shared_folder(spark)}/lexmill-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def scratch_table(name: str) -> str:
    """A table's name that drop_scratch removes."""
    _tables.append(name)
    return name


def drop_scratch(spark: SparkSession) -> int:
    """Remove what operators have left in the shared folder; to be called once their results are written. Returns the number of paths.

    Results that are still lazy read these files. An index or ledger at a path of the caller's own stays.
    """
    for table in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = 0
    for text in _scratch:
        path = hadoop.Path(text)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _tables.clear()
    _scratch.clear()
    return gone


also_drop(drop_scratch)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later plans start from the files, not from df's lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder; Spark removes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with table on key, where table has one row for each key and size tells how many of the total rows have it.

    Hot keys come from a broadcast of fewer than HOT_PARTS rows of the table, so that no task gets all rows of a key;
    the others meet in a sort-merge join. A null key finds nothing and its rows are dropped, as in an inner join.
    """
    hot = table.filter(F.col(size) * HOT_PARTS > total)
    cold = table.filter(F.col(size) * HOT_PARTS <= total)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    )


def text_hash() -> Column:
    """With doc_id it tells rows of a table apart, but for rows that repeat."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_rows(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that keepers (keep_id, keep_hash, keep_rows) name; one of those that repeat.

    The join's key tells rows apart, so a group of copies brings one row to it and not all of them.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("bigint").alias("id"), text_hash().alias("hash"))
    rows = rows.join(keepers, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash")))
    again = rows.filter("keep_rows > 1").groupBy("id", "hash").agg(F.first("row").alias("row"))
    return rows.filter("keep_rows = 1").select("row").unionByName(again.select("row")).select("row.*")
