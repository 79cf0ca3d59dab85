"""Writers, and the texts they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; the helper column qa_hash stays out."""
    df.drop("qa_hash").write.mode(mode).json(path)


def append_ledger(new: DataFrame, path: str) -> None:
    """New rows as a further batch of a CSV ledger, in a folder of its own; `read_ledger` matches columns by name."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    number = len(files.listStatus(hadoop.Path(path))) if files.exists(hadoop.Path(path)) else 0
    new.write.option("header", True).csv(f"{path}/batch={number:06d}")


def write_lines(df: DataFrame, column: str, path: str, order: list[str] | None = None) -> None:
    rows = df.orderBy(*order) if order else df
    rows.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Vectors as Parquet (checkpoints of models stay outside)."""
    df.select("id", "v").write.parquet(path)


def nested(rows: DataFrame, group: list[str], order: str, item: Column, name: str) -> DataFrame:
    """Rows of a group as an array in order."""
    earlier = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("_i"))), earlier), lambda e: e["_i"])
    return rows.groupBy(*group).agg(listed.alias(name))


def statute_json(sentences: DataFrame) -> DataFrame:
    """category and a JSON text of its paragraphs with their sentences, each a map of one entry."""
    paragraphs = nested(sentences, ["category", "paragraph_id", "paragraph"], "ord", F.create_map("sen_id", "text"), "sentences").withColumn("_first", F.col("paragraph_id"))
    categories = nested(paragraphs, ["category"], "_first", F.struct("paragraph", "paragraph_id", "sentences"), "paragraphs")
    return categories.select("category", F.to_json(F.struct("category", "paragraphs")).alias("json"))


def tree_text(rows: DataFrame, group: str, order: str, line: Column) -> DataFrame:
    """Lines of a group in order, trimmed, without blank lines and those with a link, in one line."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.trim(line).alias("_t")))), lambda e: e["_t"])
    return rows.groupBy(group).agg(F.array_join(F.filter(listed, lambda x: (x != "") & ~F.contains(x, F.lit("http"))), " ").alias("text"))


def write_report(title: str, rows: DataFrame, name: str, value: str, path: str) -> None:
    """A report of a small result (a row for each line) as one text file."""
    text = markdown_report(title, {r[name]: r[value] for r in rows.orderBy(name).collect()})
    rows.sparkSession.createDataFrame([(line,) for line in text.rstrip("\n").split("\n")], "value string").coalesce(1).write.text(path)


def markdown_report(title: str, figures: dict[str, object]) -> str:
    """A report of the figures of a one-row result."""
    return "\n".join([f"# {title}", "", *[f"- **{k}**: {v}" for k, v in figures.items()], ""])


def annotation_rows(records: DataFrame) -> DataFrame:
    """Rows for human annotators: numbered from 1, paragraphs cut to 500 characters, empty columns to fill in."""
    from lexmill.operators.order import global_index

    numbered = global_index(records, [F.col("ord")], "_n")
    short = F.when(F.length("paragraph") > 500, F.concat(F.substring("paragraph", 1, 500), F.lit("..."))).otherwise(F.col("paragraph"))
    return numbered.select((F.col("_n") + 1).alias("sample_id"), "question", "answer", "label", short.alias("paragraph"), *[F.lit("").alias(c) for c in ("correct", "relevant", "comment")])
