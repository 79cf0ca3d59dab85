"""Readers with explicit schemas. Each has a part that parses texts, for tables of lines, and one that reads paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAM = "id string, category string, question string, options array<string>, answers array<string>, image string, heading string, explanation string"
EXAM_AT = "FRAGEID string, THEMAID string, SCHWIERIGID string, BildName string, FrageText map<string,string>, AntwortText map<string,array<struct<Text:string>>>, AntwortRichtig array<boolean>"
RECORD = "question string, answer string, label string, quality_score double, paragraph_id string, paragraph string, sentence string, language string"
STATUTE = "array<struct<category:string,paragraphs:array<struct<paragraph:string,paragraph_id:string,sentences:array<map<string,string>>>>>>"


def exam_questions(rows: DataFrame, skip_category: str | None = "direct_answer", skip_images: bool = True) -> DataFrame:
    """Exam rows with defaults for missing fields; rows with an image or of the skipped category go."""
    if skip_images:
        rows = rows.filter("image IS NULL")
    if skip_category is not None:
        rows = rows.filter(F.coalesce("category", F.lit("")) != skip_category)
    none = F.array().cast("array<string>")
    return rows.select(
        F.coalesce("id", F.lit("")).alias("id"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("question", F.lit("No question provided")).alias("question"),
        F.coalesce("options", none).alias("options"), F.coalesce("answers", none).alias("expected"), "image", "heading", "explanation",
    )


def read_german(spark: SparkSession, path: str, **how) -> DataFrame:
    return exam_questions(spark.read.schema(EXAM).json(path, multiLine=True), **how)


def read_irish(spark: SparkSession, path: str, skip_images: bool = True) -> DataFrame:
    return exam_questions(spark.read.schema(EXAM).json(path, multiLine=True), None, skip_images)


def austrian_questions(rows: DataFrame, language: str = "de", skip_images: bool = True) -> DataFrame:
    """One object a row: texts by language, answers with their flags up to the shorter list. Missing texts are empty.

    The published reader lets the answers of the file before leak into a file without texts; here it has none.
    """
    if skip_images:
        rows = rows.filter("BildName IS NULL OR BildName = ''")
    none = F.array().cast("array<struct<Text:string>>")
    answers, flags = F.coalesce(F.col("AntwortText")[language], none), F.coalesce("AntwortRichtig", F.array().cast("array<boolean>"))
    n = F.least(F.size(answers), F.size(flags))
    paired = F.zip_with(F.slice(answers, 1, n), F.slice(flags, 1, n), lambda a, f: F.struct(a["Text"].alias("text"), f.alias("correct")))
    return rows.select(
        F.col("FRAGEID").alias("id"), F.coalesce(F.col("FrageText")[language], F.lit("")).alias("question"), F.transform(paired, lambda p: p["text"]).alias("options"),
        F.transform(F.filter(paired, lambda p: p["correct"]), lambda p: p["text"]).alias("expected"),
    )


def read_austrian(spark: SparkSession, folder: str, files: str = "*.json", **how) -> DataFrame:
    return austrian_questions(spark.read.schema(EXAM_AT).option("pathGlobFilter", files).json(folder, multiLine=True), **how)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def parse_jsonl(lines: DataFrame, column: str = "value", schema: str = RECORD) -> DataFrame:
    """Rows of JSON lines: blank lines are skipped, malformed ones have only _corrupt_record."""
    full = F.filter(F.array(F.col(column)), lambda x: F.trim(x) != "")
    parsed = F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter(F.size(full) > 0).withColumn("_r", parsed).select(*[c for c in lines.columns if c != column], "_r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The well-formed lines."""
    return parse_jsonl(spark.read.text(path), "value", schema).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def repaired(line: Column, schema: str = RECORD) -> Column:
    """A JSON line that is cut off: the longest prefix that ends in `}` within its last 1000 characters and parses; null if none does."""
    back = F.filter(F.sequence(F.lit(0), F.least(F.lit(1000), F.length(line))), lambda k: F.substring(line, F.length(line) - k, F.lit(1)) == "}")
    tried = F.transform(back, lambda k: F.from_json(F.substring(line, F.lit(1), F.length(line) - k), schema))
    whole = F.from_json(line, schema)
    first = lambda s: F.to_json(s) != "{}"
    return F.when(first(whole), whole).otherwise(F.get(F.filter(tried, first), F.lit(0)))


def read_jsonl_repaired(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(repaired(F.col("value"), schema).alias("r")).filter("r IS NOT NULL").select("r.*")


def read_json_or_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines, by the first character that is no white space; `label` becomes next_sentence_labels."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    rows = spark.read.schema(schema).json(path, multiLine=True) if first and first["c"] == "[" else spark.read.schema(schema).json(path)
    return rows.withColumnRenamed("label", "next_sentence_labels")


def parse_triples(lines: DataFrame, column: str = "value", delimiter: str = "<tr>") -> DataFrame:
    """lines with status (valid, malformed, empty, skipped) and, where valid, h, r and t."""
    text = F.trim(column)
    parts = F.transform(F.split(F.col(column), F.lit(f"\\Q{delimiter}\\E")), lambda p: F.trim(p))
    status = (
        F.when((text == "") | F.startswith(text, F.lit("#")), "skipped")
        .when(F.size(parts) != 3, "malformed")
        .when(F.exists(parts, lambda p: p == ""), "empty")
        .otherwise("valid")
    )
    rows = lines.withColumn("status", status).withColumn("_p", F.when(F.col("status") == "valid", parts))
    return rows.select(*[c for c in lines.columns if c != column], "status", *[F.get("_p", F.lit(i)).alias(k) for i, k in enumerate("hrt")])


def read_triples(spark: SparkSession, path: str, delimiter: str = "<tr>") -> DataFrame:
    return parse_triples(spark.read.text(path), "value", delimiter).filter("status = 'valid'").select("h", "r", "t")


def statute_sentences(rows: DataFrame, column: str = "tree") -> DataFrame:
    """A column of statute trees as sentences: the first entry of each sentence map, longer than 20 characters when trimmed."""
    paragraphs = rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias("c")).select("*", F.explode("c.paragraphs").alias("p"))
    each = paragraphs.select("*", F.posexplode("p.sentences").alias("sen_ord", "s"))
    entry = F.get(F.map_entries("s"), F.lit(0))
    kept = [c for c in rows.columns if c != column]
    flat = each.select(*kept, F.col("c.category").alias("category"), F.col("p.paragraph_id").alias("paragraph_id"), F.col("p.paragraph").alias("paragraph"), "sen_ord", entry["key"].alias("sen_id"), entry["value"].alias("text"))
    return flat.filter(F.length(F.trim("text")) > 20)


def embedding_rows(rows: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects of vectors as (id, v)."""
    return rows.select(F.explode(F.from_json(column, "map<string,array<float>>")).alias("id", "v"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return embedding_rows(spark.read.text(path, wholetext=True))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a ledger, columns by name, types inferred; a batch that lacks a column has nulls. A path without batches is an error.

    Batches are experiments that people append, so there are few; the driver lists their folders.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in files.listStatus(hadoop.Path(path)) if s.getPath().getName().startswith("batch="))
    found = [spark.read.csv(name, header=True, inferSchema=True) for name in names]
    if not found:
        raise ValueError(f"no batches in {path}")
    rows = found[0]
    for batch in found[1:]:
        rows = rows.unionByName(batch, allowMissingColumns=True)
    return rows


def read_run_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """metadata.json files with the model folder they lie in; missing files are no error, they just give no rows."""
    schema = "num_entities bigint, num_relations bigint, embedding_dim bigint, losses struct<train:double,val:double>"
    files = spark.read.schema(schema).option("multiLine", True).json(pattern)
    losses = [F.col(f"losses.{k}").alias(f"{k}_loss") for k in ("train", "val")]
    return files.select("num_entities", "num_relations", "embedding_dim", *losses, _folder(-2).alias("model"))


def _folder(place: int) -> Column:
    """A part of the path of the file that a row comes from; of a partition's folder the value."""
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), place), "^[A-Za-z_]+=", "")


def read_seed_results(spark: SparkSession, pattern: str) -> DataFrame:
    """`model/seed_n/all_results.json` files with model and seed from the path."""
    files = spark.read.schema("eval_macro double, eval_micro double, test_macro double, test_micro double").option("multiLine", True).json(pattern)
    return files.select("eval_macro", "eval_micro", "test_macro", "test_micro", _folder(-3).alias("model"), F.regexp_extract(_folder(-2), r"seed_(\d+)", 1).cast("int").alias("seed"))


def model_folders(spark: SparkSession, root: str, marker: str = "config.json") -> DataFrame:
    """Folders right under root that hold a file (or a partition's folder) of the marker's name. Contents of files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.split(F.regexp_replace("path", ".*" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", ""), "/")
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z_]+=", "")
    return files.filter(F.exists(below, lambda p: plain(p) == marker)).select(plain(below[0]).alias("model")).distinct()


def fetched_pages(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """Of a crawler's attempts (url, attempt from 1, status, html) a row for each url: the first that worked among so many, or else no html and the last status."""
    tried = attempts.filter(F.col("attempt") <= retries)
    good = (F.col("status") >= 200) & (F.col("status") < 300)
    first = F.min_by(F.struct("status", "html", "attempt"), F.when(good, F.col("attempt")))
    last = F.max_by(F.struct("status", F.lit(None).cast("string").alias("html"), "attempt"), "attempt")
    return tried.groupBy("url").agg(F.coalesce(first, last).alias("r")).select("url", "r.status", "r.html", "r.attempt", F.col("r.html").isNotNull().alias("fetched"))


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that a crawler has stored (url, html): fetching and its retries stand outside the engine."""
    return spark.read.parquet(path).select("url", "html")


def court_sections(html: Column) -> Column:
    """tenor, tatbestand, entscheidungsgruende and legal_references of a decision, by the places of its headers."""
    from lexmill.functions.text import statutory_references

    text = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    part = lambda pattern: F.trim(F.regexp_extract(text, pattern, 1))
    return F.struct(
        part(r"(?s)Tenor(.*?)Tatbestand").alias("tenor"), part(r"(?s)Tatbestand(.*?)Entscheidungsgründe").alias("tatbestand"),
        part(r"(?s)Entscheidungsgründe(.*)$").alias("entscheidungsgruende"), statutory_references(text).alias("legal_references"),
    )


def html_lines(html: Column) -> Column:
    """Text of a page in one line: tags gone, blank lines and lines with a link left out."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""), "<[^>]+>", "\n")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.contains(x, F.lit("http")))
    return F.array_join(lines, " ")
