"""The catalogue and the inputs of its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, and what queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, use: tuple[str, ...] = ()):
    """Register a plan, and its DuckDB SQL with the named common table expressions before it."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = ("WITH " + ", ".join(CTE[u] for u in use) + " " if use else "") + sql.strip()
        return plan

    return register


#: DuckDB SQL of the derived inputs.
CTE = {
    "qa": """qa AS (
  SELECT d.doc_id AS ord, split_part(d.text, chr(10), 1) AS question, substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS answer,
    CASE WHEN l.quality IS NULL THEN 'maybe'
         WHEN l.quality = 1 THEN CASE d.doc_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN ' YES ' WHEN 2 THEN 'true' WHEN 3 THEN '1' WHEN 4 THEN 'Correct' ELSE 'y' END
         ELSE CASE d.doc_id % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'No' WHEN 2 THEN 'false' WHEN 3 THEN '0' WHEN 4 THEN 'incorrect' ELSE 'n' END END AS label,
    CAST(d.n_chars % 101 AS DOUBLE) / 100 AS quality_score, ' ' || d.source AS paragraph_id, d.lang AS language, d.text AS paragraph, split_part(d.text, '.', 1) AS sentence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "clean": r"""clean AS (
  SELECT *, md5(lower(trim(question)) || '|' || lower(trim(answer))) AS qa_hash FROM (
    SELECT ord, trim(regexp_replace(question, '\s+', ' ', 'g')) AS question, trim(regexp_replace(answer, '\s+', ' ', 'g')) AS answer,
      trim(regexp_replace(paragraph, '\s+', ' ', 'g')) AS paragraph, trim(regexp_replace(sentence, '\s+', ' ', 'g')) AS sentence,
      CASE WHEN lower(trim(label)) IN ('yes', 'y', 'true', '1', 'correct') THEN 'yes' WHEN lower(trim(label)) IN ('no', 'n', 'false', '0', 'incorrect') THEN 'no' END AS label,
      quality_score, trim(paragraph_id) AS paragraph_id, coalesce(lower(language), 'en') AS language
    FROM qa) WHERE label IS NOT NULL AND quality_score IS NOT NULL)""",
    "exam": """exam AS (
  SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'direct_answer' ELSE 'multiple_choice' END AS category, text AS question,
    string_split(text, ' ')[1:4] AS options, list_distinct(string_split(text, ' ')[1 + item_id % 3:2 + item_id % 3]) AS expected,
    CASE WHEN item_id % 7 = 0 THEN 'img' || item_id || '.png' END AS image
  FROM benchmark)""",
    "pred": """pred AS (
  SELECT 'model-' || (l_suppkey % 9) AS model, l_orderkey AS qid, l_linenumber AS opt_ord, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS y_true,
    CASE WHEN (l_partkey * 7 + l_linenumber) % 29 = 0 THEN 'invalid' WHEN l_returnflag = 'R' AND l_quantity > 15 THEN 'yes' WHEN l_returnflag <> 'R' AND l_quantity > 42 THEN 'yes' ELSE 'no' END AS y_pred,
    l_discount * 10 * 0.7 + CASE WHEN l_returnflag = 'R' THEN 0.25 ELSE 0 END AS score
  FROM lineitem)""",
    "ledger": """names AS (SELECT * FROM (VALUES (0, 'nlpaueb_bert-base-uncased-echr'), (1, 'nlpaueb_bert-base-uncased-eurlex'), (2, 'nlpaueb_bert-base-uncased-contracts'),
  (3, 'casehold_custom-legalbert'), (4, 'dlicari_Italian-Legal-BERT'), (5, 'google-bert_bert-base-uncased'), (6, 'nlpaueb_legal-bert-base-uncased'), (7, 'nlpaueb_legal-bert-small-uncased'), (8, 'avichr_Legal-heBERT')) t(k, base)),
ledger AS (
  SELECT event_id AS ord, ts, event_type AS setting, CAST((event_id * 7919 + user_id * 31) % 1000 AS DOUBLE) / 1000 AS f1_macro, CAST((event_id * 104729 + user_id * 17) % 1000 AS DOUBLE) / 1000 AS accuracy,
    CASE WHEN event_id % 4 = 0 THEN base ELSE base || '_m2m100_418M_clm_nsp_' || CASE user_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.3' ELSE '0.4' END || '_clu_' || CASE (user_id / 3)::BIGINT % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.1' ELSE '0.2' END
      || '_cls_' || CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.5' ELSE '0.6' END END AS model_name
  FROM events JOIN names ON k = user_id % 9)""",
    "parsed": """parsed AS (
  SELECT *, lower(replace(replace(replace(replace(replace(replace(CASE WHEN contains(model_name, '_clm_nsp_') THEN split_part(model_name, '_m2m100', 1) ELSE model_name END,
      'nlpaueb_', ''), 'google-bert_', ''), 'casehold_', ''), 'dlicari_', ''), 'avichr_', ''), '_', '-')) AS base,
    TRY_CAST(string_split(string_split(model_name, '_clm_nsp_')[2], '_')[1] AS DOUBLE) AS clm, TRY_CAST(string_split(string_split(model_name, '_clm_nsp_')[2], '_')[3] AS DOUBLE) AS clu,
    TRY_CAST(string_split(string_split(model_name, '_clm_nsp_')[2], '_')[5] AS DOUBLE) AS cls
  FROM ledger)""",
    "nodes": """nodes AS (
  SELECT 'r' || r_regionkey AS id, 'category' AS kind, r_name AS label, r_regionkey AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'paragraph', n_name, 1000 + n_nationkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'sentence', CASE WHEN s_suppkey % 11 = 0 THEN 'No Content' ELSE s_name END, 100000 + s_suppkey FROM supplier)""",
    "edges": """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'has_paragraph' AS relation FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'has_sentence' END FROM supplier)""",
    "vec": "vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
}


def qa(t: Tables) -> DataFrame:
    """Records of questions and answers: first line and rest of a document, its label in several spellings."""
    spell = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 6 + 1).cast("int"))
    label = F.when(F.col("quality").isNull(), "maybe").when(F.col("quality") == 1, spell("yes", " YES ", "true", "1", "Correct", "y")).otherwise(spell("no", "No", "false", "0", "incorrect", "n"))
    first = F.substring_index("text", "\n", 1)
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("ord"), first.alias("question"), F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("answer"), label.alias("label"),
        ((F.col("n_chars") % 101).cast("double") / 100).alias("quality_score"), F.concat(F.lit(" "), "source").alias("paragraph_id"), F.col("lang").alias("language"),
        F.col("text").alias("paragraph"), F.substring_index("text", ".", 1).alias("sentence"),
    )


def clean(t: Tables) -> DataFrame:
    from lexmill.operators.qa import normalized

    return normalized(qa(t))


def sides(t: Tables) -> DataFrame:
    """A record's whole texts: its source as reference, question and answer as candidate."""
    return clean(t).select("ord", F.concat_ws(" ", "paragraph", "sentence").alias("reference"), F.concat_ws(" ", "question", "answer").alias("candidate"))


def exam(t: Tables) -> DataFrame:
    """Exam questions: options and expected answers are words of a benchmark text."""
    parts = F.split("text", " ")
    return t.benchmark.select(
        F.col("item_id").alias("qid"), F.when(F.col("item_id") % 5 == 0, "direct_answer").otherwise("multiple_choice").alias("category"), F.col("text").alias("question"),
        F.slice(parts, 1, 4).alias("options"), F.array_distinct(F.slice(parts, (F.col("item_id") % 3 + 1).cast("int"), 2)).alias("expected"),
        F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("img"), F.col("item_id").cast("string"), F.lit(".png"))).alias("image"),
    )


def predictions(t: Tables) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    said = (
        F.when((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 29 == 0, "invalid")
        .when(returned & (F.col("l_quantity") > 15), "yes")
        .when(~returned & (F.col("l_quantity") > 42), "yes")
        .otherwise("no")
    )
    return t.lineitem.select(
        F.concat(F.lit("model-"), (F.col("l_suppkey") % 9).cast("string")).alias("model"), F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("opt_ord"),
        F.when(returned, "yes").otherwise("no").alias("y_true"), said.alias("y_pred"), (F.col("l_discount") * 10 * 0.7 + F.when(returned, 0.25).otherwise(0.0)).alias("score"),
    )


BASES = ("nlpaueb_bert-base-uncased-echr", "nlpaueb_bert-base-uncased-eurlex", "nlpaueb_bert-base-uncased-contracts", "casehold_custom-legalbert", "dlicari_Italian-Legal-BERT",
         "google-bert_bert-base-uncased", "nlpaueb_legal-bert-base-uncased", "nlpaueb_legal-bert-small-uncased", "avichr_Legal-heBERT")


def ledger(t: Tables) -> DataFrame:
    """Experiment rows: models named by their configuration, scored per event."""
    of = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    event, user = F.col("event_id"), F.col("user_id")
    base = of(BASES, user % 9)
    # DuckDB's user_id / 3 is rounded when it becomes an integer
    tuned = F.concat(base, F.lit("_m2m100_418M_clm_nsp_"), of(("0", "0.3", "0.4"), user % 3), F.lit("_clu_"), of(("0", "0.1", "0.2"), F.round(user / 3).cast("bigint") % 3), F.lit("_cls_"), of(("0", "0.5", "0.6"), event % 3))
    return t.events.select(
        event.alias("ord"), "ts", F.col("event_type").alias("setting"), (((event * 7919 + user * 31) % 1000).cast("double") / 1000).alias("f1_macro"),
        (((event * 104729 + user * 17) % 1000).cast("double") / 1000).alias("accuracy"), F.when(event % 4 == 0, base).otherwise(tuned).alias("model_name"),
    )


def parsed(t: Tables) -> DataFrame:
    from lexmill.functions.text import parse_model_config

    return ledger(t).withColumn("c", parse_model_config(F.col("model_name"))).select("*", "c.base", "c.clm", "c.clu", "c.cls").drop("c")


def nodes(t: Tables) -> DataFrame:
    named = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string")).alias("id")
    region = t.region.select(named("r", "r_regionkey"), F.lit("category").alias("kind"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("bigint").alias("ord"))
    nation = t.nation.select(named("n", "n_nationkey"), F.lit("paragraph").alias("kind"), F.col("n_name").alias("label"), (F.col("n_nationkey") + 1000).cast("bigint").alias("ord"))
    supplier = t.supplier.select(named("s", "s_suppkey"), F.lit("sentence").alias("kind"), F.when(F.col("s_suppkey") % 11 == 0, "No Content").otherwise(F.col("s_name")).alias("label"), (F.col("s_suppkey") + 100000).alias("ord"))
    return region.unionByName(nation).unionByName(supplier)


def edges(t: Tables) -> DataFrame:
    named = lambda mark, key, name: F.concat(F.lit(mark), F.col(key).cast("string")).alias(name)
    upper = t.nation.select(named("r", "n_regionkey", "src"), named("n", "n_nationkey", "dst"), F.lit("has_paragraph").alias("relation"))
    lower = t.supplier.select(named("n", "s_nationkey", "src"), named("s", "s_suppkey", "dst"), F.when(F.col("s_suppkey") % 13 != 0, "has_sentence").alias("relation"))
    return upper.unionByName(lower)


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
