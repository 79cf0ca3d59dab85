"""Extension points with stand-ins for models, and what the engine hands to the outside (X01 to X09, SRC09, SRC15, SRC20, SNK10, SNK13, SNK14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import boundary as B
from lexmill.operators import metrics as M
from lexmill.operators import sequences as S
from lexmill.sources import html as H
from lexmill.sources import readers as R
from lexmill.sources import writers as W
from lexmill.session import landing_folder

from .base import CTE, clean, exam, ledger, predictions, query, vectors
from .measures import _C, _COUNTS

L = F.lit


@query("src09_landed_pages", "SELECT url, length(html) AS n FROM pages")
def _(t):
    return R.landed_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("url", F.length("html").cast("bigint").alias("n"))


@query(
    "src09_fetch_attempts",
    """SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 200 ELSE 503 END AS status, CASE WHEN page_id % 4 < 3 THEN page_id % 4 + 1 ELSE 3 END AS attempt, page_id % 4 < 3 AS fetched,
      CASE WHEN page_id % 4 < 3 THEN length(html) END AS n FROM pages""",
)
def _(t):
    # A page fails as often as its number says; the fourth attempt would work, but three are the limit.
    tries = t.pages.select("page_id", "html", F.explode(F.array(*[L(k) for k in (1, 2, 3, 4)])).alias("attempt")).filter(F.col("attempt") <= F.col("page_id") % 4 + 1)
    done = F.col("attempt") == F.col("page_id") % 4 + 1
    attempts = tries.select(F.col("page_id").alias("url"), "attempt", F.when(done, 200).otherwise(503).alias("status"), F.when(done, F.col("html")).alias("html"))
    return R.fetched_pages(attempts).select(F.col("url").alias("page_id"), "status", F.col("attempt").cast("bigint").alias("attempt"), "fetched", F.length("html").cast("bigint").alias("n"))


CTE["stream"] = """stream AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS place, length(w) AS token FROM (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents)))"""


@query("src15_text_blocks", "SELECT place // 64 AS block, sum(token)::BIGINT AS total FROM stream WHERE place // 64 < (SELECT count(*) // 64 FROM stream) GROUP BY 1", ("stream",))
def _(t):
    # The tokenizer stands outside: here a word's id is its length.
    tokens = t.documents.select("doc_id", F.posexplode(X.words(F.col("text"))).alias("i", "w")).select("doc_id", "i", F.length("w").cast("bigint").alias("token"))
    return S.token_blocks(tokens, [F.col("doc_id"), F.col("i")], 64).select("block", F.aggregate("ids", L(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("src20_model_folders", "SELECT DISTINCT 'm' || s_nationkey AS model FROM supplier WHERE s_suppkey % 3 = 0")
def _(t):
    # Folders of models; those without a config.json are none.
    rows = t.supplier.select(F.concat(L("m"), F.col("s_nationkey").cast("string")).alias("model"), F.when(F.col("s_suppkey") % 3 == 0, "config.json").otherwise("weights.bin").alias("file")).distinct()
    path = landing_folder(t.spark, "models")
    rows.withColumn("value", L("{}")).write.partitionBy("model", "file").text(path)
    return R.model_folders(t.spark, path, "config.json")


@query("src21_images", "SELECT 'http://example.org/' || image AS url, 'image of ' || image AS body FROM exam WHERE image IS NOT NULL", ("exam",))
def _(t):
    # The fetcher stands outside; here it answers with a text.
    urls = exam(t).filter("image IS NOT NULL").select(F.concat(L("http://example.org/"), "image").alias("url"))
    return B.memoised_apply(urls, "url", lambda found: ["image of " + u.rsplit("/", 1)[1] for u in found], "body")


@query("n16_reduced", "SELECT id, round(v[1] + v[2], 6) AS x, round(v[3] - v[4], 6) AS y FROM vec", ("vec",))
def _(t):
    # t-SNE and UMAP stand outside; here a projection of four coordinates takes their place.
    return B.reduced(vectors(t), lambda m: m[:, [0, 2]] + m[:, [1, 3]] * [1, -1]).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("snk10_report_lines", "SELECT '- **' || label || '**: ' || count(*) AS line FROM clean GROUP BY label UNION ALL SELECT '# Labels' UNION ALL SELECT ''", ("qa", "clean"))
def _(t):
    path = landing_folder(t.spark, "report")
    W.write_report("Labels", clean(t).groupBy("label").agg(F.count("*").alias("n")), "label", "n", path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("snk13_embedding_table", "SELECT id, len(v) AS width, round(list_sum(v), 6) AS total FROM vec", ("vec",))
def _(t):
    path = landing_folder(t.spark, "vectors")
    W.write_embeddings(vectors(t), path)
    return t.spark.read.parquet(path).select("id", F.size("v").cast("bigint").alias("width"), F.round(F.aggregate("v", L(0.0), lambda a, x: a + x), 6).alias("total"))


@query("snk14_plot_data", "SELECT setting, round(avg(f1_macro), 6) AS height, round(stddev_samp(f1_macro), 6) AS bar FROM ledger GROUP BY setting", ("ledger",))
def _(t):
    return ledger(t).groupBy("setting").agg(F.round(F.avg("f1_macro"), 6).alias("height"), F.round(F.stddev_samp("f1_macro"), 6).alias("bar"))


@query("x01_row_function", "SELECT s_suppkey, lower(s_name) AS name FROM supplier")
def _(t):
    return B.memoised_apply(t.supplier, "s_name", lambda texts: [x.lower() for x in texts], "name").select("s_suppkey", "name")


@query("x02_token_count", "SELECT ord, CASE WHEN sentence = '' THEN 0 ELSE len(string_split(sentence, ' ')) END AS n_tokens FROM clean", ("qa", "clean"))
def _(t):
    return B.token_count(clean(t), "sentence", lambda texts: [x.split() for x in texts]).select("ord", F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query("x03_generate", "SELECT qid, 'echo ' || CAST(qid AS VARCHAR) AS response FROM (SELECT item_id AS qid FROM benchmark)")
def _(t):
    rows = t.benchmark.select(F.col("item_id").alias("qid"), F.col("item_id").cast("string").alias("prompt"))
    return B.generate(rows, "prompt", lambda prompts: [f"echo {p}" for p in prompts]).select("qid", "response")


@query("x04_translate", "SELECT s_suppkey, '__PARAGRAPH_SIGN__ ' || upper(s_name) AS shown FROM supplier")
def _(t):
    rows = t.supplier.select("s_suppkey", X.protect(F.concat(L("§ "), "s_name")).alias("safe"))
    return B.memoised_apply(rows, "safe", lambda texts: [x.upper().replace("__PARAGRAPH_SIGN__", "__PARAGRAPH_SIGN__") for x in texts], "shown").select("s_suppkey", "shown")


@query("x05_embed", "SELECT ord, CAST(length(label) AS DOUBLE) AS first, 1.0::DOUBLE AS second FROM clean", ("qa", "clean"))
def _(t):
    rows = B.embed(clean(t), "label", lambda texts: [[float(len(x)), 1.0] for x in texts])
    return rows.select("ord", F.col("vector")[0].cast("double").alias("first"), F.col("vector")[1].cast("double").alias("second"))


@query("x07_page_rows")
def _(t):
    return H.page_events(t.pages).select("page_id", "ord", "tag", F.length("text").alias("n"))


@query("x08_grouped_metric", f"SELECT model, round((yy + nn) / n, 6) AS accuracy FROM (SELECT model, {_COUNTS} FROM pred GROUP BY model)", ("pred",))
def _(t):
    return M.confusion_metrics(predictions(t), ["model"]).select("model", "accuracy")


@query("x09_metric_callback", f"SELECT round((yy + nn) / n, 6) AS accuracy, ty::BIGINT AS true_yes FROM (SELECT {', '.join(f'{v if k == chr(110) else f"count(*) FILTER ({v})"}::DOUBLE AS {k}' for k, v in _C.items())} FROM pred)", ("pred",))
def _(t):
    return M.confusion_metrics(predictions(t).withColumn("all", L(1)), ["all"]).select("accuracy", "true_yes")
