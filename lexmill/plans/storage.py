"""Sources, sinks and streams (SRC, SNK, section 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import qa as QA
from lexmill.sources import html as H
from lexmill.sources import readers as R
from lexmill.sources import writers as W
from lexmill.session import landing_folder
from lexmill.streaming import jobs as J

from .base import clean, exam, ledger, qa, query
from .records import REASON

L = F.lit


def landed(t, rows, name: str, by: str | None = None) -> str:
    """The path of text files with the lines `value` of rows, in a folder for each value of a column if one is named."""
    path = landing_folder(t.spark, name)
    writer = rows.write.partitionBy(by) if by else rows.write
    writer.text(path)
    return path


def arrays(rows, key, item):
    """JSON arrays of the items of rows, some for each file: value and part."""
    part = F.pmod(F.xxhash64(key), L(4)).alias("part")
    return rows.groupBy(part).agg(F.to_json(F.collect_list(item)).alias("value"))


@query("src01_exam_de", "SELECT CAST(qid AS VARCHAR) AS id, question, array_to_string(list_sort(expected), '|') AS expected FROM exam WHERE image IS NULL AND category <> 'direct_answer'", ("exam",))
def _(t):
    item = F.struct(F.col("qid").cast("string").alias("id"), "category", "question", "options", F.col("expected").alias("answers"), "image")
    rows = R.read_german(t.spark, landed(t, arrays(exam(t), "qid", item), "exam", "part"))
    return rows.select("id", "question", F.array_join(F.array_sort("expected"), "|").alias("expected"))


@query("src02_exam_ie", "SELECT CAST(qid AS VARCHAR) AS id, question, 'H' || qid AS heading FROM exam WHERE image IS NULL", ("exam",))
def _(t):
    item = F.struct(F.col("qid").cast("string").alias("id"), "question", "options", F.col("expected").alias("answers"), "image", F.concat(L("H"), F.col("qid").cast("string")).alias("heading"))
    return R.read_irish(t.spark, landed(t, arrays(exam(t), "qid", item), "exam", "part")).select("id", "question", "heading")


@query("src03_exam_at", "SELECT CAST(qid AS VARCHAR) AS id, question, array_to_string(options[1:3], '|') AS options, options[1] || CASE WHEN len(options) > 2 THEN '|' || options[3] ELSE '' END AS expected FROM exam WHERE image IS NULL", ("exam",))
def _(t):
    answers = F.create_map(L("de"), F.transform("options", lambda o: F.struct(o.alias("Text"))))
    item = F.struct(F.col("qid").cast("string").alias("FRAGEID"), F.col("image").alias("BildName"), F.create_map(L("de"), F.col("question")).alias("FrageText"), answers.alias("AntwortText"), F.array(L(True), L(False), L(True)).alias("AntwortRichtig"))
    path = landing_folder(t.spark, "exam")
    arrays(exam(t), "qid", item).write.partitionBy("part").text(path)
    rows = R.read_austrian(t.spark, path, "*")
    return rows.select("id", "question", F.array_join("options", "|").alias("options"), F.array_join("expected", "|").alias("expected"))


def _string(name: str):
    return F.col(name).cast("string")


def _lines(t):
    """Records as JSON lines: every seventh cut off, every eleventh blank."""
    whole = F.to_json(F.struct("ord", "question", "answer", "label", "quality_score"))
    line = F.when(F.col("ord") % 11 == 0, " ").when(F.col("ord") % 7 == 0, F.substring(whole, L(1), F.length(whole) - 5)).otherwise(whole)
    return qa(t).select("ord", line.alias("value"))


@query("src04_jsonl_strict", "SELECT ord, question, label FROM qa", ("qa",))
def _(t):
    path = landed(t, qa(t).select(F.to_json(F.struct("ord", "question", "label")).alias("value")), "jsonl")
    return R.read_jsonl_strict(t.spark, path, "ord bigint, question string, label string")


@query("src05_jsonl_tolerant", "SELECT ord, question, label FROM qa WHERE ord % 11 <> 0 AND ord % 7 <> 0", ("qa",))
def _(t):
    path = landed(t, _lines(t).select("value"), "jsonl")
    return R.read_jsonl(t.spark, path, f"ord bigint, {R.RECORD}").select("ord", "question", "label")


@query("src06_jsonl_repaired", "SELECT ord, label, quality_score FROM qa", ("qa",))
def _(t):
    line = F.concat(F.to_json(F.struct("ord", "label", "quality_score")), F.when(F.col("ord") % 2 == 0, L(', {"label": "cut')).otherwise(L("")))
    path = landed(t, qa(t).select(line.alias("value")), "jsonl")
    return R.read_jsonl_repaired(t.spark, path, f"ord bigint, {R.RECORD}").select("ord", "label", "quality_score")


@query("src07_json_or_lines", "SELECT ord, CAST(quality_score AS VARCHAR) AS next_sentence_labels FROM qa", ("qa",))
def _(t):
    item = F.struct("ord", F.col("quality_score").cast("string").alias("label"))
    even, odd = qa(t).filter("ord % 2 = 0"), qa(t).filter("ord % 2 <> 0")
    schema = "ord bigint, label string"
    of_arrays = R.read_json_or_jsonl(t.spark, landed(t, arrays(even, "ord", item), "json", "part"), schema)
    of_lines = R.read_json_or_jsonl(t.spark, landed(t, odd.select(F.to_json(item).alias("value")), "jsonl"), schema)
    return of_arrays.select("ord", "next_sentence_labels").unionByName(of_lines.select("ord", "next_sentence_labels"))


@query("src08_triples", "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'malformed' WHEN 2 THEN 'empty' ELSE 'valid' END AS status, CASE WHEN s_suppkey % 5 > 2 THEN s_name END AS h, CASE WHEN s_suppkey % 5 > 2 THEN 'in' END AS r, CASE WHEN s_suppkey % 5 > 2 THEN CAST(s_nationkey AS VARCHAR) END AS t FROM supplier")
def _(t):
    k, name, nation = F.col("s_suppkey") % 5, F.col("s_name"), F.col("s_nationkey").cast("string")
    line = F.when(k == 0, "# note").when(k == 1, F.concat(name, L(" <tr> in"))).when(k == 2, F.concat(name, L(" <tr>  <tr> "), nation)).otherwise(F.concat(name, L(" <tr> in <tr> "), nation))
    return R.parse_triples(t.supplier.select(F.col("s_suppkey").alias("k"), line.alias("value")))


@query("src08_triple_files", "SELECT s_name AS h, 'in' AS r, CAST(s_nationkey AS VARCHAR) AS t FROM supplier WHERE s_suppkey % 5 > 2")
def _(t):
    k, name, nation = F.col("s_suppkey") % 5, F.col("s_name"), F.col("s_nationkey").cast("string")
    line = F.when(k == 0, "# note").when(k == 1, F.concat(name, L(" <tr> in"))).when(k == 2, F.concat(name, L(" <tr>  <tr> "), nation)).otherwise(F.concat(name, L(" <tr> in <tr> "), nation))
    return R.read_triples(t.spark, landed(t, t.supplier.select(line.alias("value")), "triples"))


@query(
    "src10_statute_tree",
    """SELECT page_id, o AS ord, 'Teil ' || page_id % 3 AS category, '§ ' || page_id || 'a Titel' AS paragraph, '§ ' || page_id || 'a' AS paragraph_id, sen_id, text
       FROM pages, (VALUES (2, '1', '(1) Erster Satz. weiter'), (4, '2', '(2) Zweiter. <img>b.png</img>')) v(o, sen_id, text)""",
)
def _(t):
    marked = F.concat(L("<h2>Teil "), (F.col("page_id") % 3).cast("string"), L("</h2><h3>§ "), F.col("page_id").cast("string"), L("a Titel</h3><div class='jurAbsatz'>(1) Erster Satz.</div><div class='jurAbsatz'>weiter</div><div class='jurAbsatz'>(2) Zweiter.<img src='x/b.png'></div><h3>Schlussformel</h3><div>weg</div>"))
    return H.statute_rows(H.page_events(t.pages.select("page_id", marked.alias("html"))))


@query("src10_page_events")
def _(t):
    return H.page_events(t.pages).filter("tag IN ('h1', 'p')").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "src11_annex_tree",
    """SELECT page_id, o AS ord, CAST(page_id AS VARCHAR) AS table_id, 'Abschnitt 1 Gefahr' AS section, '1' AS section_id, sign_number, sign_name, description
       FROM pages, (VALUES (5, '101', 'Stelle', 'Vorsicht'), (9, '102', NULL, 'Nur Text')) v(o, sign_number, sign_name, description)""",
)
def _(t):
    marked = F.concat(L("<h2>Anlage "), F.col("page_id").cast("string"), L("</h2><table><tr><td>Abschnitt 1 Gefahr</td></tr><tr><td>101</td><td>Stelle</td><td>Vorsicht</td></tr><tr><td>102</td><td>Nur Text</td></tr><tr><td></td></tr></table>"))
    return H.annex_rows(H.page_events(t.pages.select("page_id", marked.alias("html"))))


@query(
    "src12_html_text",
    r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g'), chr(10)),
      lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, 'http')), ' ') AS text FROM pages""",
)
def _(t):
    return t.pages.select("page_id", R.html_lines(F.col("html")).alias("text"))


@query("src13_court_sections", "SELECT p_partkey, 'Die Klage ' || p_name AS tenor, 'Der Fall ' || p_size AS tatbestand, 'Nach § ' || p_size || ' Abs. 2 BGB.' AS gruende, '§ ' || p_size || ' Abs. 2 BGB' AS refs FROM part")
def _(t):
    size = F.col("p_size").cast("string")
    html = F.concat(L("<h1>Tenor</h1><p>Die Klage "), "p_name", L("</p>\n<h1>Tatbestand</h1> Der Fall "), size, L(" <h1>Entscheidungsgründe</h1><p>Nach § "), size, L(" Abs. 2 BGB.</p>"))
    return t.part.select("p_partkey", R.court_sections(html).alias("c")).select("p_partkey", "c.tenor", "c.tatbestand", F.col("c.entscheidungsgruende").alias("gruende"), F.array_join("c.legal_references", "|").alias("refs"))


@query("src14_csv_ledger", "SELECT ord, setting, f1_macro FROM ledger", ("ledger",))
def _(t):
    path = landing_folder(t.spark, "ledger")
    W.append_ledger(ledger(t).select("ord", "setting", "f1_macro"), path)
    return R.read_ledger(t.spark, path).select(F.col("ord").cast("bigint").alias("ord"), "setting", "f1_macro")


@query("src16_embedding_dictionary", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def _(t):
    parts = t.embeddings.groupBy(F.pmod(F.xxhash64("vec_id"), L(8)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("vec_id").cast("string"), "embedding"))).alias("m"))
    path = landed(t, parts.select("part", F.to_json("m").alias("value")), "embeddings", "part")
    return R.read_embeddings(t.spark, path).select("id", F.size("v").alias("dim"))


@query("src17_statute_sentences", "SELECT s_suppkey AS k, n_name AS category, '§ ' || s_nationkey AS paragraph_id, s_name || ' of this nation' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    sentence = lambda c: F.create_map(L("1"), c)
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    paragraph = F.struct(L("Titel").alias("paragraph"), F.concat(L("§ "), F.col("s_nationkey").cast("string")).alias("paragraph_id"), F.array(sentence(F.concat("s_name", L(" of this nation"))), sentence(L("too short"))).alias("sentences"))
    tree = F.to_json(F.array(F.struct(F.col("n_name").alias("category"), F.array(paragraph).alias("paragraphs"))))
    # A line is a statute; its key stands before it.
    path = landed(t, rows.select(F.concat(F.col("s_suppkey").cast("string"), L(" "), tree).alias("value")), "statutes")
    read = t.spark.read.text(path).select(F.substring_index("value", " ", 1).cast("bigint").alias("k"), F.from_json(F.regexp_replace("value", r"^\d+ ", ""), R.STATUTE).alias("tree"))
    return R.statute_sentences(read).select("k", "category", "paragraph_id", "text")


@query("src18_run_metadata", "SELECT 'n' || n_nationkey AS model, 500 + n_nationkey AS num_entities, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 100 END AS val_loss FROM nation WHERE n_nationkey % 5 > 0")
def _(t):
    # Every fifth model has no file, every third no validation loss.
    k = F.col("n_nationkey")
    text = F.to_json(F.struct((k + 500).alias("num_entities"), F.struct((k / 50).alias("train"), F.when(k % 3 > 0, k / 100).alias("val")).alias("losses")))
    path = landed(t, t.nation.filter("n_nationkey % 5 > 0").select(text.alias("value"), F.concat(L("n"), k.cast("string")).alias("model")), "runs", "model")
    return R.read_run_metadata(t.spark, f"{path}/*").select("model", "num_entities", "val_loss")


@query("src19_seed_results", "SELECT 'm' || s_nationkey AS model, CAST(s_suppkey % 5 + 1 AS INTEGER) AS seed, max(s_suppkey) / 1000 AS eval_macro FROM supplier WHERE s_suppkey % 7 > 0 GROUP BY 1, 2")
def _(t):
    # Runs that were not finished have no file.
    done = t.supplier.filter("s_suppkey % 7 > 0").groupBy(F.concat(L("m"), _string("s_nationkey")).alias("model"), F.concat(L("seed_"), (F.col("s_suppkey") % 5 + 1).cast("string")).alias("seed"))
    rows = done.agg(F.to_json(F.struct((F.max("s_suppkey") / 1000).alias("eval_macro"))).alias("value"))
    path = landing_folder(t.spark, "seeds")
    rows.write.partitionBy("model", "seed").text(path)
    return R.read_seed_results(t.spark, f"{path}/*/*").select("model", "seed", "eval_macro")


@query("snk01_nested_json", """SELECT r_name AS category, '{"category":"' || r_name || '","paragraphs":[' || string_agg('{"paragraph":"' || n_name || '","paragraph_id":"p' || n_name || '","sentences":[{"1":"' || n_name || '"}]}', ',' ORDER BY 'p' || n_name) || ']}' AS json FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""")
def _(t):
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    made = W.statute_json(rows.select(F.col("r_name").alias("category"), F.concat(L("p"), "n_name").alias("paragraph_id"), F.col("n_name").alias("paragraph"), L("1").alias("sen_id"), F.col("n_name").alias("text"), L(0).alias("ord")))
    path = landing_folder(t.spark, "statutes")
    W.write_lines(made, "json", path)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.category").alias("category"), F.col("value").alias("json"))


@query("snk02_json_lines", """SELECT ord, '{"ord":' || ord || ',"label":"' || label || '"}' AS line FROM clean""", ("qa", "clean"))
def _(t):
    path = landing_folder(t.spark, "records")
    W.write_jsonl(clean(t).select("ord", "label", "qa_hash"), path)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.ord").cast("bigint").alias("ord"), F.col("value").alias("line"))


@query("snk03_append_ledger", "SELECT ord, f1_macro, NULL::DOUBLE AS loss FROM ledger UNION ALL SELECT event_id + 1000000, CAST(user_id AS DOUBLE), value FROM events", ("ledger",))
def _(t):
    path = landing_folder(t.spark, "ledger")
    W.append_ledger(ledger(t).select("ord", "f1_macro"), path)
    # The second batch brings a column that the first has not.
    W.append_ledger(t.events.select(F.col("value").alias("loss"), (F.col("event_id") + 1000000).alias("ord"), F.col("user_id").cast("double").alias("f1_macro")), path)
    return R.read_ledger(t.spark, path).select(F.col("ord").cast("bigint").alias("ord"), F.col("f1_macro").cast("double").alias("f1_macro"), "loss")


@query("snk09_stats_json", """SELECT '{"total":' || count(*) || ',"yes":' || count(*) FILTER (label = 'yes') || '}' AS json FROM clean""", ("qa", "clean"))
def _(t):
    path = landing_folder(t.spark, "stats")
    W.write_lines(clean(t).agg(F.to_json(F.struct(F.count("*").alias("total"), F.count_if(F.col("label") == "yes").alias("yes"))).alias("json")), "json", path)
    return t.spark.read.text(path).select(F.col("value").alias("json"))


@query("snk11_annotation_rows", "SELECT row_number() OVER (ORDER BY ord) AS sample_id, question, answer, label, CASE WHEN length(paragraph) > 500 THEN substr(paragraph, 1, 500) || '...' ELSE paragraph END AS paragraph, '' AS correct, '' AS relevant, '' AS comment FROM clean", ("qa", "clean"))
def _(t):
    return W.annotation_rows(clean(t))


@query("snk12_sorted_entities", "SELECT DISTINCT s_name AS entity FROM supplier ORDER BY entity")
def _(t):
    return t.supplier.select(F.col("s_name").alias("entity")).distinct().orderBy("entity")


@query("snk15_tree_text", "SELECT p_brand, string_agg(trim(p_type || ' ' || p_name), ' ' ORDER BY p_partkey) AS text FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand")
def _(t):
    line = F.when(F.col("p_partkey") % 4 == 0, "see http://x").otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return W.tree_text(t.part, "p_brand", "p_partkey", line)


@query("snk16_extraction_summary", "SELECT count(*) AS entities, count(*) FILTER (s_suppkey % 4 = 0) AS paragraphs, round(count(*) FILTER (s_suppkey % 4 = 0) * 100.0 / count(*), 6) AS rate, array_to_string(list_sort(list(s_name))[1:10], ',') AS first_ten FROM supplier")
def _(t):
    hit = F.col("s_suppkey") % 4 == 0
    first = t.supplier.select("s_name").orderBy("s_name").limit(10).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("first_ten"))
    sums = t.supplier.agg(F.count("*").alias("entities"), F.count_if(hit).alias("paragraphs"), F.round(F.count_if(hit) * 100.0 / F.count("*"), 6).alias("rate"))
    return sums.crossJoin(F.broadcast(first))


@query("str01_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t):
    return J.run_to_files(J.windowed(J.stream_table(t.spark, f"{t.sf_dir}/events.parquet"), "6 hours"), landing_folder(t.spark, "stream")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str02_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOURS THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s")
def _(t):
    return J.run_to_files(J.sessions(J.stream_table(t.spark, f"{t.sf_dir}/events.parquet"), "2 hours"), landing_folder(t.spark, "stream")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str03_sliding_windows", "SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, * FROM events UNION ALL SELECT time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS, * FROM events) GROUP BY 1, 2")
def _(t):
    return J.run_to_files(J.windowed(J.stream_table(t.spark, f"{t.sf_dir}/events.parquet"), "12 hours", "6 hours"), landing_folder(t.spark, "stream")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _arrivals(t) -> str:
    """Records as they arrive: files of a folder, with the time of arrival."""
    path = landing_folder(t.spark, "arrivals")
    qa(t).select("ord", "question", "answer", "label", "paragraph_id", "quality_score", F.timestamp_seconds(F.col("ord") % 60 + 1_700_000_000).alias("ts")).repartition(3).write.parquet(path)
    return path


@query("str04_validated_records", f"SELECT ord, label FROM qa WHERE ({REASON}) IS NULL", ("qa",))
def _(t):
    # Two files a micro-batch, then the stream ends; a second run finds nothing new.
    source, path = _arrivals(t), landing_folder(t.spark, "validated")
    for _ in range(2):
        J.append_to(J.accepted(J.stream_table(t.spark, source, 2)), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select("ord", "label")


@query("str05_first_wins", f"SELECT DISTINCT md5(lower(trim(question)) || '|' || lower(trim(answer))) AS qa_hash FROM qa WHERE ({REASON}) IS NULL", ("qa",))
def _(t):
    path = landing_folder(t.spark, "first")
    J.append_to(J.first_wins(J.accepted(J.stream_table(t.spark, _arrivals(t)))), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select("qa_hash")


@query("str06_ledger_batches", "SELECT ord, f1_macro FROM ledger", ("ledger",))
def _(t):
    source, path = landing_folder(t.spark, "results"), landing_folder(t.spark, "ledger")
    ledger(t).select("ord", "f1_macro").repartition(4).write.parquet(source)
    J.for_each_batch(J.stream_table(t.spark, source, 2), J.append_once(path), f"{path}-checkpoint").awaitTermination()
    J.append_once(path)(t.spark.read.parquet(source).limit(0), 1_000_000)  # a batch without rows
    return R.read_ledger(t.spark, path).select(F.col("ord").cast("bigint").alias("ord"), F.col("f1_macro").cast("double").alias("f1_macro"))


@query("qa_clean_dedup_stats", "SELECT paragraph_id, label, count(*) AS n, round(avg(quality_score), 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY qa_hash ORDER BY ord) AS rn FROM clean WHERE length(question) >= 10 AND length(answer) >= 10) WHERE rn = 1 GROUP BY 1, 2", ("qa", "clean"))
def _(t):
    rows = clean(t).filter((F.length("question") >= 10) & (F.length("answer") >= 10))
    return QA.first_of_each(rows).groupBy("paragraph_id", "label").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


