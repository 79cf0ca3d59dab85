"""Filters, projections and scalar functions on records (F, S and N of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import prompts as P
from lexmill.functions import quality as Q
from lexmill.functions import text as X
from lexmill.operators import qa as QA
from lexmill.operators.order import spread

from .base import CTE, clean, exam, ledger, parsed, predictions, qa, query, sides

L = F.lit

REASON = """CASE WHEN question IS NULL OR answer IS NULL OR label IS NULL OR paragraph_id IS NULL OR quality_score IS NULL THEN 'missing field'
  WHEN length(trim(question)) < 10 THEN 'question too short' WHEN length(trim(answer)) < 10 THEN 'answer too short'
  WHEN lower(trim(label)) NOT IN ('yes', 'y', 'true', '1', 'correct', 'no', 'n', 'false', '0', 'incorrect') THEN 'label' WHEN quality_score < 0.6 THEN 'score' END"""


@query("f01_validate_records", f"SELECT ord, {REASON} AS reject_reason FROM qa", ("qa",))
def _(t):
    return QA.validated(qa(t)).select("ord", "reject_reason")


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_WORDS = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
SCORE = f"""least(1.0, greatest(0.0, 1.0
  - CASE WHEN length(question) < 15 THEN 0.3 WHEN length(question) > 200 THEN 0.2 ELSE 0.0 END
  - CASE WHEN (language = 'de' AND regexp_matches(lower(question), '{Q.GENERIC["de"]}')) OR (language <> 'de' AND regexp_matches(lower(question), '{Q.GENERIC["en"]}')) THEN 0.1 ELSE 0.0 END
  - CASE WHEN length(answer) < 20 THEN 0.4 WHEN length(answer) > 500 THEN 0.2 ELSE 0.0 END
  - CASE WHEN CAST(len(list_intersect({_WORDS("sentence")}, {_WORDS("answer")})) AS DOUBLE) / greatest(len({_WORDS("sentence")}), 1) < 0.1 AND label IN ('ja', 'yes') THEN 0.3 ELSE 0.0 END
  - CASE WHEN CAST(len(list_intersect({_WORDS("sentence")}, {_WORDS("answer")})) AS DOUBLE) / greatest(len({_WORDS("sentence")}), 1) > 0.8 THEN 0.15 ELSE 0.0 END
  - CASE WHEN suffix(lower(question), '?') AND lower(answer) IN ('ja', 'nein', 'yes', 'no', 'true', 'false') THEN 0.4 ELSE 0.0 END
  - CASE WHEN starts_with(lower(answer), 'i don''t know') OR starts_with(lower(answer), 'ich weiß nicht') THEN 0.5 ELSE 0.0 END
  - CASE WHEN len(list_filter(string_split(trim(regexp_replace(answer, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) > 5 THEN 0.2 ELSE 0.0 END))"""


@query("s21_quality_score", f"SELECT ord, round(CAST({SCORE} AS DOUBLE), 6) AS score FROM clean", ("qa", "clean"))
def _(t):
    c = F.col
    return clean(t).select("ord", F.round(Q.quality_score(c("question"), c("answer"), c("sentence"), c("label"), c("language")), 6).alias("score"))


_Q, _A = "lower(trim(question))", "lower(trim(answer))"
_KNOWN = """CASE WHEN language = 'de' AND lower(trim(label)) IN ('yes', 'ja') THEN 'ja' WHEN language = 'de' AND lower(trim(label)) IN ('no', 'nein') THEN 'nein'
  WHEN language = 'en' AND lower(trim(label)) IN ('yes', 'ja') THEN 'yes' WHEN language = 'en' AND lower(trim(label)) IN ('no', 'nein') THEN 'no'
  WHEN language NOT IN ('de', 'en') AND lower(trim(label)) IN ('yes', 'no') THEN lower(trim(label)) END"""
_HAS = lambda c, items: f"len(list_filter({_list(items)}, lambda p: contains({c}, p))) > 0"
STAGES = f"""CASE WHEN question IS NULL OR answer IS NULL OR label IS NULL THEN 'missing key'
  WHEN language = 'de' AND ({_HAS(_Q, Q.ENGLISH)} OR {_HAS(_A, Q.ENGLISH)}) THEN 'language'
  WHEN length(trim(question)) < 15 THEN 'question too short' WHEN length(trim(question)) > 200 THEN 'question too long'
  WHEN length(trim(answer)) < 20 THEN 'answer too short' WHEN length(trim(answer)) > 500 THEN 'answer too long'
  WHEN ({_KNOWN}) IS NULL THEN 'label' WHEN {_Q} = {_A} THEN 'identical'
  WHEN ((language = 'de' AND regexp_matches({_Q}, '{Q.YES_NO["de"]}')) OR (language <> 'de' AND regexp_matches({_Q}, '{Q.YES_NO["en"]}'))) AND {_A} IN ('yes', 'no', 'true', 'false', 'ja', 'nein', 'wahr', 'falsch') THEN 'bare answer'
  WHEN {_HAS(_Q, Q.PLACEHOLDERS)} OR {_HAS(_A, Q.PLACEHOLDERS)} THEN 'placeholder'
  WHEN CAST(len(list_intersect({_WORDS("trim(question)")}, {_WORDS("trim(answer)")})) AS DOUBLE) / greatest(len(list_distinct(list_concat({_WORDS("trim(question)")}, {_WORDS("trim(answer)")}))), 1) > 0.7 THEN 'repeats question'
  WHEN NOT ((language = 'de' AND {_HAS(_Q + " || ' ' || " + _A, Q.LEGAL_TERMS["de"])}) OR (language <> 'de' AND {_HAS(_Q + " || ' ' || " + _A, Q.LEGAL_TERMS["en"])})) THEN 'no legal term'
  WHEN {SCORE.replace("question", "regexp_replace(trim(question), '\\s+', ' ', 'g')").replace("(answer", "(regexp_replace(trim(answer), '\\s+', ' ', 'g')").replace("label IN", f"({_KNOWN}) IN")} < 0.6 THEN 'score' END"""
CTE["cases"] = "cases AS (SELECT ord, question || CASE WHEN ord % 3 = 0 THEN ' The driver must stop.' ELSE '' END AS question, answer, CASE WHEN ord % 10 = 0 THEN 'maybe' ELSE label END AS label, sentence, language FROM clean)"


@query("f02_six_stage_validator", f"SELECT ord, {STAGES} AS reject_reason FROM cases", ("qa", "clean", "cases"))
def _(t):
    c = F.col
    more = F.when(c("ord") % 3 == 0, " The driver must stop.").otherwise("")
    rows = clean(t).select("ord", F.concat("question", more).alias("question"), "answer", F.when(c("ord") % 10 == 0, "maybe").otherwise(c("label")).alias("label"), "sentence", "language")
    return rows.select("ord", Q.reject_reason(c("question"), c("answer"), c("label"), c("sentence"), c("language")).alias("reject_reason"))


@query(
    "f03_structural_issues",
    """SELECT ord, array_to_string(list_filter([CASE WHEN question IS NULL OR trim(question) = '' THEN 'missing question' END, CASE WHEN answer IS NULL OR trim(answer) = '' THEN 'missing answer' END,
      CASE WHEN label IS NULL OR trim(label) = '' THEN 'missing label' END, CASE WHEN paragraph_id IS NULL OR trim(paragraph_id) = '' THEN 'missing paragraph_id' END,
      CASE WHEN lower(trim(label)) NOT IN ('yes', 'y', 'true', '1', 'correct', 'no', 'n', 'false', '0', 'incorrect') THEN 'invalid label' END,
      CASE WHEN NOT quality_score BETWEEN 0 AND 1 THEN 'score out of range' END], lambda x: x IS NOT NULL), '; ') AS issues FROM qa""",
    ("qa",),
)
def _(t):
    return QA.structural_issues(qa(t)).select("ord", F.array_join("issues", "; ").alias("issues"))


@query(
    "f04_structure_ratio",
    r"SELECT round(avg(CASE WHEN question <> '' AND answer <> '' THEN 1.0 ELSE 0.0 END), 9) AS valid_ratio, round(avg(CASE WHEN regexp_matches(answer, '[0-9]') THEN 1.0 ELSE 0.0 END), 9) AS citation_ratio FROM qa",
    ("qa",),
)
def _(t):
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return qa(t).agg(share((F.col("question") != "") & (F.col("answer") != "")).alias("valid_ratio"), share(F.col("answer").rlike("[0-9]")).alias("citation_ratio"))


@query("f05_numeric_only", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS step FROM events WHERE event_id % 4 <> 0")
def _(t):
    raw = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    return t.events.select("event_id", raw.try_cast("double").alias("step")).dropna(subset=["step"])


@query("f06_model_kind", "SELECT ord, contains(model_name, '_clm_nsp_') AS pretrained, starts_with(model_name, 'nlpaueb_') AS from_group, regexp_matches(model_name, '.pt') AS pt_anywhere FROM ledger", ("ledger",))
def _(t):
    name = F.col("model_name")
    return ledger(t).select("ord", F.contains(name, L("_clm_nsp_")).alias("pretrained"), F.startswith(name, L("nlpaueb_")).alias("from_group"), name.rlike(".pt").alias("pt_anywhere"))


_ENTITY = "CASE p_partkey % 6 WHEN 0 THEN '§ ' || p_size WHEN 1 THEN 'Art. ' || p_size WHEN 2 THEN 'PARA_' || p_size WHEN 3 THEN p_size || '.' || p_partkey WHEN 4 THEN '§x' ELSE p_name END"
_LEGAL = r"^§\s*\d+|^Art\.\s*\d+|^Abs\.\s*\d+|^para_\d+|^paragraph_\d+|^\d+\.\d+|^Paragraph\s+\d+"


@query(
    "f07_paragraph_entities",
    f"SELECT p_partkey, regexp_matches(e, '(?i)({_LEGAL})') AS german_legal, len(list_filter(['§', 'Art.', 'Abs.', 'para_', 'paragraph_', 'Paragraph'], lambda p: starts_with(e, p))) > 0 AS prefix, regexp_matches(e, '^[0-9.]+$') AS all_numeric FROM (SELECT p_partkey, {_ENTITY} AS e FROM part)",
)
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    e = F.when(k % 6 == 0, F.concat(L("§ "), size)).when(k % 6 == 1, F.concat(L("Art. "), size)).when(k % 6 == 2, F.concat(L("PARA_"), size)).when(k % 6 == 3, F.concat(size, L("."), k.cast("string"))).when(k % 6 == 4, "§x").otherwise(F.col("p_name"))
    prefix = F.exists(F.array(*[L(p) for p in ("§", "Art.", "Abs.", "para_", "paragraph_", "Paragraph")]), lambda p: F.startswith(e, p))
    return t.part.select("p_partkey", e.rlike(f"(?i)({_LEGAL})").alias("german_legal"), prefix.alias("prefix"), e.rlike("^[0-9.]+$").alias("all_numeric"))


@query("f08_drop_empty_nodes", "SELECT n_nationkey, title FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'No Paragraph Title' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE n_name END AS title FROM nation) WHERE title IS NOT NULL AND title <> '' AND title <> 'No Paragraph Title'")
def _(t):
    k = F.col("n_nationkey") % 4
    title = F.when(k == 0, "No Paragraph Title").when(k == 1, "").when(k == 2, L(None).cast("string")).otherwise(F.col("n_name"))
    return t.nation.select("n_nationkey", title.alias("title")).filter("title IS NOT NULL AND title <> '' AND title <> 'No Paragraph Title'")


@query("f09_prune_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t):
    return t.lineitem.filter("l_quantity > 45").select("l_orderkey", "l_quantity")


_COMBO = """CASE WHEN clm > 0 AND clu = 0 AND cls = 0 THEN 'CLM only' WHEN clm = 0 AND clu > 0 AND cls = 0 THEN 'CLU only' WHEN clm = 0 AND clu = 0 AND cls > 0 THEN 'CLS only'
  WHEN clm > 0 AND clu > 0 AND cls = 0 THEN 'CLM+CLU' WHEN clm > 0 AND clu = 0 AND cls > 0 THEN 'CLM+CLS' WHEN clm = 0 AND clu > 0 AND cls > 0 THEN 'CLU+CLS' WHEN clm > 0 AND clu > 0 AND cls > 0 THEN 'ALL' END"""


@query("f10_ablation_config", f"SELECT ord, {_COMBO} AS config FROM parsed WHERE clm IS NOT NULL", ("ledger", "parsed"))
def _(t):
    from lexmill.operators.reports import task_combination

    return parsed(t).filter("clm IS NOT NULL").select("ord", task_combination().alias("config"))


@query("f11_lambda_grid", "SELECT a / 10 AS clm, b / 10 AS clu, round(1 - a / 10 - b / 10, 1) + 0.0 AS cls FROM (SELECT CAST(range AS DOUBLE) AS a FROM range(1, 10)) x, (SELECT CAST(range AS DOUBLE) AS b FROM range(1, 10)) y WHERE round(1 - a / 10 - b / 10, 1) >= 0")
def _(t):
    # Nine values a side: a grid of parameters, not of rows.
    a = t.spark.range(1, 10).select((F.col("id") / 10).alias("clm"))
    b = t.spark.range(1, 10).select((F.col("id") / 10).alias("clu"))
    return a.crossJoin(F.broadcast(b)).withColumn("cls", F.round(1 - F.col("clm") - F.col("clu"), 1) + 0.0).filter((F.col("cls") >= 0) & (F.abs(F.col("clm") + F.col("clu") + F.col("cls") - 1) < 1e-6))


@query("f12_question_defaults", "SELECT qid, coalesce(CASE WHEN qid % 3 <> 0 THEN question END, 'No question provided') AS question, coalesce(image, 'none') AS image FROM exam", ("exam",))
def _(t):
    return exam(t).select("qid", F.coalesce(F.when(F.col("qid") % 3 != 0, F.col("question")), L("No question provided")).alias("question"), F.coalesce("image", L("none")).alias("image"))


@query("f13_segments", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:10], '|') AS segments FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 10), "|").alias("segments"))


@query("f14_dispatch", "SELECT qid, CASE WHEN image IS NOT NULL THEN 'image' WHEN category = 'direct_answer' THEN 'direct' ELSE 'multiple choice' END AS route FROM exam", ("exam",))
def _(t):
    return exam(t).select("qid", F.when(F.col("image").isNotNull(), "image").when(F.col("category") == "direct_answer", "direct").otherwise("multiple choice").alias("route"))


@query("f15_normalize_records", "SELECT ord, question, answer, label, quality_score, paragraph_id, language, qa_hash FROM clean", ("qa", "clean"))
def _(t):
    return clean(t).select("ord", "question", "answer", "label", "quality_score", "paragraph_id", "language", "qa_hash")


@query("f16_direct_answer", "SELECT qid, CASE WHEN len(expected) > 0 THEN 'yes' ELSE 'no' END AS y_true FROM exam WHERE category = 'direct_answer'", ("exam",))
def _(t):
    return exam(t).filter("category = 'direct_answer'").select("qid", F.when(F.size("expected") > 0, "yes").otherwise("no").alias("y_true"))


@query("s08_collapse_spaces", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", X.collapse_spaces(F.col("text")).alias("text"))


@query("s09_pair_hash", "SELECT ord, md5(lower(trim(question)) || '|' || lower(trim(answer))) AS h FROM qa", ("qa",))
def _(t):
    return qa(t).select("ord", X.pair_hash(F.col("question"), F.col("answer")).alias("h"))


@query("s10_ratcliff_ratio")
def _(t):
    from lexmill.operators.metrics import ratcliff

    return sides(t).select("ord", F.round(ratcliff("reference", "candidate"), 9).alias("ratio"))


@query("s11_normalize_label", "SELECT ord, CASE WHEN lower(trim(label)) IN ('yes', 'y', 'true', '1', 'correct') THEN 'correct' WHEN lower(trim(label)) IN ('no', 'n', 'false', '0', 'incorrect') THEN 'incorrect' END AS label FROM qa", ("qa",))
def _(t):
    return qa(t).select("ord", X.to_correctness(X.normalize_label(F.col("label"))).alias("label"))


@query("s12_normalize_model_name", "SELECT DISTINCT model_name, lower(replace(replace(replace(replace(replace(replace(model_name, 'nlpaueb_', ''), 'google-bert_', ''), 'casehold_', ''), 'dlicari_', ''), 'avichr_', ''), '_', '-')) AS name FROM ledger", ("ledger",))
def _(t):
    return ledger(t).select("model_name").distinct().select("model_name", X.normalize_model_name(F.col("model_name")).alias("name"))


@query("s13_parse_config", "SELECT DISTINCT model_name, base, clm, clu, cls, TRY_CAST(regexp_extract(model_name, '_clu_([0-9.]+)', 1) AS DOUBLE) AS tagged_clu FROM parsed", ("ledger", "parsed"))
def _(t):
    return parsed(t).select("model_name", "base", "clm", "clu", "cls", X.tagged_config(F.col("model_name"))["clu"].alias("tagged_clu")).distinct()


_GROUP = "CASE WHEN contains(n, 'google-bert') OR starts_with(n, 'google_bert-') THEN 'GOOGLE-BERT' " + " ".join(f"WHEN contains(n, '{p}') THEN '{g}'" for p, g in X.BASE_GROUPS) + " ELSE 'OTHER' END"


@query("s14_base_group", f"SELECT DISTINCT model_name, {_GROUP} AS base_group FROM (SELECT model_name, lower(model_name) AS n FROM ledger)", ("ledger",))
def _(t):
    return ledger(t).select("model_name").distinct().select("model_name", X.base_group(F.col("model_name")).alias("base_group"))


_SAID = "CASE qid % 5 WHEN 0 THEN ' Incorrect, yes' WHEN 1 THEN 'maybe' WHEN 2 THEN 'not true' WHEN 3 THEN 'YES.' ELSE 'noted: wrong' END"


@query("s15_polarity", rf"SELECT qid, CASE WHEN regexp_extract(lower(trim({_SAID})), '\b(yes|correct|true|no|incorrect|wrong|false)\b', 1) IN ('yes', 'correct', 'true') THEN 'yes' ELSE 'no' END AS said FROM exam", ("exam",))
def _(t):
    said = F.element_at(F.array(*[L(x) for x in (" Incorrect, yes", "maybe", "not true", "YES.", "noted: wrong")]), (F.col("qid") % 5 + 1).cast("int"))
    return exam(t).select("qid", X.polarity(said).alias("said"))


_NUM = lambda c: rf"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '\b\d+(?:\.\d+)?\b'), lambda x: CAST(x AS DOUBLE))))"


@query("s16_same_numbers", f"SELECT event_id, CASE WHEN {_NUM('a')} = {_NUM('b')} THEN 'yes' ELSE 'no' END AS same FROM (SELECT event_id, 'after ' || user_id || ' m' AS a, CASE event_id % 3 WHEN 0 THEN user_id || '.0 meters' WHEN 1 THEN 'none' ELSE (user_id + 1) || ' or ' || user_id END AS b FROM events)")
def _(t):
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    b = F.when(k == 0, F.concat(user, L(".0 meters"))).when(k == 1, "none").otherwise(F.concat((F.col("user_id") + 1).cast("string"), L(" or "), user))
    return t.events.select("event_id", X.same_numbers(F.concat(L("after "), user, L(" m")), b).alias("same"))


@query("s17_symbolic_equality")
def _(t):
    from lexmill.operators.boundary import same_value

    a = F.concat(F.col("p_size").cast("string"), L("/2 + 1"))
    b = F.when(F.col("p_partkey") % 2 == 0, F.concat(L("(2 + "), F.col("p_size").cast("string"), L(")/2"))).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", same_value(a, b).alias("same"))


_PROMPT = lambda v: "concat(" + ", ".join("question" if p == "{q}" else "options[1]" if p == "{a}" else "'driving'" if p == "{d}" else "'" + p.replace("'", "''") + "'" for p in X.prompt_parts(X.PROMPTS[v])) + ")"


@query("s18_prompts", f"SELECT qid, CASE qid % 11 {' '.join(f'WHEN {v} THEN {_PROMPT(v)}' for v in X.PROMPTS)} ELSE {_PROMPT(1)} END AS prompt FROM exam", ("exam",))
def _(t):
    return exam(t).select("qid", X.prompt(F.col("qid") % 11, F.col("question"), F.col("options")[0], "driving").alias("prompt"))


@query("s19_qa_text", "SELECT ord, 'Question: ' || question || ' [SEP] Answer: ' || answer AS text FROM clean", ("qa", "clean"))
def _(t):
    return clean(t).select("ord", X.qa_text(F.col("question"), F.col("answer")).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE = lambda key: "replace(replace(" + _quoted(P.templates()[key].replace("{pairs}", "3").replace("{positive}", "2").replace("{negative}", "1")) + ", '{sentence}', sentence), '{paragraph}', paragraph)"
_DOMAIN = "CASE ord % 4 WHEN 0 THEN 'traffic_law' WHEN 1 THEN 'regulatory' WHEN 2 THEN 'contract' ELSE 'maritime' END"


@query(
    "s20_instruction_prompt",
    "SELECT ord, CASE "
    + " ".join(f"WHEN domain {'IN' if d == 'traffic_law' else '='} {chr(40) + _quoted(d) + ', ' + _quoted('maritime') + chr(41) if d == 'traffic_law' else _quoted(d)} AND (language = 'de') = {str(g == 'de').lower()} THEN {_TEMPLATE((d, g))}" for d, g in P.CONTEXTS)
    + f" END AS prompt FROM (SELECT ord, {_DOMAIN} AS domain, language, replace(sentence, '{{', '(') AS sentence, replace(paragraph, '{{', '(') AS paragraph FROM clean)",
    ("qa", "clean"),
)
def _(t):
    # The last domain is not known. Braces go, as the SQL fills one mark after the other.
    domain = F.element_at(F.array(*[L(x) for x in ("traffic_law", "regulatory", "contract", "maritime")]), (F.col("ord") % 4 + 1).cast("int"))
    bare = lambda c: F.replace(F.col(c), L("{"), L("("))
    return clean(t).select("ord", X.instruction_prompt(bare("sentence"), bare("paragraph"), L(3), domain, F.col("language")).alias("prompt"))


@query("s18_direct_prompt", f"SELECT qid, CASE WHEN qid % 3 = 1 THEN {_quoted(X.DIRECT[0])} || question || {_quoted(X.DIRECT[1])} ELSE '' END AS prompt FROM exam WHERE category = 'direct_answer'", ("exam",))
def _(t):
    return exam(t).filter("category = 'direct_answer'").select("qid", X.direct_prompt(F.col("qid") % 3, F.col("question")).alias("prompt"))


@query(
    "s13_four_dialects",
    """SELECT DISTINCT model_name, clu AS by_place, TRY_CAST(regexp_extract(model_name, '_clu_([0-9.]+)', 1) AS DOUBLE) AS by_mark, clu AS of_checkpoint,
      CASE WHEN contains(model_name, '_clm_nsp_') THEN TRY_CAST(split_part(split_part(model_name, '_clu_', 2), '_cls_', 1) AS DOUBLE) END AS between FROM parsed""",
    ("ledger", "parsed"),
)
def _(t):
    name = F.col("model_name")
    rows = parsed(t).select("model_name", "clu").distinct()
    saved = X.checkpoint_config(F.concat(name, F.when(F.contains(name, L("_clm_nsp_")), L(".pt")).otherwise(L(""))))
    return rows.select("model_name", F.col("clu").alias("by_place"), X.tagged_config(name)["clu"].alias("by_mark"), saved["clu"].alias("of_checkpoint"), X.sliced_config(name)["clu"].alias("between"))


@query("s22_overlap", f"SELECT ord, round(CAST(len(list_intersect({_WORDS('question')}, {_WORDS('answer')})) AS DOUBLE) / greatest(len(list_distinct(list_concat({_WORDS('question')}, {_WORDS('answer')}))), 1), 9) AS jaccard FROM clean", ("qa", "clean"))
def _(t):
    return clean(t).select("ord", F.round(X.jaccard(F.col("question"), F.col("answer")), 9).alias("jaccard"))


@query("s23_title_parts", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '§ ' || p_size END AS marker, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name ELSE 'a ' || p_name END AS rest FROM part")
def _(t):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    title = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(L("§ "), size, L(" "), "p_name")).otherwise(F.concat(L("§ "), size, L("a "), "p_name"))
    return t.part.select("p_partkey", X.title_parts(title).alias("x")).select("p_partkey", "x.marker", "x.rest")


@query("s24_protect_symbols", "SELECT p_partkey, '__PARAGRAPH_SIGN__ ' || p_size || ' ⟨SIGN⟩' || p_partkey || '⟨/SIGN⟩' AS safe, '§ ' || p_size || ' <sign>' || p_partkey || '</sign>' AS again FROM part")
def _(t):
    text = F.concat(L("§ "), F.col("p_size").cast("string"), L(" <sign>"), F.col("p_partkey").cast("string"), L("</sign>"))
    return t.part.select("p_partkey", X.protect(text).alias("safe"), X.restore(X.protect(text)).alias("again"))


@query("s25_sentences", r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')[2] AS second FROM documents")
def _(t):
    parts = X.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(parts).cast("bigint").alias("n"), F.get(parts, L(1)).alias("second"))


@query("s26_statutory_references", "SELECT l_orderkey, l_linenumber, '§ ' || l_partkey || ' Abs. ' || l_linenumber || '|§§ ' || l_suppkey || 'a' AS refs FROM lineitem")
def _(t):
    text = lambda c: F.col(c).cast("string")
    sentence = F.concat(L("nach § "), text("l_partkey"), L(" Abs. "), text("l_linenumber"), L(", auch §§ "), text("l_suppkey"), L("a; Ende"))
    return spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", F.array_join(X.statutory_references(sentence), "|").alias("refs"))


@query("s27_file_names", "SELECT page_id, split_part(string_split(url, '/')[-1], '.', 1) AS stem, regexp_extract(url, '\\.([^./]+)$', 1) AS extension FROM pages")
def _(t):
    return t.pages.select("page_id", X.file_stem(F.col("url")).alias("stem"), X.file_extension(F.col("url")).alias("extension"))


@query("s28_node_id", "SELECT l_orderkey, l_linenumber, l_orderkey || '__' || l_linenumber AS id FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.node_id(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))


@query("s29_dot_quote", """SELECT page_id, '"' || replace(html, '"', '\\"') || '"' AS quoted FROM pages""".replace("\\\\", "\\"))
def _(t):
    return t.pages.select("page_id", X.dot_quote(F.col("html")).alias("quoted"))


@query("s30_odd_tag_strip", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a <par>x</par> b' ELSE 'x tail' END AS text FROM part")
def _(t):
    text = F.when(F.col("p_partkey") % 2 == 0, "a <par>x</par> b").otherwise("x> y </> tail")
    return t.part.select("p_partkey", X.odd_tag_strip(text).alias("text"))


@query("s31_fixed_width", "SELECT p_partkey, rpad(p_name, 20, ' ') || '|' || rpad(CAST(p_size AS VARCHAR), 6, ' ') AS line FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat(X.fixed_width(F.col("p_name"), 20), L("|"), X.fixed_width(F.col("p_size"), 6)).alias("line"))


@query("s32_checkpoint_name", "SELECT DISTINCT base || '_corpus_clm_nsp_' || clm || '_clu_' || clu || '_cls_' || cls AS name FROM parsed WHERE clm IS NOT NULL", ("ledger", "parsed"))
def _(t):
    c = F.col
    return parsed(t).filter("clm IS NOT NULL").select(X.checkpoint_name(c("base"), L("corpus"), c("clm"), c("clu"), c("cls")).alias("name")).distinct()


_RESPONSE = """CASE ord % 4 WHEN 0 THEN 'Sure: [ {"question": "Q' || ord || '", "answer": "A", "label": "yes"}, {"question": "R", "answer": "B", "label": "no"} ] end'
 WHEN 1 THEN '{"question": "Q' || ord || '", "answer": "A", "label": "no"} and {"frage": "R", "antwort": "B", "label": "yes"}'
 WHEN 2 THEN '"question": "Q' || ord || '", "answer": "A" / "question": "R", "answer": "B", "label": "perhaps"' ELSE 'nothing' END"""


@query("n01_extract_pairs", "SELECT ord, CASE ord % 4 WHEN 0 THEN 'Q' || ord || ':A:yes|R:B:no' WHEN 1 THEN 'Q' || ord || ':A:no|R:B:yes' WHEN 2 THEN 'Q' || ord || ':A:yes|R:B:no' ELSE '' END AS pairs FROM qa", ("qa",))
def _(t):
    response = F.expr(_RESPONSE)
    pairs = Q.extract_pairs(response, 2, L("en"))
    return qa(t).select("ord", F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["question"], p["answer"], p["label"])), "|").alias("pairs"))


@query("n02_accept_attempt", "SELECT l_orderkey AS sentence_id, min(attempt) AS attempt, arg_min(valid, attempt) AS valid FROM (SELECT l_orderkey, l_linenumber % 3 AS attempt, count(*) FILTER (l_quantity > 20) AS valid FROM lineitem GROUP BY 1, 2) WHERE valid >= 1 GROUP BY 1")
def _(t):
    return QA.accepted_attempts(t.lineitem.select(F.col("l_orderkey").alias("sentence_id"), (F.col("l_linenumber") % 3).alias("attempt"), (F.col("l_quantity") > 20).alias("valid")), 2)


@query("n03_paired_answers", "SELECT qid, u.i AS i, options[u.i + 1] AS text, list_contains(expected, options[u.i + 1]) AS correct FROM exam, (SELECT range AS i FROM range(0, 4)) u WHERE u.i < len(options)", ("exam",))
def _(t):
    flags = F.transform("options", lambda o: F.array_contains("expected", o))
    rows = exam(t).select("qid", F.posexplode(F.arrays_zip(F.col("options").alias("text"), flags.alias("correct"))).alias("i", "p"))
    return rows.select("qid", F.col("i").cast("bigint").alias("i"), "p.text", "p.correct")


@query("n04_language_map", "SELECT doc_id, CASE WHEN lang = 'de' THEN source ELSE '' END AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.coalesce(F.create_map("lang", "source")[L("de")], L("")).alias("text"))


@query("n17_rounding", "SELECT l_orderkey, l_linenumber, floor(l_discount * 100 * 10 + 0.5) / 10 AS one, round(l_extendedprice / 7, 6) AS six FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.floor(F.col("l_discount") * 100 * 10 + 0.5) / 10).alias("one"), F.round(F.col("l_extendedprice") / 7, 6).alias("six"))


@query("n19_time_stamps", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


@query("n20_ranges", "SELECT p_partkey, array_to_string(range(p_size, p_size + 4), ',') AS listed FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.sequence("p_size", F.col("p_size") + 3), ",").alias("listed"))


@query("u06_word_sets", f"SELECT ord, len(list_intersect({_WORDS('question')}, {_WORDS('sentence')})) AS shared FROM clean", ("qa", "clean"))
def _(t):
    return clean(t).select("ord", F.size(F.array_intersect(X.word_set(F.col("question")), X.word_set(F.col("sentence")))).cast("bigint").alias("shared"))


@query("j10_options_to_labels", "SELECT qid, u.i AS opt_ord, CASE WHEN list_contains(expected, options[u.i + 1]) THEN 'yes' ELSE 'no' END AS y_true FROM exam, (SELECT range AS i FROM range(0, 4)) u WHERE u.i < len(options)", ("exam",))
def _(t):
    rows = exam(t).select("qid", "expected", F.posexplode("options").alias("opt_ord", "option"))
    return rows.select("qid", F.col("opt_ord").cast("bigint").alias("opt_ord"), F.when(F.array_contains("expected", F.col("option")), "yes").otherwise("no").alias("y_true"))


@query("x06_pluggable_classifier", "SELECT qid, opt_ord, CASE WHEN suffix(model, '1') THEN 'yes' ELSE 'no' END AS label FROM pred", ("pred",))
def _(t):
    from lexmill.operators.boundary import classify

    return classify(predictions(t).select("qid", "opt_ord", F.col("model").alias("text")), "text", lambda texts: ["yes" if x.endswith("1") else "no" for x in texts]).select("qid", "opt_ord", "label")
