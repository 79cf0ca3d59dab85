"""Order, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import qa as QA
from lexmill.operators import sampling as P
from lexmill.operators import sequences as S

from .base import CTE, clean, ledger, qa, query

L = F.lit


@query(
    "w01_sentence_pairs",
    "SELECT i, text AS text_a, nt AS text_b, 1 AS label FROM (SELECT row_number() OVER (ORDER BY p_brand, CAST(p_partkey AS VARCHAR), p_name) - 1 AS i, p_name || p_partkey AS text, p_brand, lead(p_name || p_partkey) OVER (ORDER BY p_brand, CAST(p_partkey AS VARCHAR), p_name) AS nt, lead(p_brand) OVER (ORDER BY p_brand, CAST(p_partkey AS VARCHAR), p_name) AS nb FROM part) WHERE p_brand = nb",
)
def _(t):
    rows = t.part.select(F.col("p_brand").alias("paragraph"), F.col("p_partkey").cast("string").alias("sen_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("text"))
    return S.sentence_pairs(rows, 42).filter("label = 1").select("i", "text_a", "text_b", "label")


_PARTS = "SELECT row_number() OVER w - 1 AS i, p_name || p_partkey AS text, lead(p_name || p_partkey) OVER w AS next_text FROM part WINDOW w AS (ORDER BY p_brand, CAST(p_partkey AS VARCHAR), p_name)"


@query(
    "w01_negative_pairs",
    f"""WITH both_texts AS ({_PARTS}), pool AS (SELECT text AS candidate, row_number() OVER (ORDER BY text) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT p_name || p_partkey AS text FROM part)),
    placed AS (SELECT *, ('0x' || substr(md5('42|' || i), 1, 8))::BIGINT % (SELECT max(n) FROM pool) AS place FROM both_texts WHERE next_text IS NOT NULL)
    SELECT i, text AS text_a, CASE WHEN a.candidate <> next_text THEN a.candidate ELSE b.candidate END AS text_b, 0 AS label FROM placed JOIN pool a ON a.slot = place JOIN pool b ON b.slot = (place + 1) % b.n""",
)
def _(t):
    rows = t.part.select(F.col("p_brand").alias("paragraph"), F.col("p_partkey").cast("string").alias("sen_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("text"))
    return S.sentence_pairs(rows, 42).filter("label = 0")


@query("w03_first_of_each", "SELECT ord, qa_hash FROM (SELECT *, row_number() OVER (PARTITION BY qa_hash ORDER BY ord) AS rn FROM clean) WHERE rn = 1", ("qa", "clean"))
def _(t):
    return QA.first_of_each(clean(t)).select("ord", "qa_hash")


@query("w06_sessions", "SELECT user_id, event_id, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS grp FROM (SELECT user_id, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS changed FROM events)")
def _(t):
    return S.consecutive_groups(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", F.col("group").cast("bigint").alias("grp"))


_LINE_WORDS = r"len(list_filter(string_split(trim(regexp_replace(p, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
#: Recursion over the lines of a text: the chunk that a line falls into, and the words of that chunk so far.
_CHUNKS = f"""WITH RECURSIVE parts AS (SELECT doc_id, i, p, {_LINE_WORDS} AS n FROM (SELECT doc_id, unnest(ls) AS p, generate_subscripts(ls, 1) AS i FROM
  (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents))),
step AS (SELECT doc_id, i, 0 AS chunk, n AS total FROM parts WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN s.total + p.n <= 60 THEN s.chunk ELSE s.chunk + 1 END, CASE WHEN s.total + p.n <= 60 THEN s.total + p.n ELSE p.n END FROM step s JOIN parts p ON p.doc_id = s.doc_id AND p.i = s.i + 1)"""


@query("w07_greedy_chunks", _CHUNKS + " SELECT s.doc_id, CAST(s.chunk AS INTEGER) AS i, string_agg(p.p, ' ' ORDER BY p.i) AS chunk FROM step s JOIN parts p ON p.doc_id = s.doc_id AND p.i = s.i GROUP BY s.doc_id, s.chunk")
def _(t):
    return t.documents.select("doc_id", F.posexplode(S.greedy_chunks(F.filter(F.split("text", "\n"), lambda x: x != ""), 60)).alias("i", "chunk"))


@query("w07_chunk_totals", _CHUNKS + " SELECT d.doc_id, count(DISTINCT s.chunk) AS chunks, coalesce(sum(p.n), 0)::BIGINT AS n_words, coalesce(max(s.total), 0)::BIGINT AS longest FROM documents d LEFT JOIN step s ON s.doc_id = d.doc_id LEFT JOIN parts p ON p.doc_id = s.doc_id AND p.i = s.i GROUP BY d.doc_id")
def _(t):
    chunks = S.greedy_chunks(F.filter(F.split("text", "\n"), lambda x: x != ""), 60)
    rows = t.documents.select("doc_id", F.transform(chunks, lambda c: F.size(X.words(c))).alias("sizes"))
    total = F.aggregate("sizes", L(0), lambda a, n: a + n).cast("bigint")
    return rows.select("doc_id", F.size("sizes").cast("bigint").alias("chunks"), total.alias("n_words"), F.coalesce(F.array_max("sizes"), L(0)).cast("bigint").alias("longest"))


@query("w07_stride", r"SELECT doc_id, CAST(ceil(n / 16.0) AS BIGINT) AS chunks FROM (SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.size(S.strided(X.words(F.col("text")), 16)).cast("bigint").alias("chunks"))


@query("w08_token_blocks", "SELECT place // 128 AS block, CAST(sum(token) AS BIGINT) AS total, max(token) AS most, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place, l_suppkey AS token FROM lineitem) WHERE place // 128 < (SELECT count(*) // 128 FROM lineitem) GROUP BY 1")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("token"))
    blocks = S.token_blocks(rows, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("token")], 128)
    return blocks.select("block", F.aggregate("ids", L(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max("ids").alias("most"), F.size("ids").cast("bigint").alias("n"))


@query(
    "w09_carried_descriptions",
    "SELECT p_brand, owner AS p_partkey, max(sign_number) AS sign_number, string_agg(p_name, ' ' ORDER BY p_partkey) AS description FROM (SELECT *, min(CASE WHEN sign_number IS NOT NULL THEN p_partkey END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner FROM (SELECT p_brand, p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS sign_number FROM part)) WHERE owner IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    rows = t.part.select("p_brand", "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).alias("sign_number"), F.col("p_name").alias("description"))
    return S.carried_descriptions(rows, "p_brand", "p_partkey")


@query("w12_sample_ids", "SELECT ord, row_number() OVER (ORDER BY ord) AS sample_id, CASE WHEN length(paragraph) > 500 THEN substr(paragraph, 1, 500) || '...' ELSE paragraph END AS paragraph FROM clean", ("qa", "clean"))
def _(t):
    from lexmill.operators.order import global_index

    rows = global_index(clean(t), [F.col("ord")], "_n")
    return rows.select("ord", (F.col("_n") + 1).alias("sample_id"), F.when(F.length("paragraph") > 500, F.concat(F.substring("paragraph", 1, 500), L("..."))).otherwise(F.col("paragraph")).alias("paragraph"))


@query("w14_marked_spans", "SELECT p_partkey, '§ 1 foo ' || p_name || '|§ ' || p_size || ' bar' AS spans, 'Intro|§ 1 foo ' || p_name || '|§ ' || p_size || ' bar' AS with_prefix FROM part")
def _(t):
    text = F.concat(L("Intro § 1 foo "), "p_name", L(" § "), F.col("p_size").cast("string"), L(" bar"))
    return t.part.select("p_partkey", F.array_join(S.marked_spans(text, S.PARAGRAPH), "|").alias("spans"), F.array_join(S.marked_spans(text, S.PARAGRAPH, True), "|").alias("with_prefix"))


@query("g01_segments", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '§ 1 a|(1) b ' || p_name || '|(2) c' ELSE '§ ' || p_size || ' one two Three four|Five six ' || p_name || ' x' END AS segments FROM part")
def _(t):
    even = F.concat(L("lost § 1 a (1) b "), "p_name", L(" (2) c"))
    odd = F.concat(L("§ "), F.col("p_size").cast("string"), L(" one two. Three four. Five six "), "p_name", L(" x"))
    text = F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)
    parts = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.array(L("§ 1 a")), F.filter(S.segments(text, 6), lambda s: s != "§ 1 a"))).otherwise(S.segments(text, 6))
    return t.part.select("p_partkey", F.array_join(parts, "|").alias("segments"))


_REAL = r"flatten(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:64], lambda l: list_transform(list_filter(string_split(trim(regexp_replace(l, '\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:128], lambda w: length(w))))"


@query("g02_padded_segments", f"SELECT doc_id, 64 AS segments, 128 AS width, coalesce(list_sum({_REAL}), 0)::BIGINT AS id_sum, len({_REAL})::BIGINT AS mask_sum FROM documents")
def _(t):
    from lexmill.functions.vectors import padded

    lines = F.slice(F.concat(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.array_repeat(L(""), 64)), 1, 64)
    both = F.transform(lines, lambda s: padded(F.transform(X.words(s), F.length), 128, L(0)))
    total = lambda name: F.aggregate(F.flatten(F.transform("x", lambda p: p[name])), L(0).cast("bigint"), lambda a, v: a + v)
    rows = t.documents.select("doc_id", both.alias("x"))
    return rows.select("doc_id", F.size("x").alias("segments"), F.array_max(F.transform("x", lambda p: F.size(p["ids"]))).alias("width"), total("ids").alias("id_sum"), total("mask").alias("mask_sum"))


@query("j14_near_duplicates")
def _(t):
    rows = QA.first_of_each(clean(t)).select("ord", "question", "answer", "paragraph_id")
    return QA.near_duplicates_removed(rows).select("ord", "paragraph_id")


@query("t01_order_by", "SELECT ord, f1_macro FROM ledger ORDER BY f1_macro DESC, ord", ("ledger",))
def _(t):
    return ledger(t).select("ord", "f1_macro").orderBy(F.desc("f1_macro"), "ord")


@query("t02_top_rows", "SELECT ord, f1_macro FROM ledger ORDER BY f1_macro DESC, ord LIMIT 10", ("ledger",))
def _(t):
    return ledger(t).select("ord", "f1_macro").orderBy(F.desc("f1_macro"), "ord").limit(10)


@query("t03_early_stop", "SELECT least(count(*), 100) AS n, (SELECT count(*) FROM qa) AS of_all, 0 AS foreign_rows FROM qa", ("qa",))
def _(t):
    # A producer stops after 100 records, whichever these are: so many come, and each of them is a record.
    taken = qa(t).select("ord").limit(100)
    strange = taken.join(qa(t).select("ord"), "ord", "left_anti").agg(F.count("*").cast("int").alias("foreign_rows"))
    return taken.agg(F.count("*").alias("n")).crossJoin(qa(t).agg(F.count("*").alias("of_all"))).crossJoin(strange)


@query("t04_shuffle", "SELECT ord, row_number() OVER (ORDER BY md5('42|' || ord), ord) AS place FROM clean", ("qa", "clean"))
def _(t):
    rows = clean(t).select("ord").withColumn("_d", P.draw(42, F.col("ord")))
    return P.numbered(rows, [F.col("_d"), F.col("ord")], "_p").select("ord", (F.col("_p") + 1).alias("place"))


@query("t05_prefix_split", "SELECT ord, CASE WHEN place < floor(n * 0.1) THEN 'test' WHEN place < floor(n * 0.1) + floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM (SELECT ord, row_number() OVER (ORDER BY md5('42|' || ord), ord) - 1 AS place, count(*) OVER () AS n FROM clean)", ("qa", "clean"))
def _(t):
    return P.prefix_split(clean(t).select("ord"), 42, F.col("ord"), [("test", 0.1), ("val", 0.1), ("train", 0.8)])


@query("t06_group_split", "SELECT ord, paragraph_id, CASE WHEN place < floor(n * 0.84) THEN 'train' ELSE 'test' END AS split FROM clean JOIN (SELECT paragraph_id, row_number() OVER (ORDER BY md5('42|' || paragraph_id), paragraph_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT paragraph_id FROM clean)) USING (paragraph_id)", ("qa", "clean"))
def _(t):
    return P.group_split(clean(t).select("ord", "paragraph_id"), "paragraph_id", 42, 0.16)


@query("t07_two_stage_split", "SELECT ord, CASE WHEN place < floor(n * 0.4) THEN 'train' WHEN place < floor(n * 0.4) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT ord, row_number() OVER (ORDER BY md5('7|' || ord), ord) - 1 AS place, count(*) OVER () AS n FROM clean)", ("qa", "clean"))
def _(t):
    return P.prefix_split(clean(t).select("ord"), 7, F.col("ord"), [("train", 0.4), ("val", 0.1), ("test", 0.5)])


@query("t08_stratified", "SELECT ord, label FROM (SELECT ord, label, CASE WHEN rn > (SELECT greatest(1, 60 // count(*)) FROM (SELECT DISTINCT label FROM clean)) THEN 1 ELSE 0 END AS later, d FROM (SELECT ord, label, md5('42|' || ord) AS d, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || ord), ord) AS rn FROM clean)) ORDER BY later, d, ord LIMIT 60", ("qa", "clean"))
def _(t):
    return P.stratified(clean(t).select("ord", "label"), ["label"], 60, 42, "ord")


@query("t09_balanced", "SELECT ord, label FROM (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY ord) AS rn FROM clean) WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM clean GROUP BY label))", ("qa", "clean"))
def _(t):
    return P.balanced(clean(t).select("ord", "label"), "label", "ord")


@query("u01_union_all", "SELECT ord, f1_macro, NULL::DOUBLE AS runtime FROM ledger UNION ALL SELECT event_id, NULL, value FROM events", ("ledger",))
def _(t):
    return QA.union_by_name([ledger(t).select("ord", "f1_macro"), t.events.select(F.col("event_id").alias("ord"), F.col("value").alias("runtime"))])


@query("u03_intersection", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("u04_difference", "SELECT CAST(p_size AS BIGINT) AS k FROM part EXCEPT SELECT n_nationkey FROM nation")
def _(t):
    return t.part.select(F.col("p_size").cast("bigint").alias("k")).distinct().join(t.nation.select(F.col("n_nationkey").cast("bigint").alias("k")), "k", "left_anti")


@query("u05_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()
