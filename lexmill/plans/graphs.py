"""Citations, graphs and lookups (S01 to S07, W05, J01 to J07, J11 to J17, J20, A11 to A13, SNK04 to SNK08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import citations as C
from lexmill.functions import text as X
from lexmill.operators import graph as G
from lexmill.operators.boundary import memoised_apply
from lexmill.operators.order import spread

from .base import clean, edges, exam, nodes, query

L = F.lit


def _s(name: str):
    return F.col(name).cast("string")


def _lines(t, *columns: str):
    """Line items by key with some of their columns, spread over all tasks: what is tagged is made of them."""
    return spread(t.lineitem.select("l_orderkey", "l_linenumber", *columns))


#: Kinds of sentences, by l_orderkey % 6.
_SIGNS = """CASE l_orderkey % 6
  WHEN 0 THEN 'Nach Zeichen ' || array_to_string(list_transform(range(l_partkey, l_partkey + 3), lambda i: '<sign>' || i || '</sign>'), ', ') || ', <sign>' || l_suppkey || '.' || l_linenumber || '</sign> gilt Zeichen <sign>7</sign>.'
  WHEN 1 THEN 'Zeichen <sign>' || l_partkey || '</sign>, <sign>' || l_suppkey || '</sign>, <sign>7.1</sign>; Zeichen <sign>1</sign>'
  WHEN 2 THEN 'Das Zeichen  gilt'
  WHEN 3 THEN 'Zeichenkette ' || l_partkey || ', Verkehrszeichen ' || l_suppkey || ' und Zeichen'
  WHEN 4 THEN 'Zeichen <sign>' || l_partkey || '</sign>a'
  ELSE 'Zeichen <sign>1</sign>, <sign>2</sign>, <sign>' || l_suppkey || '</sign> und' END"""


@query("s01_tag_signs", f"SELECT l_orderkey, l_linenumber, {_SIGNS} AS tagged FROM lineitem")
def _(t):
    part, supp, line, k = _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber"), F.col("l_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(L("Nach Zeichen "), part, L(" bis "), (F.col("l_partkey") + 2).cast("string"), L(" und "), supp, L("."), line, L(" gilt zeichen 7.")))
        .when(k == 1, F.concat(L("Zeichen "), part, L(", "), supp, L(" oder 7.1; ZEICHEN 1")))
        .when(k == 2, "Das Zeichen 9 bis 3 gilt")
        .when(k == 3, F.concat(L("Zeichenkette "), part, L(", Verkehrszeichen "), supp, L(" und Zeichen")))
        .when(k == 4, F.concat(L("Zeichen "), part, L("a")))
        .otherwise(F.concat(L("Zeichen 1 bis 2 oder "), supp, L(" und")))
    )
    return _lines(t, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", C.tag_signs(text).alias("tagged"))


_PARAGRAPHS = """CASE l_orderkey % 5
  WHEN 0 THEN 'gemäß <par>§ ' || l_suppkey || 'a</par>  Absatz <sen>' || l_linenumber || '</sen>, nach <par>§ 3</par> Absatz <sen>2</sen> und <par>'
      || array_to_string(list_transform(range(l_suppkey, l_suppkey + 3), lambda i: '<par>§ ' || i || '</par>'), ', ') || '</par>; Absatz <sen>1</sen>, <sen>2</sen>, <sen>3</sen> §<par>§ 2</par> und 3'
  WHEN 1 THEN '<par>§ 3</par> Absatz <sen>' || l_linenumber || '</sen> Satz 1'
  WHEN 2 THEN '<par>§ ' || l_suppkey || '</par> Absatz <sen>1</sen>, <sen>2</sen>, <par>§ ' || l_partkey || 'b</par> Nummer 4'
  WHEN 3 THEN '<par></par> Absatz ' || ' ohne §'
  ELSE '<par>§ 7</par> nach <par>§ 7</par>  Absatz <sen>' || l_linenumber || 'a</sen> und <par>§ 3</par> Absatz <sen>9</sen>' END"""


@query("s02_tag_paragraphs", f"SELECT l_orderkey, l_linenumber, {_PARAGRAPHS} AS tagged FROM lineitem")
def _(t):
    part, supp, line, k = _s("l_partkey"), _s("l_suppkey"), _s("l_linenumber"), F.col("l_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(L("gemäß § "), supp, L("a Absatz "), line, L(", nach Absatz 2 und §§ "), supp, L(" bis "), (F.col("l_suppkey") + 2).cast("string"), L("; Absatz 1 bis 3 §§ 2 und 3")))
        .when(k == 1, F.concat(L("Absatz "), line, L(" Satz 1")))
        .when(k == 2, F.concat(L("§ "), supp, L(" Absatz 1 bis 2, §"), part, L("b Nummer 4")))
        .when(k == 3, "§§ 9 bis 4 Absatz  ohne §")
        .otherwise(F.concat(L("§ 7 nach § 7 Absatz "), line, L("a und Absatz 9")))
    )
    return _lines(t, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", C.tag_paragraphs(text, L("§ 3")).alias("tagged"))


@query("s03_tag_tables", "SELECT p_partkey, array_to_string(list_transform(range(p_size, p_size + 2), lambda i: 'Anlage <tab>' || i || '</tab>'), ', ') || ' Abschnitt <sec>' || p_partkey || '</sec>, Anlage <tab>9</tab>' AS tagged FROM part")
def _(t):
    text = F.concat(L("Anlagen "), _s("p_size"), L(" bis "), (F.col("p_size") + 1).cast("string"), L(" Abschnitt "), _s("p_partkey"), L(", Anlage 9"))
    return t.part.select("p_partkey", C.tag_tables(text).alias("tagged"))


@query("s04_tag_leaves", "SELECT p_partkey, 'Zeichen <sign>' || p_size || '</sign> nach <par>§ ' || p_partkey || '</par>, Anlage <tab>2</tab>' AS tagged FROM part")
def _(t):
    return t.part.select("p_partkey", C.tag_all(F.concat(L("Zeichen "), _s("p_size"), L(" nach § "), _s("p_partkey"), L(", Anlage 2"))).alias("tagged"))


def _tagged():
    return F.concat(L("<par>§ 5</par> <sen>1</sen> <par>§ "), F.col("l_suppkey").cast("string"), L("</par> <par>§ 5</par> <sen>"), F.col("l_linenumber").cast("string"), L("</sen> <par>§ 5a</par> <sign>"), F.col("l_partkey").cast("string"), L("</sign> <tab>1</tab> <sec>2</sec> <tab>3</tab>"))



@query(
    "s05_tag_extraction",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS signs, CASE WHEN l_suppkey = 5 THEN '' ELSE '§ ' || l_suppkey END AS standalone, '§ 5>' || l_linenumber AS sentence_pairs, '1>2' AS section_pairs, '3' AS standalone_tables FROM lineitem""",
)
def _(t):
    rows = _lines(t, "l_suppkey", "l_partkey").select("l_orderkey", "l_linenumber", C.tag_report(_tagged()).alias("r"))
    pairs = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(">", p["parent"], p["child"])), "|")
    joined = lambda c: F.array_join(c, ",")
    return rows.select(
        "l_orderkey", "l_linenumber", joined("r.signs").alias("signs"), joined("r.paragraphs").alias("standalone"), pairs("r.sentence_pairs").alias("sentence_pairs"),
        pairs("r.section_pairs").alias("section_pairs"), joined("r.tables").alias("standalone_tables"),
    )


@query(
    "w05_reset_scan",
    """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN CASE WHEN l_suppkey = 7 THEN '§ 7>3' ELSE '§ 7>1|§ ' || l_suppkey || '>3' END
      WHEN 1 THEN '§ 9>2|§ 7>5|§ 7>6' WHEN 2 THEN '' ELSE '§ 7>1|§ 7>1|§ 7>' || l_linenumber END AS pairs FROM lineitem""",
)
def _(t):
    k = F.col("l_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(L("<sen>0</sen><par>§ 7</par><sen>1</sen><par>§ "), _s("l_suppkey"), L("</par><sen>3</sen>")))
        .when(k == 1, "<par>§ 7</par><sen>1</sen><par>§ 9</par><sen>2</sen><par>§ 7</par><sen>5</sen><sen>6</sen>")
        .when(k == 2, "<sen>1</sen><par>§ 7</par> und <par>§ 8a</par>")
        .otherwise(F.concat(L("<par>§ 7</par><sen>1</sen><par>§ 8a</par><sen>1</sen><sen>"), _s("l_linenumber"), L("</sen>")))
    )
    return _lines(t, "l_suppkey").select("l_orderkey", "l_linenumber", F.array_join(F.transform(C.reset_pairs(text, "par", "sen"), lambda p: F.concat_ws(">", p["parent"], p["child"])), "|").alias("pairs"))


@query("s06_images", "SELECT p_partkey, 'a' || p_size || '.png' AS images, p_name || ' end' AS rest FROM part")
def _(t):
    text = F.concat(L("<img>a"), _s("p_size"), L(".png</img>"), "p_name", L(" end"))
    return t.part.select("p_partkey", F.array_join(C.image_names(text), ",").alias("images"), C.strip_images(text).alias("rest"))


@query("s07_first_sign", "SELECT p_partkey, 'Zeichen ' || p_size AS found, p_name AS rest FROM part")
def _(t):
    text = F.concat(L("Zeichen "), _s("p_size"), L(" "), "p_name", L(" Zeichen 1"))
    return t.part.select("p_partkey", X.first_mark(text, r"Zeichen\s+\d+(?:\.\d+)?").alias("x")).select("p_partkey", "x.found", "x.rest")


@query("s33_map_leaves", "SELECT p_brand AS table_name, p_type AS section, p_partkey AS sign, CASE WHEN p_partkey % 5 = 0 THEN 'Sign ' || p_partkey ELSE upper(p_name) END AS name FROM part")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("section"), F.col("p_partkey").alias("sign"), "p_name")
    done = memoised_apply(rows, "p_name", lambda texts: [x.upper() for x in texts], "upper")
    return done.select("table_name", "section", "sign", F.when(F.col("sign") % 5 == 0, F.concat(L("Sign "), F.col("sign").cast("string"))).otherwise(F.col("upper")).alias("name"))


@query("j01_tree_edges", "SELECT DISTINCT p_brand AS src, p_brand || '__' || p_type AS dst, 'has_section' AS relation FROM part UNION ALL SELECT p_brand || '__' || p_type, CAST(p_partkey AS VARCHAR), 'has_sign' FROM part")
def _(t):
    rows = t.part.select("p_brand", X.node_id(F.col("p_brand"), F.col("p_type")).alias("section"), _s("p_partkey").alias("sign"))
    return G.flatten_tree(rows, [("table", "p_brand"), ("section", "section"), ("sign", "sign")], ["has_section", "has_sign"])


@query("j02_citation_edges", "SELECT DISTINCT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'has_paragraph' ELSE 'has_sentence' END AS relation FROM lineitem WHERE 's' || l_suppkey IN (SELECT id FROM nodes)", ("nodes",))
def _(t):
    tags = t.lineitem.select(F.concat(L("o"), _s("l_orderkey")).alias("src"), F.when(F.col("l_linenumber") % 2 == 0, "par").otherwise("sen").alias("kind"), F.concat(L("s"), _s("l_suppkey")).alias("target"))
    return G.citation_edges(tags, nodes(t))


@query("j03_labelled_triples", "SELECT a.label AS h, coalesce(relation, 'unknown_relation') AS r, b.label AS t FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.label <> 'No Content' AND b.label <> 'No Content'", ("nodes", "edges"))
def _(t):
    return G.labelled_triples(edges(t), nodes(t))


@query("j04_substitute_labels", "SELECT l_orderkey, l_linenumber, 'siehe <par>' || n_name || '</par>, <sen>3</sen>' AS text FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    text = F.concat(L("siehe <par>§ "), _s("s_nationkey"), L("</par>, <sen>3</sen>"))
    labels = t.nation.select(F.concat(L("§ "), _s("n_nationkey")).alias("id"), F.col("n_name").alias("label"))
    # Order and line do not tell rows apart in this table, so the row's other columns join the key.
    keyed = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_suppkey", text.alias("text"))
    return G.substituted(keyed, [c for c in keyed.columns if c != "text"], "text", "par", labels).select("l_orderkey", "l_linenumber", "text")


@query("j05_parent_labels", "SELECT s_name AS text, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0")
def _(t):
    parent = F.when(F.col("s_suppkey") % 4 == 0, "none").otherwise(F.concat(L("n"), _s("s_nationkey")))
    return G.parent_labels(t.supplier.select(parent.alias("parent"), F.col("s_name").alias("text")), nodes(t))


@query("j07_anchor_embeddings", "SELECT a.id AS anchor, b.id AS positive, round(list_dot_product(a.v, b.v), 6) AS dot FROM vec a JOIN vec b ON b.id = a.id + 1", ("vec",))
def _(t):
    from lexmill.functions import vectors as V

    from .base import vectors

    a = vectors(t).select(F.col("id").alias("anchor"), F.col("v").alias("va"), (F.col("id") + 1).alias("positive"))
    last = vectors(t).agg(F.max("id").alias("last"))  # the one anchor that has no successor
    rows = G.required(a.crossJoin(F.broadcast(last)).filter("anchor <> last"), vectors(t).select(F.col("id").alias("positive"), F.col("v").alias("vb")), "positive")
    return rows.select("anchor", "positive", F.round(V.dot(F.col("va"), F.col("vb")), 6).alias("dot"))


@query(
    "j11_split_disjoint",
    """SELECT paragraph_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, false AS shared FROM clean JOIN
      (SELECT paragraph_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || paragraph_id), paragraph_id) - 1 < floor(count(*) OVER () * 0.84) THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT paragraph_id FROM clean))
      USING (paragraph_id) GROUP BY paragraph_id""",
    ("qa", "clean"),
)
def _(t):
    from lexmill.operators.sampling import group_split

    parts = group_split(clean(t), "paragraph_id", 42, 0.16)
    rows = parts.groupBy("paragraph_id").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    return rows.withColumn("shared", (F.col("train") > 0) & (F.col("test") > 0))


@query("j12_missing_images", "SELECT qid, 'img' || qid AS stem FROM exam WHERE image IS NOT NULL AND 'img' || qid NOT IN (SELECT 'img' || p_size FROM part)", ("exam",))
def _(t):
    wanted = exam(t).filter("image IS NOT NULL").select("qid", X.file_stem(F.col("image")).alias("stem"))
    return wanted.join(t.part.select(F.concat(L("img"), _s("p_size")).alias("stem")).distinct(), "stem", "left_anti").select("qid", "stem")


@query("j13_prefix_pairs", "SELECT 'm' || n_nationkey AS base, 'm' || s_nationkey || '_' || s_suppkey AS tuned FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def _(t):
    tuned = t.supplier.select(F.concat(L("m"), _s("s_nationkey"), L("_"), _s("s_suppkey")).alias("tuned"))
    base = t.nation.select(F.concat(L("m"), _s("n_nationkey")).alias("base"))
    # The prefix up to the mark is the key, so the join is an equality and each tuned model has one base.
    return base.join(tuned.withColumn("base", F.substring_index("tuned", "_", 1)), "base").select("base", "tuned")


@query("j15_neighbours", "SELECT src AS id, dst AS neighbour, label FROM edges JOIN nodes ON dst = id", ("nodes", "edges"))
def _(t):
    return edges(t).join(nodes(t), F.col("dst") == F.col("id")).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "label")


@query("j16_simple_paths", "SELECT src || '>' || dst AS path, 2 AS n_nodes FROM edges UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src AND b.dst <> a.src", ("edges",))
def _(t):
    return G.simple_paths(edges(t), 3)


@query("j17_reachable", "SELECT 'r1' AS id, 0 AS depth UNION ALL SELECT dst, 1 FROM edges WHERE src = 'r1' UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'r1'", ("edges",))
def _(t):
    return G.reachable(edges(t), nodes(t).filter("id = 'r1'").select("id"), 3)


@query("j20_dictionary", "SELECT s_suppkey, dense_rank() OVER (ORDER BY s_name) - 1 AS name_id, coalesce(n.id, 0) AS nation_id FROM supplier LEFT JOIN (SELECT n_name, n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation) n ON s_nationkey = n_nationkey")
def _(t):
    names = G.dictionary(t.supplier, "s_name").withColumnsRenamed({"value": "s_name", "id": "name_id"})
    nations = G.dictionary(t.nation, "n_name").withColumnsRenamed({"value": "n_name", "id": "nation_id"})
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(names, "s_name").join(nations, "n_name", "left")
    return rows.select("s_suppkey", "name_id", F.coalesce("nation_id", L(0)).alias("nation_id"))


@query("a11_graph_statistics", "SELECT count(*) AS n_nodes, CAST(sum(d) AS BIGINT) AS n_edges, round(sum(d) / count(*), 9) AS edges_per_node, min(d) AS min_degree, max(d) AS max_degree FROM (SELECT id, count(dst) AS d FROM nodes LEFT JOIN edges ON src = id GROUP BY id)", ("nodes", "edges"))
def _(t):
    return G.statistics(nodes(t), edges(t))


@query("a12_top_relations", "SELECT coalesce(relation, 'unknown') AS relation, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5", ("edges",))
def _(t):
    return edges(t).groupBy(F.coalesce("relation", L("unknown")).alias("relation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(5)


@query("a13_duplicates", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query("u02_disjoint_union", "SELECT id, label FROM nodes", ("nodes",))
def _(t):
    rows = nodes(t)
    return G.disjoint_union(rows.filter("kind = 'category'"), rows.filter("kind <> 'category'")).select("id", "label")


@query("g_upsert_nodes", "SELECT id, arg_max(label, ord) AS label FROM (SELECT CAST(p_size AS VARCHAR) AS id, p_name AS label, p_partkey AS ord FROM part) GROUP BY id")
def _(t):
    rows = t.part.select(_s("p_size").alias("id"), L("sign").alias("kind"), F.col("p_name").alias("label"), F.col("p_partkey").alias("ord"))
    return G.upserted(rows).select("id", "label")


@query("g_single_edges", "SELECT l_suppkey AS src, l_linenumber AS dst, arg_max(l_returnflag, l_orderkey * 1000000 + l_partkey) AS relation FROM lineitem GROUP BY 1, 2")
def _(t):
    return G.single_edges(t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("ord")))


@query("snk04_triple_lines", "SELECT a.label || ' <tr> ' || coalesce(relation, 'unknown_relation') || ' <tr> ' || b.label AS line FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.label <> 'No Content' AND b.label <> 'No Content'", ("nodes", "edges"))
def _(t):
    return G.labelled_triples(edges(t), nodes(t)).select(G.triple_line(F.col("h"), F.col("r"), F.col("t")).alias("line"))


@query("snk05_dot", """SELECT 'digraph G {' AS line UNION ALL SELECT '  "' || id || '" [label="' || label || '"];' FROM nodes UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="' || relation || '"];' FROM edges WHERE relation IS NOT NULL UNION ALL SELECT '}'""", ("nodes", "edges"))
def _(t):
    return G.dot_lines(nodes(t), edges(t).filter("relation IS NOT NULL")).select("line")


@query("snk06_raw_text", "SELECT label AS line FROM nodes ORDER BY ord", ("nodes",))
def _(t):
    return nodes(t).orderBy("ord").select(F.col("label").alias("line"))


@query("snk07_nested_text", "SELECT r_name AS category, '<category>' || r_name || string_agg('<paragraph>' || n_name || '</paragraph>', '' ORDER BY n_nationkey) || '</category>' AS xml FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _(t):
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("category"))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda p: F.concat(L("<paragraph>"), p["n_name"], L("</paragraph>")))
    return rows.agg(F.concat(L("<category>"), F.first("r_name"), F.array_join(inner, ""), L("</category>")).alias("xml"))


@query("snk08_adjacency", "SELECT src, string_agg(dst || ':' || coalesce(relation, ''), ',' ORDER BY dst) AS neighbours FROM edges GROUP BY src", ("edges",))
def _(t):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", F.coalesce("relation", L("")).alias("r")))), lambda e: F.concat_ws(":", e["dst"], e["r"])), ",")
    return edges(t).groupBy("src").agg(listed.alias("neighbours"))
