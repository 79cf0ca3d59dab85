"""Property graphs as nodes(id, kind, label, ord) and edges(src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(nodes: DataFrame) -> DataFrame:
    """One row for each id: the last write by ord."""
    return nodes.groupBy("id").agg(F.max_by(F.struct("kind", "label", "ord"), "ord").alias("n")).select("id", "n.*")


def single_edges(edges: DataFrame) -> DataFrame:
    """One relation for each pair of nodes: the last written by ord."""
    return edges.groupBy("src", "dst").agg(F.max_by("relation", "ord").alias("relation"))


def flatten_tree(rows: DataFrame, levels: list[tuple[str, str]], relations: list[str]) -> DataFrame:
    """Edges between neighbouring id columns of a flattened tree: levels are (kind, id column) from the root down."""
    found = None
    for (_, parent), (_, child), relation in zip(levels, levels[1:], relations):
        part = rows.select(F.col(parent).alias("src"), F.col(child).alias("dst"), F.lit(relation).alias("relation")).distinct()
        found = part if found is None else found.unionByName(part)
    return found


def citation_edges(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """tags(src, kind, target) whose target is a node become edges named after the kind; others are dropped."""
    relation = F.when(F.col("kind") == "par", "has_paragraph").when(F.col("kind") == "sen", "has_sentence").when(F.col("kind") == "tab", "has_table").when(F.col("kind") == "sec", "has_section").otherwise("has_sign")
    return tags.join(nodes.select(F.col("id").alias("target")).distinct(), "target").select("src", F.col("target").alias("dst"), relation.alias("relation")).distinct()


def labelled_triples(edges: DataFrame, nodes: DataFrame, drop_label: str | None = "No Content") -> DataFrame:
    """(h, r, t): labels of both ends; a missing relation is unknown_relation; triples with drop_label go."""
    names = lambda k: nodes.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label"))
    rows = edges.join(names("src"), "src").join(names("dst"), "dst")
    rows = rows.select(F.col("src_label").alias("h"), F.coalesce("relation", F.lit("unknown_relation")).alias("r"), F.col("dst_label").alias("t"))
    return rows if drop_label is None else rows.filter((F.col("h") != drop_label) & (F.col("t") != drop_label))


def substituted(texts: DataFrame, key: list[str], column: str, kind: str, nodes: DataFrame, bare: bool = False) -> DataFrame:
    """texts with each <kind>id</kind> whose id is a node replaced by its label, inside the tags or (bare) without them.

    Ids meet labels in a join, so the node table may have any size. Keys must tell rows apart; rows without tags stay as they are.
    """
    pattern = rf"<{kind}>(.*?)</{kind}>"
    pieces = F.arrays_zip(F.split(column, pattern).alias("before"), F.regexp_extract_all(column, F.lit(pattern), F.lit(1)).alias("id"))
    rows = texts.select(*key, F.posexplode(pieces).alias("place", "p")).select(*key, "place", "p.before", "p.id")
    rows = rows.join(nodes.select("id", "label"), "id", "left")
    inside = F.coalesce("label", "id")
    tagged = F.concat(F.lit(f"<{kind}>"), inside, F.lit(f"</{kind}>"))
    shown = F.when(F.col("id").isNull(), "").when(F.col("label").isNotNull() & F.lit(bare), F.col("label")).otherwise(tagged)
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat("before", shown).alias("t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(listed, lambda e: e["t"]), "").alias(column))


def required(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table by key; a key that the table lacks is an error, raised when the row is read."""
    found = rows.join(table.withColumn("_found", F.lit(True)), key, "left")
    known = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return found.withColumn(key, known).drop("_found")


def parent_labels(sentences: DataFrame, parents: DataFrame) -> DataFrame:
    """The clustering set: each sentence's text with its parent's label, those without parent dropped."""
    return sentences.join(parents.select(F.col("id").alias("parent"), F.col("label").alias("parent_label")), "parent", "left").filter("parent_label IS NOT NULL").select("text", F.col("parent_label").alias("label"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, edges a node, least and greatest out-degree; nodes without edges count with 0."""
    degrees = nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degrees.agg(
        F.count("*").alias("n_nodes"), F.sum("d").alias("n_edges"), F.round(F.sum("d") / F.count("*"), 9).alias("edges_per_node"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree")
    )


def simple_paths(edges: DataFrame, max_nodes: int) -> DataFrame:
    """All paths of 2 to max_nodes different nodes along edges, joined by `>`; one join for each step."""
    step = edges.select("src", "dst").distinct()
    paths = step.filter("src <> dst").select(F.array("src", "dst").alias("path"))
    found = paths
    for _ in range(max_nodes - 2):
        ends = paths.withColumn("src", F.element_at("path", -1))
        paths = ends.join(step, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        found = found.unionByName(paths)
    return found.select(F.array_join("path", ">").alias("path"), F.size("path").alias("n_nodes"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth) of the nodes that the start nodes (id) reach within max_depth steps; each step joins the frontier alone."""
    step = edges.select("src", "dst").distinct()
    seen = start.select("id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        moved = frontier.join(step, frontier["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = moved.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a DOT file with their order."""
    from lexmill.functions.text import dot_quote

    head = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit("digraph G {").alias("line"))
    foot = nodes.sparkSession.range(1).select(F.lit(3).alias("part"), F.lit("").alias("key"), F.lit("}").alias("line"))
    vertex = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), dot_quote(F.col("id")), F.lit(" [label="), dot_quote(F.col("label")), F.lit("];")).alias("line"))
    arc = edges.select(
        F.lit(2).alias("part"), F.concat_ws(">", "src", "dst").alias("key"), F.concat(F.lit("  "), dot_quote(F.col("src")), F.lit(" -> "), dot_quote(F.col("dst")), F.lit(" [label="), dot_quote(F.col("relation")), F.lit("];")).alias("line")
    )
    return head.unionByName(vertex).unionByName(arc).unionByName(foot)


def triple_line(h: Column, r: Column, t: Column) -> Column:
    return F.concat_ws(" <tr> ", h, r, t)


def disjoint_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of two graphs; a shared id is an error, raised when the rows are read."""
    clash = a.select("id").intersect(b.select("id")).agg(F.count("*").alias("_clash"))
    both = a.unionByName(b).crossJoin(F.broadcast(clash))
    return both.withColumn("id", F.when(F.col("_clash") > 0, F.raise_error(F.lit("graphs share nodes"))).otherwise(F.col("id"))).drop("_clash")


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(value, id): dense ids from 0 in sorted order of the distinct values."""
    from lexmill.operators.order import global_index

    return global_index(values.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct(), [F.col("value")], "id")
