"""Vectors and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import vectors as V
from lexmill.operators import kge as K
from lexmill.operators.sampling import hash_pick

from .base import CTE, query
from .base import vectors as vec

L = F.lit
CTE["lib"] = "flat0 AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec), lib AS (SELECT label AS id, list(c ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS c FROM flat0 GROUP BY 1, 2) GROUP BY label)"
CTE["raw"] = """raw AS (SELECT s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS h, CAST(1 AS BIGINT) AS r, s_suppkey % 25 AS t,
  ('0x' || substr(md5('7|h|' || s_suppkey), 1, 8))::BIGINT % 25 AS ph, ('0x' || substr(md5('7|t|' || s_suppkey), 1, 8))::BIGINT % 25 AS pt FROM supplier)"""
CTE["trip"] = "trip AS (SELECT a.id AS id, a.v AS h, b.v AS r, c.v AS t FROM vec a JOIN vec b ON b.id = a.id + 1 JOIN vec c ON c.id = a.id + 2)"


def library(t):
    """A vector for each label: the mean of its members."""
    flat = vec(t).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("c"))
    return flat.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("v"))


def triples(t):
    side = lambda shift, name: vec(t).select((F.col("id") - shift).alias("id"), F.col("v").alias(name))
    return side(0, "h").join(side(1, "r"), "id").join(side(2, "t"), "id")


@query("n05_cosine", "SELECT id, round(list_dot_product(h, r), 6) AS dot, round(sqrt(list_dot_product(h, h)), 6) AS norm, round(list_dot_product(h, r) / (sqrt(list_dot_product(h, h)) * sqrt(list_dot_product(r, r))), 6) AS cosine FROM trip", ("vec", "trip"))
def _(t):
    h, r = F.col("h"), F.col("r")
    return triples(t).select("id", F.round(V.dot(h, r), 6).alias("dot"), F.round(V.norm(h), 6).alias("norm"), F.round(V.cosine(h, r), 6).alias("cosine"))


_Z = "list_transform(list_zip(h, r, t), lambda z: {})"
_G = "(z[1] + z[2] - z[3])"


@query("n07_transe", f"SELECT id, round(sqrt(list_sum({_Z.format(_G + ' * ' + _G)})), 6) AS l2, round(list_sum({_Z.format('abs' + _G)}), 6) AS l1 FROM trip", ("vec", "trip"))
def _(t):
    c = F.col
    return triples(t).select("id", F.round(V.trans_e(c("h"), c("r"), c("t")), 6).alias("l2"), F.round(V.trans_e(c("h"), c("r"), c("t"), 1), 6).alias("l1"))


@query("n08_distmult", f"SELECT id, round(-list_sum({_Z.format('z[1] * z[2] * z[3]')}), 6) AS score FROM trip", ("vec", "trip"))
def _(t):
    return triples(t).select("id", F.round(V.dist_mult(F.col("h"), F.col("r"), F.col("t")), 6).alias("score"))


_P = lambda a, b, c: f"list_sum(list_transform(list_zip({a}, {b}, {c}), lambda z: z[1] * z[2] * z[3]))"


@query("n09_complex", f"SELECT id, round(-({_P('h[1:32]', 'r[1:32]', 't[1:32]')} + {_P('h[1:32]', 'r[33:64]', 't[33:64]')} + {_P('h[33:64]', 'r[1:32]', 't[33:64]')} - {_P('h[33:64]', 'r[33:64]', 't[1:32]')}), 6) AS score FROM trip", ("vec", "trip"))
def _(t):
    return triples(t).select("id", F.round(V.compl_ex(F.col("h"), F.col("r"), F.col("t")), 6).alias("score"))


_RE, _IM = "(z[1] * cos(z[3]) - z[2] * sin(z[3]) - z[4])", "(z[1] * sin(z[3]) + z[2] * cos(z[3]) - z[5])"


@query("n10_rotate", f"SELECT id, round(list_sum(list_transform(list_zip(h[1:32], h[33:64], r[1:32], t[1:32], t[33:64]), lambda z: sqrt({_RE} * {_RE} + {_IM} * {_IM} + 1e-8))), 6) AS score FROM trip", ("vec", "trip"))
def _(t):
    return triples(t).select("id", F.round(V.rotat_e(F.col("h"), F.slice("r", 1, 32), F.col("t")), 6).alias("score"))


_PICK = lambda side, col: f"CASE WHEN p{side} = {col} THEN (p{side} + 1) % 25 ELSE p{side} END"


@query(
    "n11_negative_triples",
    f"""SELECT k, 'head' AS side, {_PICK('h', 'h')} AS h, r, t FROM raw UNION ALL SELECT k, 'tail', h, r, {_PICK('t', 't')} FROM raw""",
    ("raw",),
)
def _(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("h"), L(1).cast("bigint").alias("r"), (F.col("s_suppkey") % 25).alias("t"))
    return K.negatives(rows, 25, "k", 7)


@query("n12_losses", "SELECT id, round(greatest(0, c - 0.5), 6) AS apart, round(0.4 * (1 - c) + 0.6 * greatest(0, c - 0.5), 6) AS total FROM (SELECT id, list_dot_product(h, r) / (sqrt(list_dot_product(h, h)) * sqrt(list_dot_product(r, r))) AS c FROM trip)", ("vec", "trip"))
def _(t):
    same, apart = (K.cosine_embedding_loss(F.col("h"), F.col("r"), L(x)) for x in (True, False))
    return triples(t).select("id", F.round(apart, 6).alias("apart"), F.round(K.weighted_loss({"a": same, "b": apart}, {"a": 0.4, "b": 0.6}), 6).alias("total"))


@query("n13_concat", "SELECT id, len(list_concat(h, r)) AS width, round(list_sum(list_concat(h, r)), 6) AS total FROM trip", ("vec", "trip"))
def _(t):
    both = F.concat("h", "r")
    return triples(t).select("id", F.size(both).cast("bigint").alias("width"), F.round(V.total(both), 6).alias("total"))


@query("n14_pooling", "SELECT id, round((h[1] + r[1] + t[1]) / 3, 6) AS mean_first, greatest(h[2], r[2], t[2]) AS max_second, h[1] AS cls, 66 AS padded, 64 AS real FROM trip", ("vec", "trip"))
def _(t):
    rows = F.array("h", "r", "t")
    padded = V.padded(F.col("h"), 66, L(0.0))
    return triples(t).select(
        "id", F.round(V.mean_pool(rows, 64)[0], 6).alias("mean_first"), V.max_pool(rows)[1].alias("max_second"), F.col("h")[0].alias("cls"), F.size(padded["ids"]).alias("padded"),
        F.aggregate(padded["mask"], L(0), lambda a, x: a + x).alias("real"),
    )


@query("n15_pca")
def _(t):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vec(t).select("id", array_to_vector("v").alias("x"))
    out = PCA(k=2, inputCol="x", outputCol="y").fit(rows).transform(rows).select("id", vector_to_array("y").alias("y"))
    return out.select("id", F.round(F.abs(F.col("y")[0]), 6).alias("x"), F.round(F.abs(F.col("y")[1]), 6).alias("y"))


@query("n18_parameters", "SELECT count(*) * 64 AS parameters FROM vec", ("vec",))
def _(t):
    return vec(t).agg((F.count("*") * 64).alias("parameters"))


@query("n06_top_similar", "SELECT qid, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS place FROM (SELECT q.id AS qid, l.id AS id, round(list_dot_product(q.v, l.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(l.v, l.v))), 6) AS similarity FROM vec q, lib l)) WHERE place <= 3", ("vec", "lib"))
def _(t):
    return K.nearest(vec(t).select(F.col("id").alias("qid"), F.col("v").alias("q")), library(t), 3, small_library=True).withColumn("place", F.col("place").cast("bigint"))


@query("j09_paragraph_knn", "SELECT qid, id, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS place FROM (SELECT q.id AS qid, l.id AS id, round(list_dot_product(q.v, l.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(l.v, l.v))), 6) AS similarity FROM lib q, vec l)) WHERE place <= 5", ("vec", "lib"))
def _(t):
    queries = library(t).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return K.nearest(queries, vec(t).select("id", "v"), 5).select("qid", "id", F.col("place").cast("bigint").alias("place"))


@query(
    "j08_negative_sampling",
    """WITH pool AS (SELECT label AS candidate, row_number() OVER (ORDER BY label) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings)),
    placed AS (SELECT vec_id AS id, e.label, ('0x' || substr(md5('42|' || vec_id), 1, 8))::BIGINT % (SELECT max(n) FROM pool) AS place FROM embeddings e)
    SELECT id, label, CASE WHEN a.candidate <> label THEN a.candidate ELSE b.candidate END AS candidate FROM placed JOIN pool a ON a.slot = place JOIN pool b ON b.slot = (place + 1) % b.n""",
)
def _(t):
    rows = vec(t).select("id", "label")
    pool = rows.select(F.col("label").alias("candidate")).distinct()
    return hash_pick(rows, pool, "id", "candidate", F.col("candidate") != F.col("label"), 42).select("id", "label", "candidate")


@query(
    "j18_attention",
    """SELECT qid, CAST(i - 1 AS INTEGER) AS dim, round(sum(w * x) / sum(w), 6) AS value FROM (SELECT q.id AS qid, exp(list_dot_product(q.v, l.v) - max(list_dot_product(q.v, l.v)) OVER (PARTITION BY q.id)) AS w, l.v AS v FROM vec q, lib l) s,
       LATERAL (SELECT unnest(s.v) AS x, generate_subscripts(s.v, 1) AS i) GROUP BY 1, 2""",
    ("vec", "lib"),
)
def _(t):
    mixed = K.attention(vec(t).select(F.col("id").alias("qid"), F.col("v").alias("q")), library(t))
    return mixed.select("qid", F.posexplode("v").alias("dim", "value")).select("qid", "dim", F.round("value", 6).alias("value"))


@query("j18_gate", "SELECT id, round(list_sum(list_transform(list_zip(h, r, t), lambda z: 1 / (1 + exp(-z[1])) * z[3] + (1 - 1 / (1 + exp(-z[1]))) * z[2])), 6) AS total FROM trip", ("vec", "trip"))
def _(t):
    # The gate's weights are a model's; here its logits are a vector of the table.
    gate = F.transform("h", lambda x: 1 / (1 + F.exp(-x)))
    return triples(t).select("id", F.round(V.total(K.gated(F.col("r"), F.col("t"), gate)), 6).alias("total"))


@query("n07_norm_clamp", "SELECT id, round(list_sum(list_transform(w, lambda x: x / greatest(1, sqrt(list_dot_product(w, w))))), 6) AS total, round(least(1, sqrt(list_dot_product(w, w))), 6) AS length FROM (SELECT id, list_transform(v, lambda x: greatest(-1, least(1, x * (1 + id % 3)))) AS w FROM vec)", ("vec",))
def _(t):
    grown = F.transform("v", lambda x: x * (1 + F.col("id") % 3))
    rows = vec(t).select("id", V.clamped(grown).alias("w"))
    return rows.select("id", F.round(V.total(F.col("w")), 6).alias("total"), F.round(V.norm(F.col("w")), 6).alias("length"))


@query("a32_regularizer", "SELECT round(0.001 * sum(list_dot_product(v, v)) / count(*), 9) AS loss FROM vec", ("vec",))
def _(t):
    return K.l2_regularizer(vec(t).filter("id % 5 <> 0"), vec(t).filter("id % 5 = 0"), 0.001)


_SC = "scores AS (SELECT id // 128 AS batch, sqrt(list_sum(list_transform(list_zip(h, r, t), lambda z: (z[1] + z[2] - z[3]) ** 2))) AS p, (sqrt(list_sum(list_transform(list_zip(t, r, t), lambda z: (z[1] + z[2] - z[3]) ** 2))) + sqrt(list_sum(list_transform(list_zip(h, r, h), lambda z: (z[1] + z[2] - z[3]) ** 2)))) / 2 AS n FROM trip)"
CTE["scores"] = _SC


def _scores(t):
    c = F.col
    return triples(t).select(F.floor(c("id") / 128).alias("batch"), V.trans_e(c("h"), c("r"), c("t")).alias("positive"), V.trans_e(c("t"), c("r"), c("t")).alias("negative_head"), V.trans_e(c("h"), c("r"), c("h")).alias("negative_tail"))


@query("a32_validation_loss", "SELECT round(avg(loss), 6) AS val_loss FROM (SELECT batch, avg(greatest(0, p - n + 1)) AS loss FROM scores GROUP BY batch)", ("vec", "trip", "scores"))
def _(t):
    return K.validation_loss(_scores(t), "batch")


@query("a32_batch_metrics", "SELECT round(sum(1.0 / rank) / sum(n), 9) AS mrr, round(CAST(count(*) FILTER (rank <= 10) AS DOUBLE) / sum(n), 9) AS hits10 FROM (SELECT batch, count(*) FILTER (p < n) + 1 AS rank, count(*) AS n FROM scores GROUP BY batch)", ("vec", "trip", "scores"))
def _(t):
    return K.batch_ranks(_scores(t), "batch")


@query("j19_similar_pairs", "SELECT id, CASE WHEN list_dot_product(h, r) / (sqrt(list_dot_product(h, h)) * sqrt(list_dot_product(r, r))) > 0.1 THEN 'yes' ELSE 'no' END AS same FROM trip", ("vec", "trip"))
def _(t):
    return triples(t).select("id", F.when(V.cosine(F.col("h"), F.col("r")) > 0.1, "yes").otherwise("no").alias("same"))


_D = lambda v: f"sqrt(list_sum(list_transform(list_zip(q.target, {v}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(
    "a32_link_metrics",
    f"""SELECT round(avg(1.0 / rank), 9) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 9) AS hits10 FROM (
      SELECT q.id, 1 + count(*) FILTER ({_D('e.v')} < {_D('q.tv')} AND e.id <> q.tail) AS rank
      FROM (SELECT a.id, a.id + 2 AS tail, c.v AS tv, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS target FROM vec a JOIN vec b ON b.id = a.id + 1 JOIN vec c ON c.id = a.id + 2 WHERE a.id % 50 = 0) q, vec e GROUP BY q.id)""",
    ("vec",),
)
def _(t):
    # The stated query set: heads whose id is divisible by 50, against all entities.
    rows = triples(t).filter("id % 50 = 0").select(F.col("id").alias("qid"), (F.col("id") + 2).alias("t"), F.zip_with("h", "r", lambda a, b: a + b).alias("target"))
    return K.link_metrics(K.link_ranks(rows, vec(t).select("id", "v")))


@query("a32_margin_loss", f"SELECT round(avg(greatest(0, p - n + 1)), 6) AS loss FROM (SELECT sqrt(list_sum({_Z.format(_G + ' * ' + _G)})) AS p, sqrt(list_sum(list_transform(list_zip(t, r, h), lambda z: {_G} * {_G}))) AS n FROM trip)", ("vec", "trip"))
def _(t):
    c = F.col
    return triples(t).select(V.trans_e(c("h"), c("r"), c("t")).alias("p"), V.trans_e(c("t"), c("r"), c("h")).alias("n")).agg(F.round(K.margin_loss(None, "p", "n"), 6).alias("loss"))
