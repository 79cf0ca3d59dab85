"""Aggregations, metrics and reports (A, J06, W02, W04, W13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import metrics as M
from lexmill.operators import reports as R
from lexmill.operators import sequences as S
from lexmill.operators.order import best_per, global_index, within_group
from lexmill.operators.sampling import fold

from .base import CTE, ORACLES, clean, ledger, parsed, predictions, qa, query, sides, vectors

L = F.lit
CTE["toks"] = "toks AS (SELECT list_filter(string_split(lower(question), ' '), lambda w: w <> '') AS ws FROM clean)"
CTE["flat"] = "flat AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec)"
_LQ = ("ledger", "parsed")


@query("a01_counts", "SELECT coalesce(label, 'none') AS label, language, paragraph_id, count(*) AS n FROM clean GROUP BY 1, 2, 3", ("qa", "clean"))
def _(t):
    return clean(t).groupBy("label", "language", "paragraph_id").agg(F.count("*").alias("n"))


@query("a02_score_histogram", "SELECT floor(quality_score * 10) / 10 AS truncated, floor(quality_score * 10 + 0.5) / 10 AS rounded, count(*) AS n FROM qa GROUP BY 1, 2", ("qa",))
def _(t):
    score = F.col("quality_score")
    return qa(t).groupBy((F.floor(score * 10) / 10).alias("truncated"), (F.floor(score * 10 + 0.5) / 10).alias("rounded")).agg(F.count("*").alias("n"))


@query("a03_score_summary", "SELECT round(avg(quality_score), 6) AS mean, min(quality_score) AS least, max(quality_score) AS most, list_sort(list(quality_score))[count(*) // 2 + 1] AS upper_median FROM qa", ("qa",))
def _(t):
    # The upper median is the value at place n div 2 of a range-partitioned sort.
    scores = qa(t).select("quality_score", "ord").filter("quality_score IS NOT NULL")
    total = scores.agg(F.floor(F.count("*") / 2).alias("_half"))
    median = global_index(scores, [F.col("quality_score"), F.col("ord")], "_place").crossJoin(F.broadcast(total)).filter("_place = _half").agg(F.min("quality_score").alias("upper_median"))
    return qa(t).agg(F.round(F.avg("quality_score"), 6).alias("mean"), F.min("quality_score").alias("least"), F.max("quality_score").alias("most")).crossJoin(F.broadcast(median))


@query(
    "a04_length_summary",
    "SELECT label, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most, median(n) AS median FROM (SELECT label, CAST(len(list_filter(string_split(answer, ' '), lambda w: w <> '')) AS INTEGER) AS n FROM clean) GROUP BY label",
    ("qa", "clean"),
)
def _(t):
    rows = clean(t).select("label", F.size(X.words(F.col("answer"))).alias("n"))
    return rows.groupBy("label").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("median"))


@query(
    "a05_corpus_ngrams",
    """SELECT count(*) AS tokens, count(DISTINCT w) AS unigrams, count(DISTINCT w || ' ' || w2) AS bigrams, count(DISTINCT w || ' ' || w2 || ' ' || w3) AS trigrams, round(count(DISTINCT w) / count(*), 9) AS type_token_ratio
       FROM (SELECT w, lead(w) OVER (ORDER BY ord, i) AS w2, lead(w, 2) OVER (ORDER BY ord, i) AS w3 FROM
             (SELECT ord, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT ord, list_filter(string_split(lower(answer), ' '), lambda w: w <> '') AS ws FROM clean)))""",
    ("qa", "clean"),
)
def _(t):
    return S.corpus_ngrams(clean(t), "ord", "answer")


_GRAM = "(SELECT {n} AS n, unnest(list_transform(range(1, len(ws) + 2 - {n}), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) AS g FROM toks)"


@query(
    "a06_ngram_diversity",
    "SELECT n, count(*) AS total, count(DISTINCT g) AS distinct_ngrams, round(count(DISTINCT g) / count(*), 9) AS diversity FROM (SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_GRAM.format(n=n) for n in (1, 2, 3)) + ") GROUP BY n",
    ("qa", "clean", "toks"),
)
def _(t):
    return M.ngram_diversity(clean(t), "question")


CTE["answer_toks"] = CTE["toks"].replace("toks AS", "answer_toks AS").replace("lower(question)", "lower(answer)")


@query("a06_answer_diversity", ORACLES["a06_ngram_diversity"].split(CTE["toks"], 1)[1].replace("FROM toks", "FROM answer_toks"), ("qa", "clean", "answer_toks"))
def _(t):
    return M.ngram_diversity(clean(t), "answer")


CTE["sides"] = "sides AS (SELECT ord, paragraph || ' ' || sentence AS reference, question || ' ' || answer AS candidate FROM clean)"


@query("a07_bleu_rouge")
def _(t):
    rows = sides(t)
    return M.bleu(rows, "ord", "reference", "candidate").join(rows.select("ord", F.round(M.rouge_l("reference", "candidate"), 9).alias("rouge_l")), "ord")


@query(
    "a08_tfidf_cosine",
    r"""SELECT c.ord, round(coalesce(s.xy / sqrt(s.xx * s.yy), 0.0), 9) AS cosine FROM clean c LEFT JOIN (
      SELECT ord, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM (
        SELECT ord, ta * idf AS x, tb * idf AS y FROM (
          SELECT ord, w, count(*) FILTER (side = 'a') AS ta, count(*) FILTER (side = 'b') AS tb,
                 CASE WHEN count(*) FILTER (side = 'a') > 0 AND count(*) FILTER (side = 'b') > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS idf
          FROM (SELECT ord, 'a' AS side, unnest(regexp_extract_all(lower(sentence), '[0-9A-Za-zÄÖÜäöüßÀ-ÿ_]{2,}')) AS w FROM clean
                UNION ALL SELECT ord, 'b', unnest(regexp_extract_all(lower(question), '[0-9A-Za-zÄÖÜäöüßÀ-ÿ_]{2,}')) FROM clean) GROUP BY ord, w))
      GROUP BY ord) s ON c.ord = s.ord""",
    ("qa", "clean"),
)
def _(t):
    return M.tfidf_cosine(clean(t), "ord", "sentence", "question")


@query(
    "a08_whole_texts",
    ORACLES["a08_tfidf_cosine"].split(CTE["clean"], 1)[1].replace("lower(sentence)", "lower(reference)").replace("lower(question)", "lower(candidate)").replace("FROM clean", "FROM sides"),
    ("qa", "clean", "sides"),
)
def _(t):
    return M.tfidf_cosine(sides(t), "ord", "reference", "candidate")


@query("a09_word_error_rate")
def _(t):
    return sides(t).select("ord", F.round(M.word_error_rate("reference", "candidate"), 9).alias("wer"))


_C = {"n": "count(*)", "yy": "y_true='yes' AND y_pred='yes'", "nn": "y_true='no' AND y_pred='no'", "ty": "y_true='yes'", "tn": "y_true='no'", "py": "y_pred='yes'", "pn": "y_pred='no'", "pi": "y_pred='invalid'"}
_COUNTS = ", ".join(f"{v if k == 'n' else f'count(*) FILTER ({v})'}::DOUBLE AS {k}" for k, v in _C.items())


@query(
    "a10_confusion_metrics",
    f"""SELECT model, round((yy + nn) / n, 6) AS accuracy, round((yy / ty + nn / tn) / 2, 6) AS balanced_accuracy, round((yy / py + nn / pn) / (2 + CASE WHEN pi > 0 THEN 1 ELSE 0 END), 6) AS precision,
      round((yy / ty + nn / tn) / (2 + CASE WHEN pi > 0 THEN 1 ELSE 0 END), 6) AS recall, round((2 * yy / (ty + py) + 2 * nn / (tn + pn)) / (2 + CASE WHEN pi > 0 THEN 1 ELSE 0 END), 6) AS f1_macro, round((yy + nn) / n, 6) AS f1_micro,
      round(((yy + nn) * n - ty * py - tn * pn) / sqrt((n * n - ty * ty - tn * tn) * (n * n - py * py - pn * pn - pi * pi)), 6) AS mcc,
      ty::BIGINT AS true_yes, tn::BIGINT AS true_no, py::BIGINT AS pred_yes, pn::BIGINT AS pred_no, pi::BIGINT AS pred_invalid
    FROM (SELECT model, {_COUNTS} FROM pred GROUP BY model)""",
    ("pred",),
)
def _(t):
    return M.confusion_metrics(predictions(t), ["model"])


@query("a14_best_configurations", "SELECT clm, clu, cls, round(avg(f1_macro), 6) AS avg_f1, count(*) AS n_models FROM parsed WHERE clm IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2 ORDER BY avg_f1 DESC, clm, clu, cls LIMIT 10", _LQ)
def _(t):
    return R.best_configurations(parsed(t))


@query(
    "a15_contribution",
    "SELECT base, round(a, 6) AS without, round(b, 6) AS with_it, round(b - a, 6) AS contribution, CASE WHEN b - a > 0.02 THEN 'beneficial' WHEN b - a > 0 THEN 'marginal' ELSE 'harmful' END AS tier FROM (SELECT base, avg(f1_macro) FILTER (clu = 0) AS a, avg(f1_macro) FILTER (clu > 0) AS b FROM parsed WHERE clm IS NOT NULL GROUP BY base) WHERE a IS NOT NULL AND b IS NOT NULL",
    _LQ,
)
def _(t):
    return R.contribution(parsed(t), "clu")


@query(
    "a16_progression",
    "SELECT base, baseline, pretrained, finetuned, round(pretrained - baseline, 6) AS pt_gain, round(coalesce(finetuned, pretrained) - baseline, 6) AS total_gain FROM (SELECT base, max(f1_macro) FILTER (clm IS NULL AND setting = 'view') AS baseline, max(f1_macro) FILTER (clm IS NOT NULL AND setting = 'view') AS pretrained, max(f1_macro) FILTER (clm IS NOT NULL AND setting = 'purchase') AS finetuned FROM parsed GROUP BY base)",
    _LQ,
)
def _(t):
    return R.progression(parsed(t), "view", "purchase")


@query(
    "a17_ablation",
    """SELECT removed, round(avg(d), 6) AS mean_drop, round(stddev_pop(d), 6) AS std_drop, count(*) AS n FROM (
      SELECT base, unnest(['CLS', 'NSP', 'CLU']) AS removed, unnest([a - c, a - n, a - u]) AS d FROM (
        SELECT base, max(f1_macro) FILTER (clm > 0 AND clu > 0 AND cls > 0) AS a, max(f1_macro) FILTER (clm > 0 AND clu > 0 AND cls = 0) AS c,
               max(f1_macro) FILTER (clm = 0 AND clu > 0 AND cls > 0) AS n, max(f1_macro) FILTER (clm > 0 AND clu = 0 AND cls > 0) AS u FROM parsed GROUP BY base)) WHERE d IS NOT NULL GROUP BY removed""",
    _LQ,
)
def _(t):
    return R.ablation(parsed(t))


_SETTINGS = ("click", "error", "purchase", "signup", "view")


@query("a18_pivot", "SELECT base, " + ", ".join(f"round(avg(f1_macro) FILTER (setting = '{s}'), 6) AS {s}" for s in _SETTINGS) + " FROM parsed GROUP BY base", _LQ)
def _(t):
    return parsed(t).groupBy("base").pivot("setting", list(_SETTINGS)).agg(F.round(F.avg("f1_macro"), 6))


@query("a18_weight_pivot", "SELECT clu, " + ", ".join(f'round(avg(f1_macro) FILTER (cls = {c}), 6) AS "cls_{c}"' for c in (0.0, 0.5, 0.6)) + " FROM parsed WHERE clu IS NOT NULL GROUP BY clu", _LQ)
def _(t):
    rows = parsed(t).filter("clu IS NOT NULL").groupBy("clu").pivot("cls", [0.0, 0.5, 0.6]).agg(F.round(F.avg("f1_macro"), 6))
    return rows.select("clu", *[F.col(f"`{c}`").alias(f"cls_{c}") for c in (0.0, 0.5, 0.6)])


@query("a19_mean_std", "SELECT setting, round(avg(f1_macro), 4) AS f1_mean, round(stddev_samp(f1_macro), 4) AS f1_std, round(avg(accuracy), 4) AS acc_mean, round(stddev_samp(accuracy), 4) AS acc_std FROM ledger GROUP BY setting", ("ledger",))
def _(t):
    return ledger(t).groupBy("setting").agg(*[F.round(f(c), 4).alias(n) for c, p in (("f1_macro", "f1"), ("accuracy", "acc")) for f, n in ((F.avg, f"{p}_mean"), (F.stddev_samp, f"{p}_std"))])


CTE["gains"] = """best AS (SELECT base, setting, clm IS NULL AS plain, arg_max(f1_macro, f1_macro) AS f1 FROM parsed GROUP BY 1, 2, 3),
gains AS (SELECT b.base, b.setting, b.f1 AS baseline, p.f1 AS pretrained FROM best b JOIN best p ON b.base = p.base AND b.setting = p.setting AND b.plain AND NOT p.plain)"""


@query("j06_gains", "SELECT base, setting, baseline, pretrained, round(pretrained - baseline, 6) AS gain, round((pretrained - baseline) * 100 / nullif(baseline, 0), 6) AS gain_percent FROM gains", (*_LQ, "gains"))
def _(t):
    return R.gains(parsed(t)).drop("model_name")


@query("a20_gain_summary", "SELECT setting, round(avg(pretrained - baseline), 6) AS mean_gain, round(avg(CASE WHEN pretrained - baseline > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share FROM gains GROUP BY setting", (*_LQ, "gains"))
def _(t):
    gain = F.col("pretrained") - F.col("baseline")
    return R.gains(parsed(t)).groupBy("setting").agg(F.round(F.avg(gain), 6).alias("mean_gain"), F.round(F.avg((gain > 0).cast("double")), 6).alias("positive_share"))


@query(
    "a21_threshold_sweep",
    """SELECT arg_max(k, (youden, -k)) / 1000 AS youden_threshold, max(youden) AS best_youden, arg_max(k, (f1, -k)) / 1000 AS f1_threshold, max(f1) AS best_f1, arg_max(k, (accuracy, -k)) / 1000 AS accuracy_threshold, max(accuracy) AS best_accuracy
       FROM (SELECT k, round(tp / p - fp / n, 9) AS youden, round(2 * tp / (tp + fp + p), 9) AS f1, round((tp + n - fp) / (p + n), 9) AS accuracy FROM (
         SELECT g.range AS k, count(*) FILTER (y AND s >= g.range / 1000)::DOUBLE AS tp, count(*) FILTER (NOT y AND s >= g.range / 1000)::DOUBLE AS fp, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS n
         FROM range(0, 1001) g, (SELECT quality = 1 AS y, CAST(doc_id * 37 % 997 AS DOUBLE) / 1000 + CASE WHEN quality = 1 THEN 0.2 ELSE 0 END AS s FROM labels) GROUP BY g.range))""",
)
def _(t):
    score = (F.col("doc_id") * 37 % 997).cast("double") / 1000 + F.when(F.col("quality") == 1, 0.2).otherwise(0.0)
    return M.threshold_sweep(t.labels.select((F.col("quality") == 1).alias("label"), score.alias("score")))


@query("a22_percentile_threshold", "SELECT round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    rows = t.lineitem.filter("l_returnflag = 'R'").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return M.percentile(rows, "l_extendedprice", 0.9, ["l_orderkey", "l_linenumber"]).select(F.round("value", 6).alias("p90"))


@query("a23_group_similarity", "SELECT round(avg(score) FILTER (y_true = 'yes'), 6) AS yes_mean, round(avg(score) FILTER (y_true = 'no'), 6) AS no_mean, round(abs(avg(score) FILTER (y_true = 'yes') - avg(score) FILTER (y_true = 'no')), 6) AS gap FROM pred", ("pred",))
def _(t):
    of = lambda y: F.avg(F.when(F.col("y_true") == y, F.col("score")))
    return predictions(t).agg(F.round(of("yes"), 6).alias("yes_mean"), F.round(of("no"), 6).alias("no_mean"), F.round(F.abs(of("yes") - of("no")), 6).alias("gap"))


@query("a24_threshold_accuracy", "SELECT model, round(avg(CASE WHEN (score > 0.5) = (y_true = 'yes') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred GROUP BY model", ("pred",))
def _(t):
    return predictions(t).groupBy("model").agg(F.round(F.avg(((F.col("score") > 0.5) == (F.col("y_true") == "yes")).cast("double")), 6).alias("accuracy"))


@query(
    "a25_cluster_separation",
    """SELECT label, n, round(own, 6) AS own_distance, round(near, 6) AS other_distance, round(near / own, 6) AS ratio, round(sil, 6) AS silhouette FROM (
      SELECT label, count(*) AS n, avg(own) AS own, avg(near) AS near, avg((near - own) / greatest(near, own)) AS sil FROM (
        SELECT x.id, x.label, max(d) FILTER (x.label = o) AS own, min(d) FILTER (x.label <> o) AS near FROM (
          SELECT v.id, v.label, c.label AS o, sqrt(sum((v.x - c.c) * (v.x - c.c))) AS d
          FROM flat v JOIN (SELECT label, i, avg(x) AS c FROM flat GROUP BY 1, 2) c ON v.i = c.i GROUP BY 1, 2, 3) x GROUP BY 1, 2) GROUP BY label)""",
    ("vec", "flat"),
)
def _(t):
    rows = M.cluster_separation(vectors(t))
    return rows.select("label", "n", *[F.round(c, 6).alias(c) for c in ("own_distance", "other_distance", "ratio", "silhouette")])


@query("a26_paired_t", "SELECT setting, n, round(m, 6) AS mean_diff, round(p, 6) AS std_pop, round(m / (s / sqrt(n)), 6) AS t FROM (SELECT setting, count(*) AS n, avg(f1_macro - accuracy) AS m, stddev_pop(f1_macro - accuracy) AS p, stddev_samp(f1_macro - accuracy) AS s FROM ledger GROUP BY setting)", ("ledger",))
def _(t):
    rows = M.paired_t(ledger(t).select("setting", F.col("f1_macro").alias("a"), F.col("accuracy").alias("b")), ["setting"])
    return rows.select("setting", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("std_pop", 6).alias("std_pop"), F.round("t", 6).alias("t"))


@query("a26_paired_t_probability")
def _(t):
    rows = M.paired_t(ledger(t).select("setting", F.col("f1_macro").alias("a"), F.col("accuracy").alias("b")), ["setting"])
    return rows.select("setting", F.round("t", 6).alias("t"), F.round(M.t_probability(F.col("t"), (F.col("n") - 1).cast("double")), 6).alias("p"))


@query("a27_run_statistics", "SELECT count(*) AS total, round(count(*) FILTER (label = 'yes') / count(*), 3) AS balance, round(count(*) FILTER (quality_score >= 0.6) / count(*), 3) AS success, round(min(quality_score), 3) AS least, round(avg(quality_score), 3) AS mean, round(max(quality_score), 3) AS most FROM clean", ("qa", "clean"))
def _(t):
    return clean(t).agg(
        F.count("*").alias("total"), F.round(F.count_if(F.col("label") == "yes") / F.count("*"), 3).alias("balance"), F.round(F.count_if(F.col("quality_score") >= 0.6) / F.count("*"), 3).alias("success"),
        F.round(F.min("quality_score"), 3).alias("least"), F.round(F.avg("quality_score"), 3).alias("mean"), F.round(F.max("quality_score"), 3).alias("most"),
    )


@query("a28_status_counters", "SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS done, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6) AS success_percent FROM events")
def _(t):
    bad = F.col("event_type") == "error"
    return t.events.agg(F.count("*").alias("calls"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("done"), F.round(F.count_if(~bad) * 100.0 / F.count("*"), 6).alias("success_percent"))


@query("a29_model_comparison", "SELECT model, round(val - train, 6) AS overfit, round(val * 100, 6) AS efficiency, val = min(val) OVER () AS best FROM (SELECT setting AS model, avg(f1_macro) AS val, avg(accuracy) AS train FROM ledger GROUP BY 1)", ("ledger",))
def _(t):
    from pyspark.sql import Window

    rows = ledger(t).groupBy(F.col("setting").alias("model")).agg(F.avg("f1_macro").alias("val"), F.avg("accuracy").alias("train"))
    # One row for each model stands in this window.
    return rows.select("model", F.round(F.col("val") - F.col("train"), 6).alias("overfit"), F.round(F.col("val") * 100, 6).alias("efficiency"), (F.col("val") == F.min("val").over(Window.partitionBy())).alias("best"))


@query("a30_cross_validation")
def _(t):
    from lexmill.operators.learning import cross_validated

    return cross_validated(clean(t).select("ord", "label", F.concat_ws(" ", "question", "answer").alias("text")), "ord", 5)


@query("a31_seed_average", "SELECT model, round(avg(dev), 6) AS dev, round(avg(test), 6) AS test, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY dev DESC, seed) AS rn FROM (SELECT setting AS model, ord % 5 AS seed, avg(f1_macro) AS dev, avg(accuracy) AS test FROM ledger GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY model", ("ledger",))
def _(t):
    from pyspark.sql import Window

    seeds = ledger(t).groupBy(F.col("setting").alias("model"), (F.col("ord") % 5).alias("seed")).agg(F.avg("f1_macro").alias("dev"), F.avg("accuracy").alias("test"))
    top = seeds.withColumn("rn", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("dev"), "seed"))).filter("rn <= 3")
    return top.groupBy("model").agg(F.round(F.avg("dev"), 6).alias("dev"), F.round(F.avg("test"), 6).alias("test"), F.count("*").alias("n"))


_SEEDS = "SELECT setting AS model, ord % 5 AS seed, avg(f1_macro) AS dev, avg(accuracy) AS test FROM ledger GROUP BY 1, 2"


@query("a31_seed_outliers", f"SELECT model, round(avg(dev), 6) AS dev, round(avg(test), 6) AS test, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY dev DESC, seed) AS rn FROM ({_SEEDS})) WHERE rn <= 3 GROUP BY model UNION ALL SELECT model || ' all', round(avg(dev), 6), round(avg(test), 6), count(*) FROM ({_SEEDS}) GROUP BY model", ("ledger",))
def _(t):
    seeds = ledger(t).groupBy(F.col("setting").alias("model"), (F.col("ord") % 5).alias("seed")).agg(F.avg("f1_macro").alias("dev"), F.avg("accuracy").alias("test"))
    return R.seed_average(seeds, 3).unionByName(R.seed_average(seeds, 3, filter_outliers=False).withColumn("model", F.concat("model", L(" all"))))


@query("a33_epoch_means", "SELECT event_id // 500 AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.floor(F.col("event_id") / 500).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query("a34_split_distribution", "SELECT CASE WHEN doc_id % 10 < 4 THEN 'train' WHEN doc_id % 10 = 4 THEN 'val' ELSE 'test' END AS split, quality AS label, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    k = F.col("doc_id") % 10
    return t.labels.groupBy(F.when(k < 4, "train").when(k == 4, "val").otherwise("test").alias("split"), F.col("quality").alias("label")).agg(F.count("*").alias("n"))


@query("a35_approximate_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS close, true AS median_between FROM lineitem GROUP BY 1")
def _(t):
    # The approximations are held against exact figures: within a tenth, and between the quartiles. Parts are told apart by a
    # plan of their own, as otherwise every part would carry a summary of quantities through the shuffle.
    parts = t.lineitem.groupBy("l_returnflag", "l_partkey").count().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    # A deviation of 1 % leaves no flag of any number of parts near the tenth.
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("_flag")).agg(
        F.approx_count_distinct("l_partkey", 0.01).alias("about"), F.percentile_approx("l_quantity", F.array(L(0.25), L(0.5), L(0.75))).alias("q"), F.avg("l_quantity").alias("mean"),
    )
    both = parts.join(rows, F.col("l_returnflag").eqNullSafe(F.col("_flag")))
    return both.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.1 * F.col("parts")).alias("close"), F.col("mean").between(F.col("q")[0], F.col("q")[2]).alias("median_between"))


@query("a36_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("a37_percent_of_total", "SELECT label, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM clean GROUP BY label", ("qa", "clean"))
def _(t):
    from pyspark.sql import Window

    rows = clean(t).groupBy("label").agg(F.count("*").alias("n"))  # a row for each label
    return rows.select("label", F.round(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy())), 6).alias("percent"))


@query("w02_rolling_mean", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def _(t):
    return R.rolling_mean(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 5).drop("value")


_WIDTH = "least(50, greatest(1, count(*) OVER (PARTITION BY user_id) // 10))"
_LAST50 = "list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"


@query("w02_adaptive_mean", f"SELECT user_id, event_id, round(list_avg(vs[greatest(1, len(vs) - width + 1):]), 6) AS rolling, rn >= width AS full_window FROM (SELECT user_id, event_id, {_LAST50} AS vs, {_WIDTH} AS width, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def _(t):
    return R.adaptive_mean(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "rolling", "full_window")


@query("w04_best_row", "SELECT setting, ord, f1_macro FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY f1_macro DESC, ord) AS rn FROM ledger) WHERE rn = 1", ("ledger",))
def _(t):
    return best_per(ledger(t), ["setting"], "f1_macro", "ord").select("setting", "ord", "f1_macro")


@query("w10_running_best", """SELECT user_id, event_id, min(value) OVER w AS best, rn - max(improved) OVER w AS waited FROM (SELECT *, CASE WHEN earlier IS NULL OR value < earlier THEN rn END AS improved FROM (
    SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM events))
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(t):
    return S.running_best(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best", F.col("waited").cast("bigint").alias("waited"))


_WAITED = """SELECT user_id, event_id, rn, rn - max(improved) OVER (PARTITION BY user_id ORDER BY event_id) AS waited FROM (SELECT *, CASE WHEN earlier IS NULL OR value < earlier THEN rn END AS improved FROM (
    SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM events))"""


@query("w10_patience_stop", f"SELECT user_id, event_id FROM (SELECT *, min(CASE WHEN waited >= 5 THEN rn END) OVER (PARTITION BY user_id) AS stop FROM ({_WAITED})) WHERE stop IS NULL OR rn <= stop")
def _(t):
    return S.until_patience(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 5).select("user_id", "event_id")


@query("w10_plateau_rate", f"SELECT user_id, event_id, round(0.1 * pow(0.5, count(*) FILTER (waited > 0 AND waited % 4 = 0) OVER (PARTITION BY user_id ORDER BY event_id)), 9) AS rate FROM ({_WAITED})")
def _(t):
    return S.plateau_rate(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.1, 0.5, 3).select("user_id", "event_id", F.round("rate", 9).alias("rate"))


@query("w11_ranks", "SELECT l_suppkey, sum(l_quantity) AS q, rank() OVER (ORDER BY sum(l_quantity) DESC) AS place FROM lineitem GROUP BY 1")
def _(t):
    # The rank of a sum is the first place among its equals in a range-partitioned sort.
    sums = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    placed = global_index(sums, [F.desc("q"), F.col("l_suppkey")], "_place")
    return placed.join(placed.groupBy("q").agg((F.min("_place") + 1).alias("place")), "q").select("l_suppkey", "q", "place")


@query("w13_model_series", "SELECT setting, ord, row_number() OVER (PARTITION BY setting ORDER BY ts, ord) AS run FROM ledger", ("ledger",))
def _(t):
    rows = within_group(ledger(t).select("setting", "ord", "ts"), "setting", [F.col("ts"), F.col("ord")], "_n")
    return rows.select("setting", "ord", (F.col("_n") + 1).alias("run"))


@query("t10_folds", "SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold FROM documents")
def _(t):
    return t.documents.select("doc_id", fold(F.col("doc_id"), 5).alias("fold"))
