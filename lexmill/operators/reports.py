"""Reports over experiment ledgers: model, setting, f1_macro and the parsed configuration base, clm, clu, cls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.order import best_per


def task_combination() -> Column:
    """The tasks that a configuration trains, by which weights are over 0."""
    on = lambda c: F.col(c) > 0
    off = lambda c: F.col(c) == 0
    return (
        F.when(on("clm") & off("clu") & off("cls"), "CLM only")
        .when(off("clm") & on("clu") & off("cls"), "CLU only")
        .when(off("clm") & off("clu") & on("cls"), "CLS only")
        .when(on("clm") & on("clu") & off("cls"), "CLM+CLU")
        .when(on("clm") & off("clu") & on("cls"), "CLM+CLS")
        .when(off("clm") & on("clu") & on("cls"), "CLU+CLS")
        .when(on("clm") & on("clu") & on("cls"), "ALL")
    )


def gains(rows: DataFrame) -> DataFrame:
    """Best baseline of each model and setting against its best pre-trained one, with the gain and the gain in percent."""
    base = best_per(rows.filter("clm IS NULL"), ["base", "setting"], "f1_macro", "ord").select("base", "setting", F.col("f1_macro").alias("baseline"))
    tuned = best_per(rows.filter("clm IS NOT NULL"), ["base", "setting"], "f1_macro", "ord").select("base", "setting", F.col("f1_macro").alias("pretrained"), "model_name")
    gain = F.col("pretrained") - F.col("baseline")
    return base.join(tuned, ["base", "setting"]).select("*", F.round(gain, 6).alias("gain"), F.round(F.try_divide(gain * 100, F.col("baseline")), 6).alias("gain_percent"))


def best_configurations(rows: DataFrame, least: int = 2, top: int = 10) -> DataFrame:
    means = rows.filter("clm IS NOT NULL").groupBy("clm", "clu", "cls").agg(F.round(F.avg("f1_macro"), 6).alias("avg_f1"), F.count("*").alias("n_models"))
    return means.filter(F.col("n_models") >= least).orderBy(F.desc("avg_f1"), "clm", "clu", "cls").limit(top)


def contribution(rows: DataFrame, component: str) -> DataFrame:
    """Mean with and without a component by base, the difference and its tier."""
    tuned = rows.filter("clm IS NOT NULL").groupBy("base").agg(
        F.avg(F.when(F.col(component) == 0, F.col("f1_macro"))).alias("without"), F.avg(F.when(F.col(component) > 0, F.col("f1_macro"))).alias("with_it")
    )
    gap = F.col("with_it") - F.col("without")
    tier = F.when(gap > 0.02, "beneficial").when(gap > 0, "marginal").otherwise("harmful")
    return tuned.filter("without IS NOT NULL AND with_it IS NOT NULL").select("base", F.round("without", 6).alias("without"), F.round("with_it", 6).alias("with_it"), F.round(gap, 6).alias("contribution"), tier.alias("tier"))


def progression(rows: DataFrame, first: str, last: str) -> DataFrame:
    """By base: the best of the baseline, of pre-training in the first setting and of the last setting, with the gains between."""
    top = lambda c, name: F.max(F.when(c, F.col("f1_macro"))).alias(name)
    tuned = F.col("clm").isNotNull()
    rows = rows.groupBy("base").agg(top(~tuned & (F.col("setting") == first), "baseline"), top(tuned & (F.col("setting") == first), "pretrained"), top(tuned & (F.col("setting") == last), "finetuned"))
    final = F.coalesce("finetuned", "pretrained")
    return rows.select("base", "baseline", "pretrained", "finetuned", F.round(F.col("pretrained") - F.col("baseline"), 6).alias("pt_gain"), F.round(final - F.col("baseline"), 6).alias("total_gain"))


def ablation(rows: DataFrame) -> DataFrame:
    """By removed task: the mean over bases of how far the best without it stays behind the best of all, its population std and its rank."""
    best = rows.filter("clm IS NOT NULL").withColumn("config", task_combination()).groupBy("base", "config").agg(F.max("f1_macro").alias("f1"))
    wide = best.groupBy("base").agg(*[F.max(F.when(F.col("config") == c, F.col("f1"))).alias(k) for k, c in (("full", "ALL"), ("CLS", "CLM+CLU"), ("NSP", "CLU+CLS"), ("CLU", "CLM+CLS"))])
    drops = wide.select("base", F.expr("stack(3, 'CLS', full - CLS, 'NSP', full - NSP, 'CLU', full - CLU) AS (removed, drop)")).filter("drop IS NOT NULL")
    return drops.groupBy("removed").agg(F.round(F.avg("drop"), 6).alias("mean_drop"), F.round(F.stddev_pop("drop"), 6).alias("std_drop"), F.count("*").alias("n"))


def rolling_mean(rows: DataFrame, group: list[str], order: str, value: str, window: int) -> DataFrame:
    from pyspark.sql import Window

    back = Window.partitionBy(*group).orderBy(order).rowsBetween(-(window - 1), Window.currentRow)
    return rows.withColumn("rolling", F.round(F.avg(value).over(back), 6))


def adaptive_mean(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with rolling, the mean of the last w values, and full_window, whether there are so many: w is a tenth of the group's rows, from 1 to 50.

    Rows without a full window are those that a valid-only mean leaves out.
    """
    from pyspark.sql import Window

    whole, back = Window.partitionBy(group), Window.partitionBy(group).orderBy(order)
    width = F.least(F.lit(50), F.greatest(F.lit(1), F.floor(F.count("*").over(whole) / 10)))
    rows = rows.withColumn("_w", width).withColumn("_n", F.row_number().over(back)).withColumn("_last", F.collect_list(value).over(back.rowsBetween(-49, Window.currentRow)))
    held = F.slice("_last", F.greatest(F.lit(1), F.size("_last") - F.col("_w") + 1).cast("int"), F.col("_w").cast("int"))
    mean = F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.size(held))
    return rows.withColumn("rolling", F.round(mean, 6)).withColumn("full_window", F.col("_n") >= F.col("_w")).drop("_w", "_n", "_last")


def seed_average(seeds: DataFrame, top: int, filter_outliers: bool = True) -> DataFrame:
    """Mean dev and test of each model's seeds; with filter_outliers, of the `top` best by dev alone."""
    from pyspark.sql import Window

    if filter_outliers:
        seeds = seeds.withColumn("_rn", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("dev"), "seed"))).filter(F.col("_rn") <= top)
    return seeds.groupBy("model").agg(F.round(F.avg("dev"), 6).alias("dev"), F.round(F.avg("test"), 6).alias("test"), F.count("*").alias("n"))


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A ledger with new rows: columns of both by name."""
    return existing.unionByName(new, allowMissingColumns=True)
