"""Cross-validated text classification with Spark's own learners."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.metrics import confusion_metrics
from lexmill.operators.sampling import fold


def cross_validated(rows: DataFrame, key: str, k: int) -> DataFrame:
    """k folds by hash of key; TF-IDF of 5000 features and logistic regression; mean scores and the population std of F1.

    rows: key, label (yes/no), text. A fold whose training part has one label alone is left out.
    """
    data = rows.select(fold(F.col(key), k).alias("fold"), "label", X.words(F.lower("text")).alias("tokens"), (F.col("label") == "yes").cast("double").alias("y")).cache()
    learner = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="tf", numFeatures=5000), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, regParam=0.1)])
    scored = []
    for i in range(k):
        train = data.filter(F.col("fold") != i)
        if train.select("y").distinct().count() < 2:
            continue
        said = learner.fit(train).transform(data.filter(F.col("fold") == i))
        scored.append(said.select(F.lit(i).alias("fold"), F.col("label").alias("y_true"), F.when(F.col("prediction") > 0.5, "yes").otherwise("no").alias("y_pred")))
    if not scored:
        return rows.sparkSession.createDataFrame([], "accuracy double, precision double, recall double, f1 double, f1_std double, folds bigint")
    by_fold = confusion_metrics(reduce(DataFrame.unionByName, scored), ["fold"])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return by_fold.agg(mean("accuracy", "accuracy"), mean("precision", "precision"), mean("recall", "recall"), mean("f1_macro", "f1"), F.round(F.stddev_pop("f1_macro"), 6).alias("f1_std"), F.count("*").alias("folds"))
