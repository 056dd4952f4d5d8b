"""The best score of a family is found also when its value differs in the last bits each time it is computed."""

import random

from pyspark.sql import functions as F

from feaslens.operators import scores


def test_metrics_that_are_never_twice_the_same(spark):
    shaky = F.udf(lambda x: x + random.random() * 1e-6, "double").asNondeterministic()
    metrics = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.2)], "score_name string, v double").repartition(2).select("score_name", shaky("v").alias("auprc"))
    families = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "score_name string, family string")
    got = {r.family: (r.best_score, round(r.auprc, 4), r.n_scores) for r in scores.best_by_family(metrics, families).collect()}
    assert got == {"f": ("b", 0.3, 2), "g": ("c", 0.2, 1)}


def test_ties_and_families_without_a_value(spark):
    metrics = spark.createDataFrame([("b", 0.3), ("a", 0.3), ("n", None)], "score_name string, auprc double")
    families = spark.createDataFrame([("a", "f"), ("b", "f"), ("n", "g")], "score_name string, family string")
    got = {r.family: (r.best_score, r.auprc, r.n_scores) for r in scores.best_by_family(metrics, families).collect()}
    assert got == {"f": ("a", 0.3, 2), "g": (None, None, 1)}
