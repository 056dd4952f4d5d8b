"""Exact quantiles from summaries: bounds bracket the level, and only the values between them leave a task one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feaslens.operators import ordered

QS = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
ROWS = 400_000


@pytest.fixture(scope="module")
def table(spark):
    """Distinct values, values with a third of all rows on one of them, whole numbers, few values, none; some nulls."""
    unit = F.conv(F.substring(F.sha1(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double")
    df = spark.range(ROWS).select(
        (unit * unit / 1e9).alias("spread"), F.when(F.col("id") % 3 == 0, 1e9).otherwise(unit).alias("tied"), F.col("id").alias("sorted"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("few"), F.lit(None).cast("double").alias("none"))
    return df.persist()


def test_large_columns_agree_with_numpy(table):
    got = ordered.quantile_row(table, table.columns, QS).first()
    values = table.toPandas()
    for c in table.columns:
        have = [got[f"{c}__q{i}"] for i in range(len(QS))]
        if c == "none":
            assert have == [None] * len(QS)
        else:
            assert np.allclose(have, np.quantile(values[c].dropna().to_numpy(float), QS), rtol=1e-15, atol=0)


def test_few_values_are_counted_one_by_one(table):
    """Under 5 % of the distinct values are rows of their own, and all rows are still counted."""
    rows = ordered.bracketed_counts(table, ["spread", "sorted"], QS)
    for r in rows.groupBy("_i").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("tot_n").alias("tot")).collect():
        assert r.n == r.tot == ROWS
        assert r.rows < 0.05 * ROWS


def test_only_the_counts_are_shuffled(table):
    """No exchange carries rows of the column itself: summaries, then counts, then counts by bucket."""
    plan = ordered.quantile_row(table, ["spread"], [0.5])._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "_kept" in line or "_i" in line
    assert "percentile_approx" in plan


def test_infinite_values_nan_and_an_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in [1.0, -inf, inf, nan, 2.0]], "v double")
    low, middle, top = ordered.quantile_row(df, ["v"], [0.0, 0.5, 1.0]).first()
    assert (middle, top != top) == (2.0, True) and low == -inf
    assert tuple(ordered.quantiles(df.limit(0), "v", [0.5], names=["m"]).first()) == (None,)
    assert ordered.column_quantiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_a_single_value_and_levels_between_two(spark):
    for n in (1, 2, 3, 10):
        df = spark.range(n).select(F.col("id").cast("double").alias("v"))
        got = ordered.quantiles(df, "v", QS).first()
        assert np.allclose(list(got), np.quantile(np.arange(n), QS))
