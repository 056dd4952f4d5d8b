"""Tables that grow many times inside a task: the rows of a task stay the same however large the table is."""

from feaslens.catalog import occupancy
from feaslens.operators import curves as cv
from feaslens.operators import ordered


def test_partitions_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ordered.spread_rows(spark.range(10), 10, "id").rdd.getNumPartitions() == least
    assert ordered.spread_rows(spark.range(10), 1000, "id", per_task=10).rdd.getNumPartitions() == 100


def test_curves_meet_in_the_shuffle_of_the_unexpanded_rows(spark, sf):
    for rows in (occupancy.curves(spark, sf), cv.survival_by_class(cv.cumulative_safe(occupancy.primitives(spark, sf), ["sample_id", "primitive_id"]))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan, plan
        assert "Join" not in plan
