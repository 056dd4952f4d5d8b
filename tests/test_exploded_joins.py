"""Exploded tables are estimated at the size of what went in: joins with them must not send them through the driver."""

from pyspark.sql import functions as F

from feaslens.catalog import audits
from feaslens.catalog import scenes as sc
from feaslens.operators import audit
from feaslens.operators import samples as sm


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lane_vertices_are_not_broadcast(spark, sf):
    poses = spark.range(5_000_000).select(F.col("id").cast("string").alias("sample_id"), F.col("id").cast("string").alias("scenario_id"), *[F.lit(0.0).alias(c) for c in ("ox", "oy", "oh")])
    assert "BroadcastExchange" not in planned(sm.lanes_near(poses, sc.map_lanes(spark, sf), sc.ROI))


def test_variants_are_not_broadcast(spark, sf):
    labels = spark.range(1000).select(F.col("id").alias("sample_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label_variant"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    preds = labels.select("sample_id", F.col("label_variant").alias("feature_variant"), F.explode(F.array(F.lit("baseline"), F.lit("enhanced"))).alias("feature_set"), F.rand(1).alias("score"))
    assert "BroadcastHashJoin [sample_id" not in planned(audit.mismatch_matrix(labels, preds))
    assert "BroadcastHashJoin [sample_id" not in planned(audits.mismatch(spark, sf))


def test_tracks_are_estimated_at_their_size(spark, sf):
    tracks = sc.tracks(spark, sf)
    estimate = int(tracks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert estimate >= tracks.count() * 8 * len(tracks.columns)
