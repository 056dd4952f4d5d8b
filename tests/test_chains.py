"""The two end-to-end chains on scenes derived from the smallest tables."""

from pyspark.sql import functions as F

from feaslens.catalog import scenes as sc
from feaslens.operators import actions
from feaslens.plans import chains


def test_tracks_to_gates(spark, sf):
    cfg = chains.SceneConfig(roi=sc.ROI, future_steps=sc.FUTURE, dt=sc.DT, min_agents=2, object_types=("vehicle", "cyclist"), grid=chains.Grid(-30.0, 50.0, -24.0, 24.0, 2.0))
    scene = chains.extract(sc.tracks(spark, sf), sc.map_lanes(spark, sf), sc.steps(spark, sf), cfg)
    feats = chains.labelled_features(scene, cfg)
    n = scene.agents.filter("is_ego").count()
    assert n > 0 and feats.count() == n == feats.select("sample_id").distinct().count()
    out = chains.planner_outcomes(scene, actions.PlannerParams(horizon_s=3.0, dt=sc.DT))
    assert out.count() == n
    assert out.filter((F.col("known_failure") + F.col("unknown_failure") + F.col("no_failure")) != 1).count() == 0
    # Occupancy features stand in for the curve features the composites need.
    work = feats.withColumns({"redi_actionability": F.col("cv_rcr"), "ttad_s": F.col("cv_tfrc_s"), "collapse_rate_max_per_s": F.col("cv_c_time"), "asr_cum_final": F.col("cv_rfr"),
                              "asr_slice_final": F.col("cv_rfr"), "msr": F.col("cv_rfr")}).drop("collision_any")
    table, deltas, gates = chains.compare(work, out, [("distance_inverse", "temporal_composite"), ("TTC_inverse", "temporal_composite")], n_boot=20)
    assert table.count() == 3 and deltas.count() == 6 and gates.count() == 11
