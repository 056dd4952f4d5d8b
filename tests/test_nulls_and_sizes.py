"""Null keys keep their rows, counts may be huge, and what can't be read fails by itself."""

from pyspark.sql import functions as F

from feaslens.operators import audit, bootstrap, metrics, ordered
from feaslens.operators import labels as lb
from feaslens.sources import tables as io


def test_rows_of_all_strata_add_up(spark):
    rows = [(None if i % 3 == 0 else "a", i % 2, float(i % 7), f"g{i % 6}") for i in range(60)]
    df = spark.createDataFrame(rows, "s string, y int, score double, g string")
    got = {r["s"]: r["n_eval"] for r in metrics.binary_metrics(df, "y", "score", ["s"]).collect()}
    assert got == {None: 20, "a": 40}
    assert sum(r["count"] for r in metrics.describe(df, ["score"], ["s"]).collect()) == 60
    deltas = bootstrap.delta_by_stratum(df.withColumn("other", -F.col("score")), "y", [("other", "score")], "g", "s", 20).collect()
    assert {r["s"] for r in deltas} == {None, "a"} and all(r["n_samples"] == got[r["s"]] for r in deltas)


def test_two_null_keys_are_not_mixed_up(spark):
    rows = [("x", None, 1, 1.0), (None, "x", 0, 2.0), ("x", "x", 1, 3.0), (None, None, 0, 4.0)] * 5
    df = spark.createDataFrame(rows, "a string, b string, y int, v double")
    out = ordered.running(df.withColumn("_b", F.lit(0)).withColumn("one", F.lit(1)), ["a", "b"], ["v"], ["one"])
    assert {(r["a"], r["b"], r["tot_one"]) for r in out.collect()} == {("x", None, 5), (None, "x", 5), ("x", "x", 5), (None, None, 5)}


def test_counts_beyond_four_billion(spark):
    counts = spark.createDataFrame([(1.0, 5 * 10**9, 0), (0.5, 5 * 10**9, 5 * 10**9), (0.0, 0, 5 * 10**9)], "score double, pos long, neg long")
    table = ordered.running(counts.withColumn("_b", F.lit(0)), [], ["score"], ["pos", "neg"], descending=True)
    r = table.agg(metrics.auprc_expr().alias("ap"), metrics.auroc_expr().alias("auc")).first()
    assert abs(r["ap"] - (0.5 + 0.5 * 2 / 3)) < 1e-12 and abs(r["auc"] - 0.875) < 1e-12
    cells = spark.createDataFrame([(1.0, 1.0, 5 * 10**9), (2.0, 2.0, 5 * 10**9), (3.0, 1.0, 10**9)], "x double, y double, n long")
    assert metrics.kendall_counts(cells, [], 1).first()["s_net"] == 25e18 - 5e18
    wide = [spark.range(1).select(F.lit("k").alias("k"))] * 2
    assert audit.cardinality_audit(dict(zip("ab", wide)), "k").count() == 3


def test_correlation_keeps_its_digits_far_from_zero(spark):
    df = spark.createDataFrame([(1e9 + i, 1e9 + (i * 7) % 11) for i in range(11)], "x double, y double")
    near = spark.createDataFrame([(float(i), float((i * 7) % 11)) for i in range(11)], "x double, y double")
    far, plain = (metrics.rank_correlation(d, "x", "y").first()["pearson"] for d in (df, near))
    assert abs(far - plain) < 1e-6  # sums of plain squares, near 1e18 here, would keep no digit


def test_a_broken_document_fails_alone(spark):
    good = '<commonRoad benchmarkID="A"><lanelet id="1"/></commonRoad>'
    docs = spark.createDataFrame([("a", good), ("b", '<commonRoad benchmarkID="B"><lanelet id="1"></commonRoad>'), ("c", None), ("d", "<commonRoad>"), ("e", "<other/>")], "p string, t string")
    got = {r["xml_path"]: (r["parse_status"], r["lanelet_count"]) for r in io.parse_scenario_xml(docs, "p", "t").collect()}
    assert got == {"a": ("ok", 1), "b": ("failed", None), "c": ("failed", None), "d": ("failed", None), "e": ("failed", None)}


def test_samples_without_candidates_have_a_row(spark):
    cand = spark.createDataFrame([("a", 1, 2.0, True, False, False, False, False, None, "", 0, "keep", "mid")],
                                 "sample_id string, candidate_id int, action_cost double, feasible boolean, collision_flag boolean, lane_buffer_flag boolean, progress_flag boolean, "
                                 "kinematic_flag boolean, first_failure_time_s double, failure_reason string, initial_overlap_count int, longitudinal_profile string, lateral_profile string")
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    rows = lb.planner_labels(cand, samples=samples).drop("initial_overlap_count").join(lb.candidate_flags(cand, samples=samples), "sample_id")
    got = {r["sample_id"]: r for r in lb.derived_reason(lb.failure_taxonomy(rows)).collect()}
    assert got["b"]["taxonomy_rule_id"] == "A_no_candidate" and got["b"]["raw_planner_failure_reason"] == "no_candidate_generated" and got["b"]["planner_failure_reason"] == "no_valid_trajectory"
    assert got["a"]["planner_failure_reason"] == "no_failure" and got["a"]["no_candidate_flag"] == 0
