"""Golden vectors and contracts on tiny tables."""

import pytest
from pyspark.sql import functions as F

from feaslens.functions import columns as c
from feaslens.operators import actions, audit, bootstrap, labels, metrics, ordered, splits

FLAGS = ("collision_flag", "road_boundary_flag", "lane_buffer_flag", "kinematic_flag", "parser_error_flag", "no_route_flag", "initial_invalid_flag", "no_candidate_flag")
CASES = [
    ({"road_boundary_flag", "lane_buffer_flag", "kinematic_flag"}, 0, "known_failure", "known_failure:road_boundary_and_kinematic", 0),
    ({"collision_flag", "kinematic_flag"}, 0, "known_failure", "known_failure:collision_and_kinematic", 0),
    ({"collision_flag", "road_boundary_flag", "kinematic_flag"}, 0, "known_failure", "known_failure:collision_road_boundary_and_kinematic", 0),
    ({"collision_flag", "kinematic_flag"}, 2, "no_failure", "no_failure:feasible_trajectory_exists", 0),
    ({"parser_error_flag"}, 0, "unknown_failure", "unknown_failure:parser_error", 0),
    ({"no_route_flag"}, 0, "unknown_failure", "unknown_failure:no_route", 0),
    (set(), 0, "unknown_failure", "unknown_failure:all_invalid_unattributed", 0),
    ({"kinematic_flag"}, 0, "known_failure", "known_failure:kinematic_only", 1),
    ({"no_candidate_flag"}, 0, "known_failure", "known_failure:no_valid_trajectory", 0),
]


def test_taxonomy_vectors(spark):
    rows = [(i, ok, *[int(f in flags) for f in FLAGS]) for i, (flags, ok, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "sample_id int, candidate_any_feasible int, " + ", ".join(f"{f} int" for f in FLAGS))
    got = {r.sample_id: r for r in labels.failure_taxonomy(df).collect()}
    for i, (_, _, tax, sub, secondary) in enumerate(CASES):
        assert (got[i].failure_taxonomy, got[i].failure_subtype, got[i].taxonomy_secondary_sensitivity) == (tax, sub, secondary)
    assert got[0].taxonomy_rule_id == "D_all_invalid_concrete_validator_flag"
    assert got[6].taxonomy_rule_id == "F_all_invalid_unattributed"


def test_strict_recall_with_ties(spark):
    rows = list(zip([1, 1] + [0] * 10, [2.0, 1.0, 1.0, 1.0, 1.0] + [0.0] * 7))
    df = spark.createDataFrame(rows, "y int, s double")
    row = metrics.recall_at_fpr_strict(df, "y", "s", 0.05).first()
    assert row["recall_at_5pct_fpr_strict"] == 0.5
    assert row["actual_fpr_at_5pct_strict"] <= 0.05


def test_single_class_gives_null(spark):
    row = metrics.binary_metrics(spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double"), "y", "s").first()
    assert row["auprc"] is None and row["auroc"] is None and row["n_eval"] == 2


@pytest.mark.parametrize("ratios,want", [((1.0, 1.0), 0), ((0.5, 0.5), 1), ((0.25, 1.0), 2), ((1.0, 0.0), 3)])
def test_moderate_rule(spark, ratios, want):
    df = spark.createDataFrame([ratios], "c double, e double")
    assert df.select(labels.actionability_label("c", "e", "moderate")).first()[0] == want


def test_libraries(spark):
    assert actions.action_library(spark, "base7").count() == 7
    assert actions.action_library(spark, "extended").count() == 15
    base, ext = actions.lattice_candidates(spark), actions.lattice_candidates(spark, "lattice_extended")
    assert (base.count(), ext.count()) == (35, 130)
    assert base.select("candidate_id").distinct().count() == 35
    assert len(actions.VARIANTS) == 7


def cohort_input(spark):
    rows = [(f"s{s}_{k}", f"sc{s}", 1.0 + s % 5 + k, 0.5 + k % 4, 3.0 + s % 6, "urban" if s % 2 else "highway") for s in range(12) for k in range(4)]
    df = spark.createDataFrame(rows, "sample_id string, scenario_id string, current_min_distance_m double, current_ttc_s double, ego_speed_mps double, source_hint string")
    return splits.sample_strata(df).withColumn("neutral_stratum", F.concat_ws("|", "source_hint", "distance_stratum", "ttc_stratum", "speed_stratum"))


def test_cohort_contract(spark):
    cohort = splits.neutral_cohort(cohort_input(spark), "sample_id", "neutral_stratum", 30, 42, "scenario_id", 2)
    d = splits.cohort_diagnostics(cohort, "scenario_id", "neutral_stratum", 20, 30, 6).first()
    assert 20 <= d.selected_samples <= 30 and d.max_samples_per_scenario <= 2 and d.unique_scenarios >= 6
    assert d.size_ok and d.scenarios_ok


def test_cohort_refuses_outcomes(spark):
    with pytest.raises(ValueError):
        splits.neutral_cohort(cohort_input(spark).withColumn("failure_taxonomy", F.lit("x")), "sample_id", "neutral_stratum", 30, 42)


def test_cohort_is_round_robin(spark):
    """Same order as taking one row of every stratum in turn."""
    df = cohort_input(spark)
    u = {r.sample_id: (r.u, r.sample_id) for r in df.select("sample_id", c.unit_hash(F.lit("42"), "sample_id").alias("u")).collect()}
    pools = {}
    for r in df.collect():
        pools.setdefault(r.neutral_stratum, []).append(r.sample_id)
    h = {r.k: r.h for r in spark.createDataFrame([(k,) for k in pools], "k string").select("k", c.unit_hash(F.lit("42"), F.lit("bucket"), "k").alias("h")).collect()}
    for v in pools.values():
        v.sort(key=lambda s: u[s])
    want, order = [], sorted(pools, key=lambda k: h[k])
    while len(want) < 20:
        for k in order:
            if pools[k] and len(want) < 20:
                want.append(pools[k].pop(0))
    got = [r.sample_id for r in splits.neutral_cohort(df, "sample_id", "neutral_stratum", 20, 42).orderBy("selected_order").collect()]
    assert got == want


def test_duplicate_keys_are_refused(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        audit.merge_checked(a, spark.createDataFrame([(1,)], "k int"), "k")


def test_delta_fields_and_gate(spark):
    rows = [(f"s{i % 16}", int(i % 5 == 0), 0.8 * (i % 5 == 0) + (i % 7) * 0.01, -float(i % 9)) for i in range(48)]
    df = spark.createDataFrame(rows, "scenario_id string, y int, score double, base double")
    out = bootstrap.wins(bootstrap.paired_delta(df, "y", "base", "score", "scenario_id", 50)).collect()
    assert {r.metric for r in out} == {"auprc", "auroc", "recall_strict"}
    assert all(r.n_scenarios == 16 and r.n_samples == 48 for r in out)
    assert next(r for r in out if r.metric == "auprc").win


def test_results_do_not_depend_on_partitioning(spark):
    rows = [(f"s{i % 11}", int(i * 7 % 5 < 2), float(i * 37 % 101), float(i * 53 % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, y int, a double, b double")
    run = lambda d, n: sorted(map(tuple, bootstrap.replicate_metrics(d, "y", ["a", "b"], "g", 10, buckets=n).collect()))
    first = run(df, 8)
    assert first == run(df.repartition(5, "a"), 8)
    close = run(df.repartition(3), 2)
    assert [r[:2] for r in first] == [r[:2] for r in close]
    assert all(abs(x - z) < 1e-9 for r, s in zip(first, close) for x, z in zip(r[2:], s[2:]))


def test_quantiles_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=3000), 2)
    groups = np.where(rng.random(3000) < 0.6, "hot", "cold")
    df = spark.createDataFrame(list(zip(groups.tolist(), values.tolist())), "g string, v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for r in ordered.quantiles(df, "v", qs, ["g"], buckets=16).collect():
        want = np.quantile(values[groups == r.g], qs)
        assert np.allclose([r[f"q{i}"] for i in range(len(qs))], want)


def test_recall_grows_with_level_and_auprc_is_rank_only(spark):
    df = spark.createDataFrame([(int(i * 13 % 7 < 2), float(i * 31 % 97)) for i in range(300)], "y int, s double")
    levels = [0.01, 0.05, 0.1, 0.3]
    recalls = [metrics.recall_at_fpr_strict(df, "y", "s", v).first()[0] for v in levels]
    assert recalls == sorted(recalls)
    a = metrics.auprc(df, "y", "s").first()[0]
    b = metrics.auprc(df.withColumn("s", F.exp(F.col("s") / 50)), "y", "s").first()[0]
    assert abs(a - b) < 1e-12


def test_clip_keeps_null(spark):
    row = spark.range(1).select(c.clip(F.lit(None).cast("double"), 0, 1).alias("n"), c.clip(F.lit(4.0), 0, 1).alias("x")).first()
    assert row.n is None and row.x == 1.0
