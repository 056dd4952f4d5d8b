"""Thresholds come from calibration keys only, lead times from the others."""

from feaslens.operators import leadtime, metrics, splits


def test_calibration_and_test_keys_are_apart(spark):
    rows = [(f"k{i}", float(t), int(i % 2 == 0 and t >= 6), (i * 7 + t * 3) % 10 / 10.0, float(t)) for i in range(40) for t in range(10)]
    df = spark.createDataFrame(rows, "k string, t double, y int, a double, b double")
    onsets = leadtime.event_onset(df, "k", ["t"], "t", "y", 2.0)
    got = leadtime.calibrated_lead_time(df, onsets, "k", "t", "y", ["a", "b"], (0.05, 0.2), 0.35, 3).collect()
    marked = splits.exact_split(df, "k", 0.35, 3, "cal")
    test = {r.k for r in marked.filter("not cal").select("k").distinct().collect()}
    assert len(test) == 26 and {r.k for r in got} == test and len(got) == 26 * 2 * 2
    for s in ("a", "b"):
        fitted = metrics.fpr_threshold(marked.filter("cal"), "y", s, (0.05, 0.2)).first()
        assert {r.threshold for r in got if r.score_name == s} == {fitted.threshold_at_5pct_fpr, fitted.threshold_at_20pct_fpr}


def test_no_threshold_without_calibration_negatives(spark):
    df = spark.createDataFrame([(f"k{i}", float(t), 1, 0.5) for i in range(6) for t in range(4)], "k string, t double, y int, a double")
    onsets = leadtime.event_onset(df, "k", ["t"], "t", "y", 1.0)
    assert leadtime.calibrated_lead_time(df, onsets, "k", "t", "y", ["a"]).collect() == []
