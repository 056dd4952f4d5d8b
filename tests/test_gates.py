"""Gates on clean starts and on strata, at their borders."""

from feaslens.operators import audit as au

SCHEMA = "stratum_column string, stratum string, score_name string, positive_count bigint, auprc double, recall_at_5pct_fpr_strict double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_gate(df):
    return {r.gate: (None if r.value is None else round(r.value, 9), r.passed) for r in df.collect()}


def test_both_metrics_have_to_rise(spark):
    clean = table(spark, [("all", "all", n, 9, a, b) for n, a, b in [("new", 0.6, 0.5), ("old", 0.5, 0.4), ("equal", 0.5, 0.5), ("none", None, 0.1)]])
    got = by_gate(au.overlap_gates(clean, ["new", "gone"], ["old", "equal", "none"]))
    assert got == {"clean_start:new>old": (0.1, True), "clean_start:new>equal": (0.0, False), "clean_start:new>none": (None, False),
                   "clean_start:gone>old": (None, False), "clean_start:gone>equal": (None, False), "clean_start:gone>none": (None, False)}


def test_only_clear_losses_in_large_strata_count(spark):
    rows = []
    for stratum, n, new, old in [("lost", 10, 0.4, 0.5), ("small", 9, 0.1, 0.9), ("near", 50, 0.49, 0.5), ("won", 50, 0.9, 0.5), (None, 20, 0.1, 0.9), ("half", 30, None, 0.5)]:
        rows += [("place", stratum, "new", n, new, 0.0), ("place", stratum, "old", n, old, 0.0)]
    strata = table(spark, rows + [("place", "alone", "new", 40, 0.1, 0.0)])
    assert {r.stratum for r in au.negative_strata(strata, "new", ["old"]).collect()} == {"lost", None}
    assert by_gate(au.stratum_gates(strata, "new", ["old", "gone"])) == {"no_negative_stratum:new>old": (2.0, False), "no_negative_stratum:new>gone": (0.0, True)}


def test_empty_tables_do_not_pass(spark):
    none = table(spark, [])
    assert by_gate(au.overlap_gates(none, ["new"], ["old"])) == {"clean_start:new>old": (None, False)}
    assert by_gate(au.stratum_gates(none, "new", ["old"])) == {"no_negative_stratum:new>old": (0.0, False)}
