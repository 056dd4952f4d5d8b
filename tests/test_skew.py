"""One key holding a third or more of the rows: results equal brute force."""

import numpy as np
from pyspark.sql import functions as F

from feaslens.operators import leadtime, matching, ordered


def test_dense_index_with_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 50}", i, (i * 2654435761 % 1000003) / 1000003.0) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, id int, u double")
    got = ordered.dense_index(df, ["g"], "u", ["id"], 16).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for ix, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))):
            want[r[1]] = ix
    assert {r.id: r.ix for r in got} == want


def test_carry_forward_over_buckets(spark):
    rows = [("hot", i, float(i) if i % 17 == 3 else None) for i in range(500)] + [("b", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumn("b", F.floor(F.col("t") / 40))
    got = {(r.k, r.t): r.out for r in ordered.carry_forward(df, ["k"], ["t"], "v", "out", "b").collect()}
    last = None
    for _, t, v in rows[:500]:
        last = v if v is not None else last
        assert got[("hot", t)] == last
    assert got[("b", 4)] is None


def test_matching_in_one_hot_cell(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = np.where(rng.random(n) < 0.5, rng.normal(0, 0.01, n), rng.uniform(-3, 3, n))  # half the rows in one spot
    z, y = rng.integers(0, 3, n).astype(float), (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i]), float(z[i])) for i in range(n)], "id int, y int, a double, b double")
    pts = np.c_[x, z]
    setting = matching.Setting("t", "t", (("a", 0.5), ("b", 1.0)))
    got = {r.pos_id: r.neg_id for r in matching.caliper_match(df, "id", "y", setting).collect()}
    neg = np.flatnonzero(y == 0)
    scale = np.array([0.5, 1.0])
    want = {}
    for i in np.flatnonzero(y == 1):
        gap = pts[neg] / scale - pts[i] / scale
        ok = (np.abs(gap) <= 1.0).all(axis=1)
        if ok.any():
            d2 = (gap * gap).sum(axis=1)
            best = min((d2[k], int(neg[k])) for k in np.flatnonzero(ok))
            want[int(i)] = best[1]
    assert got == want
    got_nn = {r.pos_id: r.match_distance_z for r in matching.nn_match(df, "id", "y", ["a", "b"]).collect()}
    zs = (pts - pts.mean(axis=0)) / pts.std(axis=0)
    for i in np.flatnonzero(y == 1):
        assert abs(got_nn[int(i)] - np.sqrt(((zs[neg] - zs[i]) ** 2).sum(axis=1).min())) < 1e-9


def test_onset_with_hot_scenario(spark):
    rows = [("hot", i, int(1000 < i % 2000 < 1500)) for i in range(4000)] + [("always", i, 1) for i in range(9)] + [("never", i, 0) for i in range(9)] + [("early", 0, 0), ("early", 1, 1)]
    df = spark.createDataFrame(rows, "k string, t int, y int")
    got = {r.k: r for r in leadtime.event_onset(df, "k", ["t"], "t", "y", 5.0).collect()}
    assert got["hot"].has_valid_onset and got["hot"].event_time_s == 1001
    assert not got["always"].has_valid_onset and got["always"].has_any_event
    assert not got["never"].has_any_event
    assert not got["early"].has_valid_onset and got["early"].pre_event_duration_s == 1.0
