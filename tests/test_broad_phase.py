"""Overlaps by way of swept blocks."""

import numpy as np

from feaslens.operators import actions


def test_blocks_give_the_same_overlaps(spark):
    r = np.random.default_rng(2)
    pose = "k int, t double, x double, y double, heading double, length double, width double"
    move = lambda x, y, v, h, k: (k, k * 0.1, float(x + v * k * np.cos(h)), float(y + v * k * np.sin(h)), float(h), 4.0, 2.0)
    mine, theirs = [], []
    for s in range(6):
        for c in range(12):
            x, y, v, h = r.uniform(-5, 5), r.uniform(-3, 3), r.uniform(0, 1), r.uniform(-0.4, 0.4)
            mine += [(f"s{s}", c, *move(x, y, v, h, k)) for k in range(31)]
        for a in range(7):
            x, y, v, h = r.uniform(-40, 60), r.uniform(-30, 30), r.uniform(0, 1), r.uniform(-3, 3)
            theirs += [(f"s{s}", a, *move(x, y, v, h, k)) for k in range(0, 31) if (k + a) % 5]
    roll = spark.createDataFrame(mine, f"sample_id string, candidate_id int, {pose}")
    obs = spark.createDataFrame(theirs, f"sample_id string, agent_id int, {pose}").drop("t")
    keys = ["sample_id", "candidate_id"]
    flat = lambda df: sorted((r.sample_id, r.candidate_id, r.k, r.t, r.first.agent_id, round(r.first.distance, 9)) for r in df.collect())
    want = flat(actions.overlap_hits(roll, obs, keys, grow=0.2))
    assert want and flat(actions.overlap_hits_in_blocks(roll, obs, keys, grow=0.2)) == want
    blocks = actions.meeting_blocks(roll, obs, keys, 0.2)
    assert blocks.count() < 6 * 12 * 7 * 4 / 2  # most blocks never meet, so their poses are not paired


def test_the_extended_grid_is_a_local_table(spark):
    grid = actions.lattice_candidates(spark, "lattice_extended")
    assert grid.count() == 130 and [r.candidate_id for r in grid.orderBy("candidate_id").collect()] == list(range(130))
    assert "Cartesian" not in grid._jdf.queryExecution().toString() and "Join" not in grid._jdf.queryExecution().toString()
