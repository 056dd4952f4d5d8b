"""Nearest partners by the tree against all pairs, and how many pairs it forms."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feaslens.catalog import matching as queries
from feaslens.operators import boxtree, matching


def all_pairs(q, x, ids, limit):
    gaps = x[None] - q[:, None]
    d2 = gaps[..., 0] * gaps[..., 0]
    for i in range(1, q.shape[1]):
        d2 = d2 + gaps[..., i] * gaps[..., i]
    if limit is not None:
        d2 = np.where((np.abs(gaps) <= limit).all(axis=2), d2, np.inf)
    out = []
    for row in d2:
        best = row.min()
        out.append((float(best), min(ids[k] for k in np.flatnonzero(row == best))) if np.isfinite(best) else None)
    return out


@pytest.mark.parametrize("dims,limit,grid", [(2, None, False), (3, 1.0, False), (3, None, True), (4, 0.5, True), (2, 0.001, False)])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, dims, limit, grid):
    monkeypatch.setattr(boxtree, "LEAF_POINTS", 40)
    monkeypatch.setattr(boxtree, "SHARE", 50)
    r = np.random.default_rng(dims)
    draw = lambda n: np.unique(r.integers(0, 7, (n, dims)) / 2.0 if grid else np.where(r.random((n, 1)) < 0.4, r.normal(0, 0.02, (n, dims)), r.normal(0, 2, (n, dims))), axis=0)
    q, x = draw(500), draw(600)
    ids = [int(i) for i in r.permutation(len(x))]
    queries_ = spark.createDataFrame([(row.tolist(),) for row in q], "v array<double>")
    partners = spark.createDataFrame([(row.tolist(), i) for row, i in zip(x, ids)], "v array<double>, nid long")
    got = {tuple(row.v): tuple(row.best) if row.best else None for row in boxtree.nearest(queries_, partners, dims, limit).collect()}
    assert got == {tuple(v): w for v, w in zip(q.tolist(), all_pairs(q, x, ids, limit))}


def test_text_ids_one_point_and_nothing_to_find(spark):
    q = spark.createDataFrame([([0.0, 0.0],), ([9.0, 9.0],)], "v array<double>")
    one = spark.createDataFrame([([1.0, 0.0], "b"), ([0.0, 1.0], "a")], "v array<double>, nid string")
    got = {tuple(r.v): r.best for r in boxtree.nearest(q, one, 2, 1.0).collect()}
    assert tuple(got[0.0, 0.0]) == (1.0, "a") and got[9.0, 9.0] is None
    none = boxtree.nearest(q, one.limit(0), 2).collect()
    assert len(none) == 2 and all(r.best is None for r in none)
    assert boxtree.nearest(q.limit(0), one, 2).collect() == []


def test_planes_part_ties_and_hold_no_more_leaves_than_asked():
    r = np.random.default_rng(1)
    x = r.integers(0, 3, (5000, 3)).astype(float)
    nodes = boxtree.split_planes(x[:400], 16)
    leaf = boxtree.leaf_of(x, nodes)
    assert len(set(leaf.tolist())) == len(nodes) + 1 <= 16
    assert boxtree.split_planes(np.ones((50, 2)), 8) == [] and (boxtree.leaf_of(np.ones((3, 2)), []) == 0).all()


def met(spark, sf):
    setting = next(s for s in matching.SETTINGS if s.name == "distance_speed_agent")
    rows = queries.match_rows(spark, sf).select("id", "y", F.array(*[F.col(c) / w for c, w in setting.calipers]).alias("v"))
    partners = rows.filter("y = 0").groupBy("v").agg(F.min("id").alias("nid"))
    found = boxtree.nearest(rows.filter("y = 1").select("v").distinct(), partners, 3)
    return found.agg(F.sum("met"), F.count("*")).first()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs two sizes of the tables")
def test_candidate_pairs_grow_with_the_rows(spark):
    (few, n), (many, m) = met(spark, "/root/testdata/sf0.01"), met(spark, "/root/testdata/sf0.1")
    assert few < 200 * n and many < 200 * m and many / few < 15
