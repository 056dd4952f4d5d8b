"""Cosines and sines agree with the C library to the last bit, so that ties and edges fall as in SQL."""

import math

from feaslens.functions import geometry as geo
from feaslens.functions.columns import cos, sin, to_local_vector


def test_last_bits_of_headings(spark):
    turns = [(i - 31) * 0.1 for i in range(63)]
    headings = sorted({a - b for a in turns for b in turns} | {i * 0.001 for i in range(-3000, 3000)})
    df = geo.with_box(spark.createDataFrame([(h, 0.0, 0.0, 4.0, 2.0) for h in headings], "heading double, x double, y double, length double, width double"))
    right, left = to_local_vector("one", "zero", "heading")
    rows = df.selectExpr("*", "1.0D as one", "0.0D as zero").select("heading", "bc", "bs", right.alias("r"), left.alias("l")).collect()
    assert len(rows) == len(headings)
    assert all((r.bc, r.bs, r.r, r.l) == (math.cos(r.heading), math.sin(r.heading), math.cos(r.heading), -math.sin(r.heading)) for r in rows)


def test_nulls_and_what_has_no_angle(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),), (0.0,)], "h double")
    got = [tuple(r) for r in df.select(cos("h"), sin("h")).collect()]
    assert got[0] == (None, None) and got[3] == (1.0, 0.0) and all(math.isnan(v) for r in got[1:3] for v in r)
