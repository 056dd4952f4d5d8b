"""Column geometry and the candidate checks against slow numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo
from feaslens.operators import actions as ac
from feaslens.operators import curves, occupancy

RNG = np.random.default_rng(7)


def corners(x, y, h, length, width):
    c, s = math.cos(h), math.sin(h)
    pts = np.array([[1, 1], [1, -1], [-1, -1], [-1, 1]]) * [length / 2, width / 2]
    return pts @ np.array([[c, -s], [s, c]]).T + [x, y]


def overlap(p, q):
    for poly in (p, q):
        for i in range(4):
            e = poly[(i + 1) % 4] - poly[i]
            n = np.array([-e[1], e[0]]) / np.hypot(*e)
            a, b = p @ n, q @ n
            if a.max() < b.min() or b.max() < a.min():
                return False
    return True


def segment_gap(a, b, p):
    t = np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1)
    return np.hypot(*(a + t * (b - a) - p))


def gap(p, q):
    if overlap(p, q):
        return 0.0
    return min(segment_gap(u[i], u[(i + 1) % 4], v[j]) for u, v in ((p, q), (q, p)) for i in range(4) for j in range(4))


def test_boxes(spark):
    rows = [tuple(map(float, (*RNG.uniform(-6, 6, 2), RNG.uniform(-4, 4), *RNG.uniform(1, 6, 2), *RNG.uniform(-6, 6, 2), RNG.uniform(-4, 4), *RNG.uniform(1, 6, 2)))) for _ in range(400)]
    names = [f"{p}{n}" for p in ("a", "b") for n in ("x", "y", "h", "l", "w")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    df = geo.with_box(geo.with_box(df, "p", "ax", "ay", "ah", "al", "aw"), "q", "bx", "by", "bh", "bl", "bw")
    got = {r.i: r for r in df.select("i", geo.obb_overlap(geo.box("p"), geo.box("q")).alias("hit"), geo.obb_distance(geo.box("p"), geo.box("q")).alias("gap")).collect()}
    hits = 0
    for i, r in enumerate(rows):
        p, q = corners(*r[:5]), corners(*r[5:])
        assert got[i].hit == overlap(p, q)
        assert got[i].gap == pytest.approx(gap(p, q), abs=1e-9)
        hits += got[i].hit
    assert 0 < hits < 400


def test_swept_box(spark):
    """Sweep test equals sampling many positions of the box."""
    rows = [tuple(map(float, (*RNG.uniform(-8, 8, 2), *RNG.uniform(-6, 6, 2), *RNG.uniform(0.5, 3, 2)))) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, qx double, qy double, mx double, my double, hl double, hw double")
    got = {r.i: r.hit for r in df.select("i", geo.swept_contains(*[F.col(n) for n in ("qx", "qy", "mx", "my", "hl", "hw")]).alias("hit")).collect()}
    ts = np.linspace(0, 1, 4001)
    for i, (qx, qy, mx, my, hl, hw) in enumerate(rows):
        near = np.maximum(np.abs(qx - ts * mx) - hl, np.abs(qy - ts * my) - hw).min()
        if abs(near) > 5e-3:
            assert got[i] == (near <= 0)


def test_lane_buffer(spark):
    line = [(0.0, 0.0), (10.0, 0.0), (18.0, 6.0), (30.0, 6.0)]
    lanes = spark.createDataFrame([("s", 0, i, x, y) for i, (x, y) in enumerate(line)], "sample_id string, lane_ix int, seq int, x double, y double")
    pts = [tuple(map(float, p)) for p in RNG.uniform([-6, -6], [36, 14], (300, 2))]
    df = spark.createDataFrame([("s", i, *p) for i, p in enumerate(pts)], "sample_id string, i int, x double, y double")
    got = {r.i: r.on_lane for r in ac.on_lane(df, ["sample_id", "i"], lanes, 2.0).collect()}
    for i, (x, y) in enumerate(pts):
        on = False
        for (x1, y1), (x2, y2) in zip(line, line[1:]):
            e, p = np.array([x2 - x1, y2 - y1]), np.array([x - x1, y - y1])
            t = np.dot(p, e) / np.dot(e, e)
            on |= 0 <= t <= 1 and abs(p[0] * e[1] - p[1] * e[0]) / np.hypot(*e) <= 2.0
        on |= any(np.hypot(x - vx, y - vy) <= 2.0 for vx, vy in line[1:-1])
        assert got[i] == on
    other = spark.createDataFrame([("t", 1, 99.0, 99.0)], "sample_id string, i int, x double, y double")
    assert ac.on_lane(other, ["sample_id", "i"], lanes, 2.0).first().on_lane  # a sample without lanes is unconstrained


SCENE = "sample_id string, agent_id int, is_ego boolean, x double, y double, vx double, vy double, heading double, length double, width double"


def scene(spark):
    agents = [("d", 0, True, 0.0, 0.0, 15.0, 0.0, 0.0, 4.8, 1.9), ("d", 1, False, 18.0, 1.5, 8.0, 0.0, 0.0, 4.6, 1.8), ("d", 2, False, 24.0, -2.0, 6.0, 0.0, 0.0, 4.6, 1.8)]
    states = [("d", a[1], a[2], k, k * 0.1, a[3] + a[5] * k * 0.1, a[4] - 0.14 * k * (a[1] == 1), a[5], a[6], a[7], True, a[8], a[9]) for a in agents for k in range(11)]
    lanes = [("d", l, s, -20.0 + 10 * s, (l - 1) * 3.5) for l in range(3) for s in range(11)]
    return (spark.createDataFrame(agents, SCENE),
            spark.createDataFrame(states, "sample_id string, agent_id int, is_ego boolean, k int, t_s double, x double, y double, vx double, vy double, heading double, valid boolean, length double, width double"),
            spark.createDataFrame(lanes, "sample_id string, lane_ix int, seq int, x double, y double"))


def numpy_failure(action, horizon=1.0, dt=0.1):
    """First off-lane or overlap time of an action in the smoke scene, by loops."""
    _, _, _, a, lat, _ = action
    for k in range(1, 11):
        t = k * dt
        tt = min(t, 15.0 / -a) if a < 0 else t
        run, speed = max(15 * tt + a * tt * tt / 2, 0), max(15 + a * tt, 0)
        u = t / horizon
        x, y, h = run, lat * u * u * (3 - 2 * u), math.atan2(lat * 6 * u * (1 - u) / horizon, max(speed, 0.2))
        if min(abs(y - c) for c in (-3.5, 0, 3.5)) > 3.0 or not -20 <= x <= 80:
            return t
        ego = corners(x, y, h, 4.8, 1.9)
        if overlap(ego, corners(18 + 8 * t, 1.5 - 1.4 * t, 0, 4.6, 1.8)) or overlap(ego, corners(24 + 6 * t, -2, 0, 4.6, 1.8)):
            return t
    return None


def test_first_failure(spark):
    agents, states, lanes = scene(spark)
    roll = ac.rollout_actions(ac.ego_rows(agents), ac.with_horizon(ac.action_library(spark, "extended"), 1.0), 0.1)
    got = {r.action: r.failure_time_s for r in ac.first_failure(roll, ac.obstacle_pose(agents, states, "oracle_future", 10, 0.1), lanes, 3.0, ["sample_id", "action"]).collect()}
    for action in ac.LIBRARIES["extended"]:
        want = numpy_failure(action)
        assert (got[action[0]] is None) == (want is None)
        if want is not None:
            assert got[action[0]] == pytest.approx(want)


def test_variants_equal_single_runs(spark):
    agents, states, lanes = scene(spark)
    variants = [ac.Variant("a", "x", 1.0, 3.0, "base7", "skip_invalid"), ac.Variant("b", "x", 0.6, 3.0, "base7", "skip_invalid"), ac.Variant("c", "x", 1.0, 3.0, "extended", "cv_fallback")]
    got = {r.variant_id: r for r in ac.label_variants(agents, states, lanes, 0.1, variants).collect()}
    for v in variants:
        mode = "oracle_future" if v.future_handling == "skip_invalid" else "cv_fallback"
        want = ac.actionability_labels(agents, states, lanes, v.horizon_s, 0.1, mode, "moderate", v.action_library, v.lane_buffer_m).first()
        for c in ("comfort_feasible_ratio", "emergency_feasible_ratio", "actionability_label_id", "time_to_no_emergency_s", "min_required_action_cost"):
            assert got[v.variant_id][c] == want[c]


def test_audit_modes_agree_with_first_failure(spark):
    agents, states, lanes = scene(spark)
    rows = ac.feasibility_audit(agents, states, lanes, 1.0, 0.1).collect()
    assert len(rows) == 35
    for r in rows:
        if r.checked_mode == "original_oracle_map":
            want = numpy_failure(next(a for a in ac.BASE_ACTIONS if a[0] == r.action))
            assert r.feasible == (want is None)
            if want is not None:
                assert r.first_unsafe_time_s == pytest.approx(want)


def test_candidates_are_consistent(spark):
    agents, states, lanes = scene(spark)
    p = ac.PlannerParams(horizon_s=1.0, dt=0.1)
    roll = ac.rollout_lattice(ac.ego_rows(agents), ac.lattice_candidates(spark), 1.0, 0.1)
    out = ac.evaluate_candidates(roll, ac.obstacle_pose(agents, states, "oracle_future", 10, 0.1, start=0), lanes, p, trajectory=True).collect()
    assert len(out) == 35
    for r in out:
        assert r.feasible == (r.failure_reason == "no_failure")
        assert not r.feasible or r.first_failure_time_s is None
        assert len(r.trajectory) == 11
    keep = next(r for r in out if r.longitudinal_profile == "keep_speed" and r.lateral_profile == "keep_lane")
    assert keep.progress_m == pytest.approx(15.0)


def test_occupancy_and_curves(spark):
    agents, states, lanes = scene(spark)
    grid, times = geo.Grid(-20.03, 60.0, -10.01, 10.0, 0.5), [0.1 * k for k in range(1, 11)]
    occ = occupancy.occupancy(occupancy.rasterize_cv(agents, times, grid))
    metrics = occupancy.occupancy_metrics(occ, occupancy.lane_cells(lanes, 2.0, grid), agents, times, grid).first()
    assert 0 <= metrics.rcr <= 1 and metrics.rcr + metrics.rfr == pytest.approx(1.0)
    feats = curves.aligned_features(agents, states, lanes, 0.1, [ac.Variant("a", "x", 1.0, 3.0, "base7", "skip_invalid")]).first()
    assert feats.asr_cum_final <= feats.asr_slice_final and feats.asr_cum_min == feats.asr_cum_final
    assert feats.c_maneuver == pytest.approx(1 - feats.asr_cum_final)
