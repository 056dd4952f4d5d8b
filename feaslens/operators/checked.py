"""Rollouts and their checks, one sample at a time.

A sample's ego, obstacles and lane segments come as one run of sorted rows. Its rollouts are laid out as arrays over (candidate, step) and
tested in numpy, and only results leave the task: the poses, of which a sample has thousands, are never shuffled, sorted or spilled.
The arithmetic is that of ``actions`` (``rollout_lattice``, ``rollout_actions``, ``overlap_hits``, ``lane_distance``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo
from feaslens.operators import actions as ac
from feaslens.operators import ordered

EGO, SEGMENT, OTHERS = range(3)
NUMBERS = ("x", "y", "vx", "vy", "heading", "length", "width")


def scene_rows(agents: DataFrame, lanes: DataFrame | None, others: Sequence[DataFrame | None]) -> DataFrame:
    """Everything about a sample in one table, sorted by sample: ego, lane segments and obstacles, which are given poses or (None) all other agents as they are now."""
    def rows(df: DataFrame, kind: int, agent: Column, k: Column, values: dict[str, Column]) -> DataFrame:
        return df.select("sample_id", F.lit(kind).alias("kind"), agent.cast("bigint").alias("agent_id"), k.cast("int").alias("k"),
                         *[values.get(c, F.lit(None)).cast("double").alias(c) for c in NUMBERS])
    own = {c: F.col(c) for c in NUMBERS}
    none = F.lit(None)
    out = rows(agents.filter("is_ego"), EGO, none, none, own)
    if lanes is not None:
        ends = dict(zip(NUMBERS, (F.col(c) for c in ("x1", "y1", "x2", "y2"))))
        out = out.unionByName(rows(geo.lane_segments(lanes), SEGMENT, none, F.col("inner"), ends))
    for i, poses in enumerate(others):
        if poses is None:
            part = rows(agents.filter("not is_ego"), OTHERS + i, F.col("agent_id"), none, own | {"heading": ac._travel_heading()})
        else:
            part = rows(poses, OTHERS + i, F.col("agent_id"), F.col("k"), {c: F.col(c) for c in NUMBERS if c not in ("vx", "vy")})
        out = out.unionByName(part)
    return ordered.spread(out, "sample_id").sortWithinPartitions("sample_id", "kind", "agent_id", "k")


def by_sample(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[tuple[str, dict[int, dict[str, np.ndarray]]]]:
    """(sample_id, columns by kind) of every sample that has an ego."""
    held: pa.Table | None = None

    def split(table: pa.Table, whole: bool) -> Iterator:
        ids = table.column("sample_id").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        kind = table.column("kind").to_numpy()
        agent, k = (table.column(c).fill_null(0).to_numpy() for c in ("agent_id", "k"))
        numbers = np.stack([table.column(c).fill_null(math.nan).to_numpy() for c in NUMBERS])
        for a, b in zip(starts[:-1], starts[1:] if whole else starts[1:-1]):
            cut = np.searchsorted(kind[a:b], np.arange(kinds + 1)) + a
            if cut[1] > cut[0]:
                yield ids[a], {i: {"agent_id": agent[s:e], "k": k[s:e], **dict(zip(NUMBERS, numbers[:, s:e]))} for i, (s, e) in enumerate(zip(cut[:-1], cut[1:]))}
        if not whole:
            yield None, table.slice(starts[-2])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        for sample, scene in split(table, False):
            if sample is None:
                held = scene
            else:
                yield sample, scene
    if held is not None:
        yield from split(held, True)


def obstacles(rows: dict[str, np.ndarray], moving: bool, ks: np.ndarray, dt: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(agent, which of the steps ``ks`` it has, its x, y, heading, length, width there) in the order of agents."""
    out = []
    if moving:
        t = ks * dt
        for i in range(len(rows["agent_id"])):
            x, y, vx, vy, h, le, w = (rows[c][i] for c in NUMBERS)
            same = np.ones(len(ks))
            out.append((int(rows["agent_id"][i]), np.arange(len(ks)), np.stack([x + vx * t, y + vy * t, h * same, le * same, w * same])))
        return out
    ids, starts = np.unique(rows["agent_id"], return_index=True)
    place = {int(k): i for i, k in enumerate(ks)}
    for i, a, b in zip(ids, starts, [*starts[1:], len(rows["agent_id"])]):
        at = [(place[int(k)], j) for j, k in zip(range(a, b), rows["k"][a:b]) if int(k) in place]
        if at:
            steps, j = (np.array(v) for v in zip(*at))
            out.append((int(i), steps, np.stack([rows[c][j] for c in ("x", "y", "heading", "length", "width")])))
    return out


def first_hits(x: np.ndarray, y: np.ndarray, heading: np.ndarray, length: float, width: float, grow: float, others: list) -> tuple[np.ndarray, np.ndarray]:
    """Smallest agent that meets each pose (position in ``others``, or -1) and the distance of the centres. The last axis of the poses is the step."""
    first, dist = np.full(x.shape, -1, dtype=np.int64), np.full(x.shape, math.nan)
    hl, hw = length * 0.5 + grow, width * 0.5 + grow
    radius = math.sqrt(hl * hl + hw * hw)
    for j, (_, steps, (ox, oy, oh, ol, ow)) in enumerate(others):
        bl, bw = ol * 0.5, ow * 0.5
        dx, dy = ox - x[..., steps], oy - y[..., steps]
        reach = radius + np.sqrt(bl * bl + bw * bw) + 1e-6
        near = np.nonzero((dx * dx + dy * dy <= reach * reach) & (first[..., steps] < 0))
        if not len(near[0]):
            continue
        at = (*near[:-1], steps[near[-1]])
        dx, dy, h, step = dx[near], dy[near], heading[at], near[-1]
        c, s, oc, os, bl, bw = np.cos(h), np.sin(h), np.cos(oh[step]), np.sin(oh[step]), bl[step], bw[step]
        cosd, sind = np.abs(c * oc + s * os), np.abs(c * os - s * oc)
        meet = ((np.abs(dx * c + dy * s) <= hl + bl * cosd + bw * sind + geo.EPS) & (np.abs(dy * c - dx * s) <= hw + bl * sind + bw * cosd + geo.EPS)
                & (np.abs(dx * oc + dy * os) <= bl + hl * cosd + hw * sind + geo.EPS) & (np.abs(dy * oc - dx * os) <= bw + hl * sind + hw * cosd + geo.EPS))
        at = tuple(a[meet] for a in at)
        first[at] = j
        dist[at] = np.sqrt(dx * dx + dy * dy)[meet]
    return first, dist


def lane_gaps(x: np.ndarray, y: np.ndarray, seg: dict[str, np.ndarray], reach: float) -> np.ndarray:
    """Smallest lane buffer (up to ``reach``) that takes in each pose, else infinity."""
    px, py = x.ravel(), y.ravel()
    best = np.full(len(px), math.inf)
    left, right, low, high = (px.min(), px.max(), py.min(), py.max()) if len(px) else (0.0,) * 4
    pad = reach + 1e-6
    for x1, y1, x2, y2, inner in zip(seg["x"], seg["y"], seg["vx"], seg["vy"], seg["k"]):
        if max(x1, x2) + pad < left or min(x1, x2) - pad > right or max(y1, y2) + pad < low or min(y1, y2) - pad > high:
            continue
        ex, ey = x2 - x1, y2 - y1
        len2 = ex * ex + ey * ey
        dx, dy = px - x1, py - y1
        if len2 > 0:
            along, across = dx * ex + dy * ey, dx * ey - dy * ex
            flat = np.where((along >= 0) & (along <= len2), across * across / len2, math.inf)
            np.minimum(best, flat, out=best)
        if inner:
            dx, dy = px - x2, py - y2
            np.minimum(best, dx * dx + dy * dy, out=best)
    gap = np.sqrt(best)
    return np.where(gap <= reach, gap, math.inf).reshape(x.shape)


def smoothstep(u: np.ndarray) -> np.ndarray:
    z = np.minimum(np.maximum(u, 0.0), 1.0)
    return z * z * (3.0 - 2.0 * z)


def wrap_to_pi(a: np.ndarray) -> np.ndarray:
    n = 2.0 * math.pi
    r = np.fmod(a + math.pi, n)
    return np.where(r < 0, np.fmod(r + n, n), r) - math.pi


def lattice_poses(ego: dict[str, np.ndarray], accel: np.ndarray, offset: np.ndarray, duration: np.ndarray, n: int, dt: float) -> dict[str, np.ndarray]:
    """``rollout_lattice`` of one ego as arrays of (candidate, step)."""
    x0, y0, vx, vy, h0 = (float(ego[c][0]) for c in NUMBERS[:5])
    c0, s0, v0 = math.cos(h0), math.sin(h0), math.sqrt(vx * vx + vy * vy)
    a = accel[:, None]
    slow = a < 0
    full = np.where(slow, np.floor(v0 / np.where(slow, -a * dt, 1.0) + 1e-12), float(1 << 30))
    k = np.arange(n + 1)[None, :]
    t, tf = k * dt, np.where(slow, full, 0.0) * dt
    moving = v0 * t + 0.5 * a * t * t
    stopped = v0 * tf + 0.5 * a * tf * tf + 0.5 * np.maximum(v0 + a * tf, 0.0) * dt
    run = np.where(k <= full, moving, stopped)
    lat = offset[:, None] * smoothstep(t / np.maximum(duration[:, None], 1e-3))
    ds, dl = np.diff(run, axis=1), np.diff(lat, axis=1)
    moved = np.sqrt(ds * ds + dl * dl)
    turned = np.where(moved > 1e-8, np.arctan2(ds * s0 + dl * c0, ds * c0 - dl * s0), math.nan)
    heading = np.empty(run.shape)
    heading[:, 0] = np.where(np.isnan(turned[:, 0]), h0, turned[:, 0])
    before = np.full(len(run), h0)
    for i in range(n):
        before = np.where(np.isnan(turned[:, i]), before, turned[:, i])
        heading[:, i + 1] = before
    speed = np.concatenate([moved[:, :1], moved], axis=1) / dt
    zero = np.zeros((len(run), 1))
    yaw = np.concatenate([zero, wrap_to_pi(np.diff(heading, axis=1)) / dt], axis=1)
    return {"t": np.arange(n + 1) * dt, "x": x0 + run * c0 - lat * s0, "y": y0 + run * s0 + lat * c0, "heading": heading,
            "acceleration": np.concatenate([zero, np.diff(speed, axis=1) / dt], axis=1), "yaw_rate": yaw, "lateral_accel": speed * yaw, "progress": run[:, -1]}


def first_time(hit: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Time of the first step that is marked, NaN where none is."""
    return np.where(hit.any(axis=-1), t[hit.argmax(axis=-1)], math.nan)


CANDIDATE = ("sample_id string, candidate_id int, longitudinal_profile string, lateral_profile string, action_family string, action_cost double, feasible boolean, first_failure_time_s double, "
             "failure_reason string, collision_flag boolean, lane_buffer_flag boolean, progress_flag boolean, kinematic_flag boolean, blocking_agent_id long, initial_overlap_count int, "
             "progress_m double, max_abs_accel_mps2 double, max_abs_yaw_rate_rad_s double, max_lateral_accel_mps2 double")


def evaluate_lattice(agents: DataFrame, lanes: DataFrame | None, family: str, p: ac.PlannerParams, obstacle_poses: DataFrame | None = None) -> DataFrame:
    """The rows of ``evaluate_candidates`` over ``rollout_lattice``. Obstacles are the given poses, or else the other agents at constant velocity."""
    cand = sorted(ac.lattice_candidates(agents.sparkSession, family).collect(), key=lambda c: c.candidate_id)  # 35 or 130
    accel, offset, duration = (np.array([c[f] for c in cand]) for f in ("accel", "lat_offset", "lat_duration"))
    comfort = np.array([c.action_family == "comfort" for c in cand])
    command = (accel > p.max_comfort_accel + 1e-9) | (accel < np.where(comfort, p.max_comfort_decel, p.max_emergency_decel) - 1e-9)
    may_crawl = np.array([c.longitudinal_profile == "hard_brake" for c in cand])
    info = [pa.array([c[f] for c in cand], kind) for f, kind in (("candidate_id", pa.int32()), ("longitudinal_profile", pa.string()), ("lateral_profile", pa.string()), ("action_family", pa.string()), ("action_cost", pa.float64()))]
    use_lanes, moving = p.use_lanes and lanes is not None, obstacle_poses is None
    names = [f.split(" ")[0] for f in CANDIDATE.split(", ")]
    reasons = pa.array(["collision", "lane_buffer", "progress", "kinematic", "no_failure"])
    n = p.steps

    def judged(scene: dict) -> list[np.ndarray]:
        ego = scene[EGO]
        roll = lattice_poses(ego, accel, offset, duration, n, p.dt)
        t = roll["t"]
        others = obstacles(scene[OTHERS], moving, np.arange(n + 1), p.dt)
        first, _ = first_hits(roll["x"], roll["y"], roll["heading"], ego["length"][0], ego["width"][0], p.safety_buffer_m, others)
        early = t < p.ignore_initial_s
        late = (first >= 0) & ~early
        hit = late.any(axis=1)
        agent = first[np.arange(len(cand)), late.argmax(axis=1)]
        ids = np.array([o[0] for o in others] + [-1], dtype=np.int64)
        started = first[:, early]
        initial = np.zeros(len(cand), dtype=np.int32)
        for j in np.unique(started[started >= 0]):
            initial += (started == j).any(axis=1)
        lane_t = np.full(len(cand), math.nan)
        if use_lanes and len(scene[SEGMENT]["x"]):
            lane_t = first_time(lane_gaps(roll["x"], roll["y"], scene[SEGMENT], p.lane_buffer_m) > p.lane_buffer_m, t)
        off = ~np.isnan(lane_t)
        motion = ((np.abs(roll["yaw_rate"]) > ac.MAX_YAW_RATE) | (np.abs(roll["lateral_accel"]) > ac.MAX_LATERAL_ACCEL)).any(axis=1)
        kin = command | motion
        slow = (roll["progress"] < p.min_progress_m) & ~may_crawl
        times = np.stack([first_time(late, t), lane_t, np.where(command, 0.0, math.nan), np.where(slow, t[-1], math.nan)])
        reason = np.select([hit, off, slow, kin], [0, 1, 2, 3], 4)
        return [reason == 4, np.fmin.reduce(times), reason, hit, off, slow, kin, ids[np.where(hit, agent, -1)], initial, roll["progress"],
                np.abs(roll["acceleration"]).max(axis=1), np.abs(roll["yaw_rate"]).max(axis=1), np.abs(roll["lateral_accel"]).max(axis=1)]

    def packed(samples: list[str], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*parts)]
        each = pa.array(np.tile(np.arange(len(cand)), len(samples)))
        which = pa.array(samples, pa.string()).take(pa.array(np.repeat(np.arange(len(samples)), len(cand))))
        time, hit = cols[1], cols[3]
        return pa.RecordBatch.from_arrays([which, *[i.take(each) for i in info], pa.array(cols[0]), pa.array(time, mask=np.isnan(time)), reasons.take(pa.array(cols[2])), *[pa.array(c) for c in cols[3:7]],
                                           pa.array(cols[7], mask=~hit), *[pa.array(c) for c in cols[8:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, parts = [], []
        for sample, scene in by_sample(batches, OTHERS + 1):
            samples.append(sample)
            parts.append(judged(scene))
            if len(samples) * len(cand) >= 10_000:
                yield packed(samples, parts)
                samples, parts = [], []
        if samples:
            yield packed(samples, parts)

    return scene_rows(agents, lanes, [obstacle_poses]).mapInArrow(run, CANDIDATE)


def action_poses(ego: dict[str, np.ndarray], accel: np.ndarray, lat_m: np.ndarray, horizon: np.ndarray, steps: int, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rollout_actions`` of one ego: x, y and heading as arrays of (action, step 1 …); steps after an action's horizon are NaN."""
    x0, y0, vx, vy, h0 = (float(ego[c][0]) for c in NUMBERS[:5])
    v0 = math.sqrt(vx * vx + vy * vy)
    h0 = math.atan2(vy, vx) if v0 > ac.SPEED_FLOOR else h0
    c0, s0 = math.cos(h0), math.sin(h0)
    k = np.arange(1, steps + 1)[None, :]
    t, a, h = k * dt, accel[:, None], np.maximum(horizon[:, None], 1e-9)
    tt = np.where(a < 0, np.minimum(t, v0 / np.maximum(-a, 1e-9)), t)
    run, speed = np.maximum(v0 * tt + 0.5 * a * tt * tt, 0.0), np.maximum(v0 + a * tt, 0.0)
    u = t / h
    z = np.minimum(np.maximum(u, 0.0), 1.0)
    lat, lat_v = lat_m[:, None] * smoothstep(u), lat_m[:, None] * (6.0 * z * (1.0 - z)) / h
    made = k <= np.floor(horizon[:, None] / dt + 1e-6)
    x, y, heading = x0 + c0 * run - s0 * lat, y0 + s0 * run + c0 * lat, h0 + np.arctan2(lat_v, np.maximum(speed, ac.SPEED_FLOOR))
    return tuple(np.where(made, v, math.nan) for v in (x, y, heading))


def check_actions(agents: DataFrame, lanes: DataFrame, others: Sequence[DataFrame | None], actions: Sequence[tuple[float, float, float]], dt: float, reach: float, schema: str,
                  summary, grow: float = 0.0, start: bool = False) -> DataFrame:
    """``summary(hits, gaps, has_lanes, made)`` of every sample, as rows of ``schema`` after the sample id.

    ``actions`` are (acceleration, lateral offset, horizon). ``hits`` has (agents, their distances) for each of ``others``, agents being -1 where none is met;
    ``gaps`` the lane buffers that take in the poses; ``made`` tells which steps an action has. With ``start`` the hits begin with the current pose as step 0.
    """
    accel, lat_m, horizon = (np.array(c, dtype=np.float64) for c in zip(*actions))
    steps = int(np.floor(horizon / dt + 1e-6).max())
    ks = np.arange(0 if start else 1, steps + 1)
    made = np.arange(1, steps + 1)[None, :] <= np.floor(horizon[:, None] / dt + 1e-6)
    moving = [o is None for o in others]
    schema = f"sample_id string, {schema}"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def judged(scene: dict) -> list[pa.Array]:
        ego = scene[EGO]
        x, y, heading = action_poses(ego, accel, lat_m, horizon, steps, dt)
        seg = scene[SEGMENT]
        gaps = np.full(x.shape, math.inf)
        gaps[made] = lane_gaps(x[made], y[made], seg, reach)
        if start:
            x, y, heading = (np.concatenate([np.full((len(v), 1), float(ego[c][0])), v], axis=1) for c, v in (("x", x), ("y", y), ("heading", heading)))
        hits = []
        for i, as_now in enumerate(moving):
            there = obstacles(scene[OTHERS + i], as_now, ks, dt)
            first, dist = first_hits(x, y, heading, ego["length"][0], ego["width"][0], grow, there)
            ids = np.array([o[0] for o in there] + [-1], dtype=np.int64)
            hits.append((ids[first], dist))
        return summary(hits, gaps, len(seg["x"]) > 0, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, parts, rows = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([s for s, p in zip(samples, parts) for _ in range(len(p[0]))], pa.string()), *[pa.concat_arrays(c) for c in zip(*parts)]], names=names)
        for sample, scene in by_sample(batches, OTHERS + len(moving)):
            samples.append(sample)
            parts.append(judged(scene))
            rows += len(parts[-1][0])
            if rows >= 10_000:
                yield pack()
                samples, parts, rows = [], [], 0
        if samples:
            yield pack()

    return scene_rows(agents, lanes, others).mapInArrow(run, schema)


def number(values: np.ndarray) -> pa.Array:
    """Doubles with null for NaN."""
    return pa.array(values, mask=np.isnan(values))
