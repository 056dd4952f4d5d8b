"""Action rollouts, their checks against obstacles and lanes, and label-design variants.

Rollouts are closed-form expressions over (ego, action, step). Overlaps join on (sample, step) with a radius test before
the box test. Lane tests join on (sample, grid cell), so a pose meets only the segments near it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo
from feaslens.functions.columns import smoothstep, smoothstep_slope, wrap_to_pi
from feaslens.operators import labels, ordered

# Action libraries (name, family, cost, acceleration, lateral offset, comfortable).
BASE_ACTIONS = (
    ("keep", "keep", 0.0, 0.0, 0.0, True), ("mild_brake", "brake", 0.25, -2.0, 0.0, True), ("hard_brake", "hard_brake", 1.0, -5.0, 0.0, False),
    ("left", "left", 0.5, 0.0, 3.0, True), ("right", "right", 0.5, 0.0, -3.0, True),
    ("brake_left", "brake_left", 1.25, -4.0, 3.0, False), ("brake_right", "brake_right", 1.25, -4.0, -3.0, False),
)
EXTRA_ACTIONS = (
    ("accelerate", "accelerate", 0.35, 1.5, 0.0, True), ("strong_brake", "hard_brake", 1.4, -7.0, 0.0, False),
    ("mild_left", "left", 0.35, 0.0, 1.5, True), ("mild_right", "right", 0.35, 0.0, -1.5, True),
    ("accelerate_left", "left", 0.75, 1.0, 3.0, False), ("accelerate_right", "right", 0.75, 1.0, -3.0, False),
    ("strong_brake_left", "brake_left", 1.6, -6.0, 3.0, False), ("strong_brake_right", "brake_right", 1.6, -6.0, -3.0, False),
)
LIBRARIES = {"base7": BASE_ACTIONS, "extended": BASE_ACTIONS + EXTRA_ACTIONS}

# Lattice profiles. Longitudinal (name, acceleration, cost, emergency); lateral (name, offset, duration, cost, emergency).
LATTICE_LON = {
    "lattice_base": (("keep_speed", 0.0, 0.00, False), ("coast", -0.5, 0.08, False), ("mild_accel", 1.0, 0.16, False), ("mild_brake", -2.0, 0.20, False),
                     ("hard_brake", -6.0, 0.75, True)),
    "lattice_extended": (("strong_accel", 2.0, 0.30, False), ("mild_accel", 1.0, 0.16, False), ("gentle_accel", 0.4, 0.08, False), ("keep_speed", 0.0, 0.00, False),
                         ("coast", -0.5, 0.08, False), ("gentle_brake", -1.0, 0.13, False), ("mild_brake", -2.0, 0.20, False), ("firm_brake", -4.0, 0.48, True),
                         ("hard_brake", -6.0, 0.75, True), ("max_brake", -8.0, 0.92, True)),
}
LATTICE_LAT = {
    "lattice_base": (("keep_lane", 0.0, 1.0, 0.00, False), ("left_offset_1m", 1.0, 1.5, 0.18, False), ("left_offset_2m", 2.0, 2.0, 0.34, False),
                     ("right_offset_1m", -1.0, 1.5, 0.18, False), ("right_offset_2m", -2.0, 2.0, 0.34, False), ("brake_left_1m", 1.0, 1.0, 0.42, True),
                     ("brake_right_1m", -1.0, 1.0, 0.42, True)),
    "lattice_extended": (("keep_lane", 0.0, 1.0, 0.00, False), ("left_offset_0p5m", 0.5, 1.2, 0.10, False), ("right_offset_0p5m", -0.5, 1.2, 0.10, False),
                         ("left_offset_1m", 1.0, 1.5, 0.18, False), ("right_offset_1m", -1.0, 1.5, 0.18, False), ("left_offset_1p5m", 1.5, 1.8, 0.26, False),
                         ("right_offset_1p5m", -1.5, 1.8, 0.26, False), ("left_offset_2m", 2.0, 2.0, 0.34, False), ("right_offset_2m", -2.0, 2.0, 0.34, False),
                         ("left_offset_2p5m", 2.5, 2.4, 0.48, True), ("right_offset_2p5m", -2.5, 2.4, 0.48, True), ("fast_left_1m", 1.0, 0.8, 0.44, True),
                         ("fast_right_1m", -1.0, 0.8, 0.44, True)),
}
MAX_YAW_RATE, MAX_LATERAL_ACCEL = 1.20, 4.50
SPEED_FLOOR = 0.2
#: Steps of a block of the broad phase.
BLOCK_STEPS = 8


@dataclass(frozen=True)
class PlannerParams:
    horizon_s: float = 3.0
    dt: float = 0.1
    safety_buffer_m: float = 0.2
    ignore_initial_s: float = 0.3
    min_progress_m: float = 0.5
    lane_buffer_m: float = 4.0
    max_comfort_accel: float = 2.0
    max_comfort_decel: float = -4.0
    max_emergency_decel: float = -8.0
    use_lanes: bool = True

    @property
    def steps(self) -> int:
        return max(1, int(round(self.horizon_s / max(self.dt, 1e-6))))


@dataclass(frozen=True)
class Variant:
    variant_id: str
    family: str
    horizon_s: float
    lane_buffer_m: float
    action_library: str
    future_handling: str


# The seven design variants.
VARIANTS = (
    Variant("reference_h3_b3_base7_skip", "reference", 3.0, 3.0, "base7", "skip_invalid"),
    Variant("horizon_h2_b3_base7_skip", "horizon", 2.0, 3.0, "base7", "skip_invalid"),
    Variant("horizon_h4_b3_base7_skip", "horizon", 4.0, 3.0, "base7", "skip_invalid"),
    Variant("buffer_h3_b2_base7_skip", "lane_buffer", 3.0, 2.0, "base7", "skip_invalid"),
    Variant("buffer_h3_b4_base7_skip", "lane_buffer", 3.0, 4.0, "base7", "skip_invalid"),
    Variant("action_h3_b3_extended_skip", "action_library", 3.0, 3.0, "extended", "skip_invalid"),
    Variant("future_h3_b3_base7_cvfallback", "future_handling", 3.0, 3.0, "base7", "cv_fallback"),
)


def action_library(spark: SparkSession, name: str) -> DataFrame:
    rows = [(name, i, *a) for i, a in enumerate(LIBRARIES[name])]
    return spark.createDataFrame(rows, "library string, action_ix int, action string, family string, cost double, accel double, lat_m double, comfort boolean")


def lattice_candidates(spark: SparkSession, family: str = "lattice_base") -> DataFrame:
    """The grid as one local table: 35 or 130 candidates."""
    lat = LATTICE_LAT[family]
    rows = [(family, i * len(lat) + j, lon, name, "emergency" if lon_em or lat_em else "comfort", accel, offset, duration, lon_cost + lat_cost)
            for i, (lon, accel, lon_cost, lon_em) in enumerate(LATTICE_LON[family]) for j, (name, offset, duration, lat_cost, lat_em) in enumerate(lat)]
    return spark.createDataFrame(rows, "planner_family string, candidate_id int, longitudinal_profile string, lateral_profile string, action_family string, accel double, "
                                       "lat_offset double, lat_duration double, action_cost double")


def _travel_heading() -> Column:
    """Direction of motion above the speed floor, else the stored heading."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    return F.when(F.sqrt(v2) > SPEED_FLOOR, F.atan2("vy", "vx")).otherwise(F.col("heading"))


def ego_rows(agents: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return agents.filter("is_ego").select("sample_id", *extra, "x", "y", "vx", "vy", "heading", "length", "width")


def rollout_actions(ego: DataFrame, actions: DataFrame, dt: float, keep: Sequence[str] = ("library", "action_ix", "action", "family", "cost", "comfort")) -> DataFrame:
    """Poses of every action at ``dt, 2 dt, …, horizon_s`` (a column of ``actions``).

    Constant acceleration that stops at standstill, smooth lateral shift over the horizon, heading from the two speeds.
    """
    spread = ordered.spread(ego, "sample_id").crossJoin(F.broadcast(actions))  # the action table has at most a few dozen rows per variant
    base = spread.select(
        "sample_id", *keep, "horizon_s", "accel", "lat_m", "length", "width", F.col("x").alias("x0"), F.col("y").alias("y0"),
        F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("v0"), _travel_heading().alias("h0"))
    steps = F.explode(F.sequence(F.lit(1), F.floor(F.col("horizon_s") / dt + 1e-6).cast("int"))).alias("k")
    rows = base.select("*", F.cos("h0").alias("c0"), F.sin("h0").alias("s0"), steps)
    t = F.col("k") * F.lit(dt)
    a, v0 = F.col("accel"), F.col("v0")
    tt = F.when(a < 0, F.least(t, v0 / F.greatest(-a, F.lit(1e-9)))).otherwise(t)
    run, speed = F.greatest(v0 * tt + 0.5 * a * tt * tt, F.lit(0.0)), F.greatest(v0 + a * tt, F.lit(0.0))
    u = t / F.greatest(F.col("horizon_s"), F.lit(1e-9))
    lat, lat_v = F.col("lat_m") * smoothstep(u), F.col("lat_m") * smoothstep_slope(u) / F.greatest(F.col("horizon_s"), F.lit(1e-9))
    return rows.select(
        "sample_id", *keep, "horizon_s", "k", t.alias("t"), (F.col("x0") + F.col("c0") * run - F.col("s0") * lat).alias("x"),
        (F.col("y0") + F.col("s0") * run + F.col("c0") * lat).alias("y"), (F.col("h0") + F.atan2(lat_v, F.greatest(speed, F.lit(SPEED_FLOOR)))).alias("heading"),
        "length", "width")


def with_horizon(actions: DataFrame, horizon: float) -> DataFrame:
    return actions.withColumn("horizon_s", F.lit(float(horizon)))


def obstacle_pose(agents: DataFrame, states: DataFrame, mode: str, steps: int, dt: float, start: int = 1) -> DataFrame:
    """Poses of the other agents per step.

    ``oracle_future`` takes valid recorded states; ``cv_current`` extrapolates the current state; ``cv_fallback`` extrapolates only where
    no valid state was recorded; ``cv_last_valid`` extrapolates from the last valid state (see ``impute_future``).
    """
    fields = ("sample_id", "agent_id", "k", "x", "y", "heading", "length", "width")
    if mode == "oracle_future":
        return states.filter(~F.col("is_ego") & F.col("valid") & F.col("k").between(start, steps)).select(*fields)
    if mode == "cv_current":
        grid = F.explode(F.sequence(F.lit(start), F.lit(steps))).alias("k")
        rows = agents.filter("not is_ego").select("*", _travel_heading().alias("h"), grid)
        t = F.col("k") * F.lit(dt)
        return rows.select("sample_id", "agent_id", "k", (F.col("x") + F.col("vx") * t).alias("x"), (F.col("y") + F.col("vy") * t).alias("y"),
                           F.col("h").alias("heading"), "length", "width")
    filled = impute_future(agents, states, "cv_current" if mode == "cv_fallback" else mode, dt)
    return filled.filter(~F.col("is_ego") & F.col("valid") & F.col("k").between(start, steps)).select(*fields)


def impute_future(agents: DataFrame, states: DataFrame, mode: str, dt: float) -> DataFrame:
    """Fills invalid states: ``skip`` leaves them, ``cv_current`` extrapolates the current state, ``cv_last_valid`` the last valid one.

    ``source`` says where a state came from. The window runs over the few steps of one agent.
    """
    cur = agents.select("sample_id", "agent_id", F.struct(F.lit(0).alias("k"), "x", "y", "vx", "vy", _travel_heading().alias("heading")).alias("cur"))
    rows = states.join(cur, ["sample_id", "agent_id"])
    if mode == "skip":
        return rows.withColumn("source", F.when(F.col("valid"), "recorded").otherwise("invalid")).drop("cur")
    if mode == "cv_current":
        anchor = F.col("cur")
    elif mode == "cv_last_valid":
        w = Window.partitionBy("sample_id", "agent_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.when(F.col("valid"), F.struct("k", "x", "y", "vx", "vy", "heading"))
        rows = rows.withColumn("_seen", F.last(seen, ignorenulls=True).over(w))
        anchor = F.coalesce(F.col("_seen"), F.col("cur"))
    else:
        raise ValueError(f"unknown future handling {mode!r}")
    rows = rows.withColumn("_a", anchor)
    gap = (F.col("k") - F.col("_a.k")) * F.lit(dt)
    pick = lambda c, v: F.when(F.col("valid"), F.col(c)).otherwise(v).alias(c)
    source = F.when(F.col("valid"), "recorded").when(F.col("_a.k") > 0, "cv_from_last_valid").otherwise("cv_from_current")
    return rows.select("sample_id", "agent_id", "is_ego", "k", "t_s", pick("x", F.col("_a.x") + F.col("_a.vx") * gap), pick("y", F.col("_a.y") + F.col("_a.vy") * gap),
                       pick("vx", F.col("_a.vx")), pick("vy", F.col("_a.vy")), pick("heading", F.col("_a.heading")), F.lit(True).alias("valid"),
                       "length", "width", source.alias("source"))


def _gap_to_segment(px: Column, py: Column) -> Column:
    """Squared distance at which the point enters the lane buffer of the segment; null when no buffer reaches it."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ex, ey = x2 - x1, y2 - y1
    len2 = F.nullif(ex * ex + ey * ey, F.lit(0.0))
    along = (px - x1) * ex + (py - y1) * ey
    across = (px - x1) * ey - (py - y1) * ex
    flat = F.when((along >= 0) & (along <= len2), across * across / len2)
    joint = F.when(F.col("inner"), (px - x2) * (px - x2) + (py - y2) * (py - y2))
    return F.least(flat, joint)


def lane_distance(points: DataFrame, keys: Sequence[str], lanes: DataFrame, reach: float) -> DataFrame:
    """Per point the smallest buffer (up to ``reach``) that puts it on a lane; null when farther or when the sample has no lane.

    Column ``has_lanes`` tells the two apart. Segments are listed in the grid cells they can serve, points look in their own cell.
    """
    size = max(4.0 * reach, 8.0)
    seg = geo.lane_segments(lanes)
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / size).cast("int")
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / size).cast("int")
    cells = seg.select("sample_id", "x1", "y1", "x2", "y2", "inner", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2"))).alias("_cx"),
                       lo("y1", "y2").alias("_a"), hi("y1", "y2").alias("_b")).withColumn("_cy", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    placed = points.withColumns({"_cx": F.floor(F.col("x") / size).cast("int"), "_cy": F.floor(F.col("y") / size).cast("int")})
    near = placed.join(cells, ["sample_id", "_cx", "_cy"], "left")
    d2 = F.min(_gap_to_segment(F.col("x"), F.col("y")))
    dist = near.groupBy(*keys).agg(F.when(d2 <= reach * reach, F.sqrt(d2)).alias("lane_distance"))
    have = seg.select("sample_id").distinct().withColumn("has_lanes", F.lit(True))
    return dist.join(have, "sample_id", "left").fillna(False, ["has_lanes"])


def on_lane(points: DataFrame, keys: Sequence[str], lanes: DataFrame, buffer: float) -> DataFrame:
    """``keys`` with ``on_lane``; without lanes everything counts as on the lane."""
    d = lane_distance(points, keys, lanes, buffer)
    return d.select(*keys, (~F.col("has_lanes") | F.col("lane_distance").isNotNull()).alias("on_lane"))


def overlap_hits(rollout: DataFrame, obstacles: DataFrame, keys: Sequence[str], grow: float = 0.0, on: Sequence[str] = ("sample_id", "k")) -> DataFrame:
    """Steps at which a rollout pose meets an obstacle, with the first such agent in agent order."""
    extra = [c for c in on if c not in ("sample_id", "k") and c not in keys]
    a = geo.with_box(rollout, "e", grow=grow).select(*keys, *extra, "k", "t", *[f"e{f}" for f in geo.BOX_FIELDS])
    b = geo.with_box(obstacles).select("sample_id", "k", *extra, "agent_id", *geo.BOX_FIELDS)
    ego, other = geo.box("e"), geo.box("")
    dx, dy = other.x - ego.x, other.y - ego.y
    reach = geo.radius(ego) + geo.radius(other) + 1e-6
    pairs = a.join(b, list(on)).filter(dx * dx + dy * dy <= reach * reach).filter(geo.obb_overlap(ego, other))
    dist = F.sqrt(dx * dx + dy * dy)
    return pairs.groupBy(*keys, *extra, "k", "t").agg(F.min(F.struct("agent_id", dist.alias("distance"))).alias("first"))


def _swept(poses: DataFrame, keys: Sequence[str], grow: float = 0.0) -> DataFrame:
    """Blocks of ``BLOCK_STEPS`` steps: the bounds ``x0`` … ``y1`` that the boxes sweep, and the block's poses."""
    hl, hw = F.col("length") * 0.5 + grow, F.col("width") * 0.5 + grow
    r = F.sqrt(hl * hl + hw * hw) + 1e-6
    times = ["t"] if "t" in poses.columns else []
    return poses.withColumns({"kb": F.floor(F.col("k") / BLOCK_STEPS), "_r": r}).groupBy(*keys, "kb").agg(
        F.min(F.col("x") - F.col("_r")).alias("x0"), F.max(F.col("x") + F.col("_r")).alias("x1"), F.min(F.col("y") - F.col("_r")).alias("y0"), F.max(F.col("y") + F.col("_r")).alias("y1"),
        F.collect_list(F.struct("k", *times, "x", "y", "heading", "length", "width")).alias("poses"))


def _meet(a: str, b: str) -> Column:
    return (F.col(f"{a}.x0") <= F.col(f"{b}.x1")) & (F.col(f"{b}.x0") <= F.col(f"{a}.x1")) & (F.col(f"{a}.y0") <= F.col(f"{b}.y1")) & (F.col(f"{b}.y0") <= F.col(f"{a}.y1"))


def meeting_blocks(rollout: DataFrame, obstacles: DataFrame, keys: Sequence[str], grow: float = 0.0) -> DataFrame:
    """Broad phase in space and time: blocks of a rollout and of an obstacle whose swept bounds meet, with the poses of both (``mine``, ``theirs``).

    An obstacle's block has to meet the bounds of all rollouts of its sample first, then those of a rollout. No poses are paired here.
    """
    ego, other = _swept(rollout, keys, grow), _swept(obstacles, ["sample_id", "agent_id"])
    whole = ego.groupBy("sample_id", "kb").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    near = other.alias("o").join(whole.alias("w"), ["sample_id", "kb"]).filter(_meet("o", "w")).select("sample_id", "kb", "o.agent_id", "o.x0", "o.x1", "o.y0", "o.y1", "o.poses")
    pairs = ego.alias("e").join(near.alias("n"), ["sample_id", "kb"]).filter(_meet("e", "n"))
    return pairs.select(*[f"e.{c}" if c != "sample_id" else c for c in keys], "kb", "n.agent_id", F.col("e.poses").alias("mine"), F.col("n.poses").alias("theirs"))


def overlap_hits_in_blocks(rollout: DataFrame, obstacles: DataFrame, keys: Sequence[str], grow: float = 0.0) -> DataFrame:
    """The rows of ``overlap_hits`` by way of the broad phase: for fine steps and many candidates, where a candidate stays clear of most agents most of the time."""
    pairs = meeting_blocks(rollout, obstacles, keys, grow).withColumn("m", F.explode("mine"))
    steps = pairs.select(*keys, "agent_id", "m", F.explode(F.filter("theirs", lambda o: o["k"] == F.col("m.k"))).alias("o"))
    part = lambda s, p: [F.col(f"{s}.{c}").alias(f"{p}{c}") for c in ("x", "y", "heading", "length", "width")]
    flat = steps.select(*keys, "agent_id", "m.k", "m.t", *part("m", "_m"), *part("o", "_o"))
    flat = geo.with_box(flat, "e", *[f"_m{c}" for c in ("x", "y", "heading", "length", "width")], grow=grow)
    flat = geo.with_box(flat, "", *[f"_o{c}" for c in ("x", "y", "heading", "length", "width")])
    ego, other = geo.box("e"), geo.box("")
    dx, dy = other.x - ego.x, other.y - ego.y
    reach = geo.radius(ego) + geo.radius(other) + 1e-6
    hits = flat.filter(dx * dx + dy * dy <= reach * reach).filter(geo.obb_overlap(ego, other))
    return hits.groupBy(*keys, "k", "t").agg(F.min(F.struct("agent_id", F.sqrt(dx * dx + dy * dy).alias("distance"))).alias("first"))


def first_failure(rollout: DataFrame, obstacles: DataFrame, lanes: DataFrame | None, buffer: float, keys: Sequence[str]) -> DataFrame:
    """Earliest off-lane or overlap time per action; null means feasible."""
    acts = rollout.select(*keys, "comfort", "cost", "horizon_s").distinct()
    hits = overlap_hits(rollout, obstacles, keys).groupBy(*keys).agg(F.min("t").alias("collision_t"))
    out = acts.join(hits, list(keys), "left")
    if lanes is None:
        return out.withColumns({"lane_t": F.lit(None).cast("double"), "failure_time_s": F.col("collision_t")})
    off = on_lane(rollout, [*keys, "k", "t"], lanes, buffer).filter("not on_lane").groupBy(*keys).agg(F.min("t").alias("lane_t"))
    return out.join(off, list(keys), "left").withColumn("failure_time_s", F.least("collision_t", "lane_t"))


def actionability_labels(agents: DataFrame, states: DataFrame, lanes: DataFrame | None, horizon: float, dt: float, mode: str = "oracle_future",
                         rule: str = "original", library: str = "base7", lane_buffer: float = 3.0) -> DataFrame:
    """Rollout, first failure, summary and label in one plan."""
    spark = agents.sparkSession
    steps = int(math.floor(horizon / dt + 1e-6))
    roll = rollout_actions(ego_rows(agents), with_horizon(action_library(spark, library), horizon), dt)
    obs = obstacle_pose(agents, states, mode, steps, dt)
    res = first_failure(roll, obs, lanes, max(lane_buffer, 3.0), ["sample_id", "action"])
    return labels.with_actionability(labels.feasibility_summary(res, ["sample_id"], F.col("horizon_s")), rule)


def label_variants(agents: DataFrame, states: DataFrame, lanes: DataFrame, dt: float, variants: Sequence[Variant] = VARIANTS, rule: str = "moderate") -> DataFrame:
    """Labels for every design variant from shared parts.

    A rollout is made once per (horizon, library), overlaps once per future handling, lane distances once for all buffers; variants only combine
    these. All of it is done sample by sample (``checked``), so that poses are never shuffled.
    """
    from feaslens.operators import checked

    spark = agents.sparkSession
    acts = [(h, lib, *a) for h, lib in sorted({(v.horizon_s, v.action_library) for v in variants}) for a in LIBRARIES[lib]]
    steps = max(int(math.floor(v.horizon_s / dt + 1e-6)) for v in variants)
    modes = {"skip_invalid": "oracle_future", "cv_fallback": "cv_fallback"}
    handlings, buffers = sorted({v.future_handling for v in variants}), sorted({v.lane_buffer_m for v in variants})
    obs = [obstacle_pose(agents, states, modes[h], steps, dt) for h in handlings]
    t = np.arange(1, steps + 1) * dt
    each = np.arange(len(acts), dtype=np.int32)

    def summary(hits, gaps, has_lanes, made):
        off = [checked.first_time(made & has_lanes & (gaps > b), t) for b in buffers]
        return [pa.array(each), *[checked.number(v) for v in [*off, *[checked.first_time(agent >= 0, t) for agent, _ in hits]]]]

    names = [f"off{i}" for i in range(len(buffers))] + [f"hit{i}" for i in range(len(handlings))]
    found = checked.check_actions(agents, lanes, obs, [(a[5], a[6], a[0]) for a in acts], dt, max(buffers), f"act int, {', '.join(f'{c} double' for c in names)}", summary)
    table = spark.createDataFrame([(i, a[2], a[4], a[7], v.variant_id, v.family, v.horizon_s, v.lane_buffer_m, v.action_library, v.future_handling, buffers.index(v.lane_buffer_m), handlings.index(v.future_handling))
                                   for i, a in enumerate(acts) for v in variants if (v.horizon_s, v.action_library) == a[:2]],
                                  "act int, action string, cost double, comfort boolean, variant_id string, variant_family string, horizon_s double, lane_buffer_m double, library string, future_handling string, b int, f int")
    rows = found.join(F.broadcast(table), "act")  # actions x variants, some hundred rows
    pick = lambda c, n, i: F.get(F.array(*[F.col(f"{c}{j}") for j in range(n)]), F.col(i))
    res = rows.withColumn("failure_time_s", F.least(pick("off", len(buffers), "b"), pick("hit", len(handlings), "f")))
    by = ["sample_id", "variant_id", "variant_family", "horizon_s", "lane_buffer_m", "library", "future_handling"]
    return labels.with_actionability(labels.feasibility_summary(res, by, F.col("horizon_s")), rule)


def rollout_lattice(ego: DataFrame, candidates: DataFrame, horizon: float, dt: float) -> DataFrame:
    """Lattice candidates at steps 0 … n: pose, speed, acceleration, yaw rate, lateral acceleration, progress.

    Speed and distance of a clamped constant acceleration are closed forms, so no running sum is needed; only a heading that is
    kept while standing still and the differences of heading and speed look back, over the steps of one candidate.
    """
    n = max(1, int(round(horizon / max(dt, 1e-6))))
    info = [c for c in candidates.columns]
    base = ordered.spread(ego, "sample_id").crossJoin(F.broadcast(candidates)).select(  # 35 or 130 candidates
        "sample_id", *info, "length", "width", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("heading").alias("h0"), F.cos("heading").alias("c0"),
        F.sin("heading").alias("s0"), F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("v0"))
    # Steps of deceleration that end above standstill; the step after it ends at zero.
    full = F.when(F.col("accel") < 0, F.floor(F.col("v0") / (-F.col("accel") * dt) + 1e-12)).otherwise(F.lit(1 << 30)).cast("int")
    rows = base.withColumn("full", full).select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    a, v0 = F.col("accel"), F.col("v0")

    def run(k: Column) -> Column:
        t, tf = k * F.lit(dt), F.col("full") * F.lit(dt)
        moving = v0 * t + 0.5 * a * t * t
        stopped = v0 * tf + 0.5 * a * tf * tf + 0.5 * F.greatest(v0 + a * tf, F.lit(0.0)) * dt
        return F.when(k <= F.col("full"), moving).otherwise(stopped)

    lat = lambda k: F.col("lat_offset") * smoothstep(k * F.lit(dt) / F.greatest(F.col("lat_duration"), F.lit(1e-3)))
    k = F.col("k")
    rows = rows.withColumns({"run": run(k), "lat": lat(k), "run1": run(k - 1), "lat1": lat(k - 1)})
    ds, dl = F.col("run") - F.col("run1"), F.col("lat") - F.col("lat1")
    moved = F.sqrt(ds * ds + dl * dl)
    rows = rows.withColumns({
        "t": k * F.lit(dt), "x": F.col("x0") + F.col("run") * F.col("c0") - F.col("lat") * F.col("s0"), "y": F.col("y0") + F.col("run") * F.col("s0") + F.col("lat") * F.col("c0"),
        "_step_v": F.when(k > 0, moved / dt),
        "_dir": F.when((k > 0) & (moved > 1e-8), F.atan2(ds * F.col("s0") + dl * F.col("c0"), ds * F.col("c0") - dl * F.col("s0")))})
    w = Window.partitionBy("sample_id", "candidate_id").orderBy("k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_h": F.coalesce(F.last("_dir", ignorenulls=True).over(upto), F.col("h0")), "_next": F.lead("_dir").over(w), "_v1": F.lead("_step_v").over(w)})
    rows = rows.withColumns({"heading": F.when(k == 0, F.coalesce("_next", "h0")).otherwise(F.col("_h")), "speed": F.when(k == 0, F.col("_v1")).otherwise(F.col("_step_v"))})
    rows = rows.withColumns({"_ph": F.lag("heading").over(w), "_pv": F.lag("speed").over(w)})
    yaw = F.when(k == 0, 0.0).otherwise(wrap_to_pi(F.col("heading") - F.col("_ph")) / dt)
    acc = F.when(k == 0, 0.0).otherwise((F.col("speed") - F.col("_pv")) / dt)
    return rows.select("sample_id", *info, "k", "t", "x", "y", "heading", "speed", acc.alias("acceleration"), yaw.alias("yaw_rate"),
                       (F.col("speed") * yaw).alias("lateral_accel"), F.col("run").alias("progress"), "length", "width")


def kinematic_limits(p: PlannerParams) -> Column:
    """Command outside the limits of its family."""
    a, slack = F.col("accel"), 1e-9
    low = F.when(F.col("action_family") == "comfort", F.lit(p.max_comfort_decel)).otherwise(F.lit(p.max_emergency_decel))
    return (a > p.max_comfort_accel + slack) | (a < low - slack)


def kinematic_violation(rollout: DataFrame, p: PlannerParams, keys: Sequence[str] = ("sample_id", "candidate_id")) -> DataFrame:
    """Command limit (fails at time 0) or yaw rate / lateral acceleration limit (sets the flag without a time)."""
    bad = (F.abs("yaw_rate") > MAX_YAW_RATE) | (F.abs("lateral_accel") > MAX_LATERAL_ACCEL)
    agg = rollout.groupBy(*keys).agg(
        F.max(kinematic_limits(p)).alias("command_violation"), F.max(bad).alias("motion_violation"), F.max(F.abs("acceleration")).alias("max_abs_accel_mps2"),
        F.max(F.abs("yaw_rate")).alias("max_abs_yaw_rate_rad_s"), F.max(F.abs("lateral_accel")).alias("max_lateral_accel_mps2"),
        F.max_by("progress", "k").alias("progress_m"))
    return agg.withColumns({"kinematic_flag": F.col("command_violation") | F.col("motion_violation"), "kinematic_t": F.when(F.col("command_violation"), F.lit(0.0))})


def evaluate_candidates(rollout: DataFrame, obstacles: DataFrame, lanes: DataFrame | None, p: PlannerParams = PlannerParams(), trajectory: bool = False) -> DataFrame:
    """One row per candidate: flags, first failure, reason, blocking agent and motion extremes.

    Only the first overlapping agent of a step counts. Overlaps in the initial grace period are counted, not failed. The lane test runs
    in the grace period too.
    """
    keys = ["sample_id", "candidate_id"]
    info = ["longitudinal_profile", "lateral_profile", "action_family", "action_cost"]
    motion = kinematic_violation(rollout, p)
    facts = rollout.groupBy(*keys, *info).agg(F.max("t").alias("last_t"))
    # Steps that fit one block have no blocks to rule out.
    overlaps = overlap_hits if p.steps < BLOCK_STEPS else overlap_hits_in_blocks
    hits = overlaps(rollout, obstacles, keys, grow=p.safety_buffer_m)
    early = F.col("t") < p.ignore_initial_s
    coll = hits.groupBy(*keys).agg(
        F.min(F.when(~early, F.struct("t", F.col("first.agent_id").alias("agent")))).alias("hit"),
        F.size(F.collect_set(F.when(early, F.col("first.agent_id")))).alias("initial_overlap_count"))
    out = facts.join(motion, keys).join(coll, keys, "left")
    if lanes is not None and p.use_lanes:
        off = on_lane(rollout.select(*keys, "k", "t", "x", "y"), [*keys, "k", "t"], lanes, p.lane_buffer_m).filter("not on_lane")
        out = out.join(off.groupBy(*keys).agg(F.min("t").alias("lane_t")), keys, "left")
    else:
        out = out.withColumn("lane_t", F.lit(None).cast("double"))
    c, lane = F.col("hit").isNotNull(), F.col("lane_t").isNotNull()
    slow = (F.col("progress_m") < p.min_progress_m) & (F.col("longitudinal_profile") != "hard_brake")
    kin = F.col("kinematic_flag")
    first = F.least(F.col("hit.t"), F.col("lane_t"), F.col("kinematic_t"), F.when(slow, F.col("last_t")))
    reason = F.when(c, "collision").when(lane, "lane_buffer").when(slow, "progress").when(kin, "kinematic").otherwise("no_failure")
    out = out.select(*keys, *info, (~(c | lane | slow | kin)).alias("feasible"), first.alias("first_failure_time_s"), reason.alias("failure_reason"),
                     c.alias("collision_flag"), lane.alias("lane_buffer_flag"), slow.alias("progress_flag"), kin.alias("kinematic_flag"),
                     F.col("hit.agent").alias("blocking_agent_id"), F.coalesce("initial_overlap_count", F.lit(0)).alias("initial_overlap_count"), "progress_m",
                     "max_abs_accel_mps2", "max_abs_yaw_rate_rad_s", "max_lateral_accel_mps2")
    if not trajectory:
        return out
    point = F.struct(F.col("t").alias("time_s"), "x", "y", "heading", "speed", "acceleration")
    paths = rollout.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("trajectory"))  # n + 1 points
    return out.join(paths, keys)


# Audit modes: name -> (obstacle mode, map used, initial part ignored).
AUDIT_SPECS = {
    "original_oracle_map": ("oracle_future", True, False), "oracle_map_ignore_initial": ("oracle_future", True, True),
    "oracle_no_map": ("oracle_future", False, False), "cv_current_map": ("cv_current", True, False), "cv_current_no_map": ("cv_current", False, False),
}
UNSAFE_REASONS = ("no_failure", "initial_overlap", "map_violation", "oracle_future_collision", "cv_current_collision")


def feasibility_audit(agents: DataFrame, states: DataFrame, lanes: DataFrame, horizon: float, dt: float, ignore_initial_s: float = 0.3, safety_buffer: float = 0.0,
                      lane_buffer: float = 3.0, modes: Sequence[str] = tuple(AUDIT_SPECS)) -> DataFrame:
    """Per action and audit mode: feasible, first unsafe time and reason, blocking agent, share of off-lane poses.

    Overlaps are found once per obstacle mode and lane tests once, sample by sample (``checked``); the five modes read these.
    """
    from feaslens.operators import checked

    spark = agents.sparkSession
    steps = int(math.floor(horizon / dt + 1e-6))
    keys = ["sample_id", "action"]
    acts = LIBRARIES["base7"]
    used = sorted({AUDIT_SPECS[x][0] for x in modes})
    obs = [None if m == "cv_current" else obstacle_pose(agents, states, m, steps, dt, start=0) for m in used]
    t = np.arange(0, steps + 1) * dt
    late = t[1:] > ignore_initial_s
    each, names = np.arange(len(acts)), pa.array([a[0] for a in acts])

    def event(agent, dist, k0, of):
        """Time, agent and distance of the first of the marked steps, which begin at step ``k0``."""
        hit = (agent[:, k0:] >= 0) & of
        at = hit.argmax(axis=1) + k0
        some = hit.any(axis=1)
        return [pa.array(t[at], mask=~some), pa.array(agent[each, at], mask=~some), pa.array(dist[each, at], mask=~some)]

    def summary(hits, gaps, has_lanes, made):
        bad = (gaps > lane_buffer) & has_lanes
        share = lambda of: bad[:, of].sum(axis=1) / of.sum() if of.any() else np.full(len(bad), math.nan)
        out = [checked.first_time(bad, t[1:]), checked.first_time(bad & late, t[1:]), share(late | True), share(late)]
        return [names, *[checked.number(v) for v in out],
                *[c for agent, dist in hits for c in (*event(agent[:, :1], dist[:, :1], 0, True), *event(agent, dist, 1, True), *event(agent, dist, 1, late))]]

    columns = [f"{e}{i}_{c} {kind}" for i in range(len(used)) for e in ("start", "any", "late") for c, kind in (("t", "double"), ("agent", "long"), ("distance", "double"))]
    found = checked.check_actions(agents, lanes, obs, [(a[3], a[4], horizon) for a in acts], dt, lane_buffer,
                                  f"action string, lane_t double, lane_late_t double, off_share double, off_late_share double, {', '.join(columns)}", summary, safety_buffer, start=True)
    table = spark.createDataFrame([(m, *AUDIT_SPECS[m], used.index(AUDIT_SPECS[m][0])) for m in modes], "checked_mode string, obstacle_mode string, use_map boolean, ignore boolean, m int")
    own = lambda e, i: F.when(F.col(f"{e}{i}_t").isNotNull(), F.struct(*[F.col(f"{e}{i}_{c}").alias(c) for c in ("t", "agent", "distance")]))
    rows = found.crossJoin(F.broadcast(table)).withColumns({n: F.get(F.array(*[own(e, i) for i in range(len(used))]), F.col("m")) for n, e in (("at_start", "start"), ("any", "any"), ("late", "late"))})
    none = F.lit(None).cast("double")
    lane_t = F.when(F.col("use_map"), F.when(F.col("ignore"), F.col("lane_late_t")).otherwise(F.col("lane_t"))).otherwise(none)
    hit = F.when(F.col("ignore"), F.col("late")).otherwise(F.col("any"))
    start_hit = F.when(~F.col("ignore"), F.col("at_start"))
    rows = rows.withColumns({"_lane": lane_t, "_hit": hit, "_start": start_hit})
    by_map = F.col("_lane").isNotNull() & (F.col("_hit").isNull() | (F.col("_lane") <= F.col("_hit.t")))
    reason = F.when(F.col("_start").isNotNull(), "initial_overlap").when(by_map, "map_violation").when(
        F.col("_hit").isNotNull(), F.concat(F.col("obstacle_mode"), F.lit("_collision"))).otherwise("no_failure")
    block = F.when(F.col("_start").isNotNull(), F.col("_start")).when(~by_map, F.col("_hit"))
    time = F.when(F.col("_start").isNotNull(), F.lit(0.0)).when(by_map, F.col("_lane")).otherwise(F.col("_hit.t"))
    return rows.select(*keys, "checked_mode", (reason == "no_failure").alias("feasible"), time.alias("first_unsafe_time_s"), reason.alias("unsafe_reason_primary"),
                       block["agent"].alias("blocking_agent_id"), block["distance"].alias("blocking_agent_distance_m"),
                       F.when(F.col("use_map"), F.when(F.col("ignore"), F.coalesce("off_late_share", F.lit(0.0))).otherwise(F.coalesce("off_share", F.lit(0.0)))).otherwise(
                           0.0).alias("map_violation_fraction"))
