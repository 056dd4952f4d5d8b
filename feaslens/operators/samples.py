"""Ego-centric samples out of track tables.

Tables: ``tracks(scenario_id, track_id, object_type, is_ego, step, t_s, valid, x, y, vx, vy, heading, length, width)`` and
``map_lanes(scenario_id, lane_id, seq, x, y)``. Everything joins on (scenario, step), so a scenario with very many
steps is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo
from feaslens.functions.columns import to_local, to_local_vector, unit_hash, wrap_to_pi

# Object type codes.
OBJECT_TYPES = {1: "vehicle", 2: "pedestrian", 3: "cyclist"}


@dataclass(frozen=True)
class Roi:
    x_min: float = -20.0
    x_max: float = 60.0
    y_min: float = -30.0
    y_max: float = 30.0


def object_type_name(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    out = F.lit("other")
    for k, v in OBJECT_TYPES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def in_roi(x: Column | str, y: Column | str, roi: Roi, pad: float = 0.0) -> Column:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return x.between(roi.x_min - pad, roi.x_max + pad) & y.between(roi.y_min - pad, roi.y_max + pad)


def _ego_frames(tracks: DataFrame, steps: DataFrame) -> DataFrame:
    """Ego pose at each requested (scenario, step)."""
    ego = tracks.filter("is_ego").select("scenario_id", "step", F.col("track_id").alias("ego_id"), F.col("object_type").alias("ego_type"),
                                         F.col("valid").alias("ego_valid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("heading").alias("oh"))
    return steps.select("scenario_id", "step").join(ego, ["scenario_id", "step"], "left")


def screen_scenarios(tracks: DataFrame, steps: DataFrame, roi: Roi, future_steps: int, min_count: int) -> DataFrame:
    """Keep flag and first failing reason per requested (scenario, step)."""
    last = tracks.filter("is_ego").groupBy("scenario_id").agg(F.max("step").alias("last_step"), F.first("object_type").alias("type_of_ego"))
    frames = _ego_frames(tracks, steps)
    others = tracks.filter("valid and object_type = 'vehicle'").select("scenario_id", "step", "x", "y")
    joined = frames.join(others, ["scenario_id", "step"], "left")
    lx, ly = to_local("x", "y", "ox", "oy", "oh")
    counts = joined.groupBy("scenario_id", "step").agg(
        F.max("ego_id").alias("ego_track_id"), F.max("ego_valid").alias("ego_valid"),
        F.coalesce(F.sum(in_roi(lx, ly, roi).cast("bigint")), F.lit(0)).alias("vehicle_count_roi"))
    out = counts.join(last, "scenario_id", "left")
    reason = F.when(F.col("type_of_ego").isNull(), "bad_sdc_track_index").when(F.col("type_of_ego") != "vehicle", "ego_not_vehicle").when(
        ~F.coalesce(F.col("ego_valid"), F.lit(False)), "ego_current_invalid").when(
        F.col("step") + future_steps > F.col("last_step"), "future_too_short").when(
        F.col("vehicle_count_roi") < min_count, "too_few_vehicles_in_roi").otherwise("ok")
    reached = reason.isin("too_few_vehicles_in_roi", "ok")
    return out.select("scenario_id", "step", (reason == "ok").alias("keep"), reason.alias("reason"),
                      F.when(reached, F.col("vehicle_count_roi")).otherwise(0).cast("bigint").alias("vehicle_count_roi"),
                      F.when(reached, F.col("ego_track_id")).otherwise(F.lit(-1)).alias("ego_track_id"), reached.alias("has_future"))


def build_samples(tracks: DataFrame, steps: DataFrame, roi: Roi, future_steps: int, min_count: int = 1,
                  object_types: Sequence[str] = ("vehicle",)) -> tuple[DataFrame, DataFrame]:
    """Agents valid at the step and inside the region (ego always), and their states over the next steps, in ego frame.

    The future window is an equality join: every agent row is expanded to the steps it needs.
    """
    frames = _ego_frames(tracks, steps).filter("ego_valid and ego_type = 'vehicle'")
    last = tracks.filter("is_ego").groupBy("scenario_id").agg(F.max("step").alias("last_step"))
    frames = frames.join(last, "scenario_id").filter(F.col("step") + future_steps <= F.col("last_step")).drop("last_step", "ego_type", "ego_valid")
    now = tracks.filter(F.col("valid") & F.col("object_type").isin(*object_types))
    joined = now.join(frames, ["scenario_id", "step"])
    lx, ly = to_local("x", "y", "ox", "oy", "oh")
    lvx, lvy = to_local_vector("vx", "vy", "oh")
    sid = F.concat_ws("_", F.col("scenario_id"), F.lpad(F.col("step").cast("string"), 4, "0"))
    local = joined.select(
        sid.alias("sample_id"), "scenario_id", F.col("step").alias("base_step"), "ego_id", F.col("track_id").alias("agent_id"), F.col("object_type").alias("agent_type"),
        (F.col("track_id") == F.col("ego_id")).alias("is_ego"), lx.alias("x"), ly.alias("y"), lvx.alias("vx"), lvy.alias("vy"),
        wrap_to_pi(F.col("heading") - F.col("oh")).alias("heading"), "length", "width", "ox", "oy", "oh", F.col("t_s").alias("base_t"))
    local = local.filter(F.col("is_ego") | in_roi("x", "y", roi))
    enough = local.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("is_ego").alias("has_ego")).filter(
        (F.col("n") >= min_count) & F.col("has_ego")).select("sample_id")
    local = local.join(enough, "sample_id", "left_semi")
    agents = local.select("sample_id", "scenario_id", "base_step", "agent_id", "agent_type", "is_ego", "x", "y", "vx", "vy", "heading", "length", "width")
    asks = local.select("sample_id", "scenario_id", "agent_id", "is_ego", "base_step", "base_t", "ox", "oy", "oh", "length", "width",
                        F.explode(F.sequence(F.lit(0), F.lit(future_steps))).alias("k"))
    asks = asks.withColumn("step", F.col("base_step") + F.col("k"))
    future = tracks.select("scenario_id", F.col("track_id").alias("agent_id"), "step", "t_s", "valid", "x", "y", "vx", "vy", "heading")
    rows = asks.join(future, ["scenario_id", "agent_id", "step"], "left")
    fx, fy = to_local("x", "y", "ox", "oy", "oh")
    gvx, gvy = to_local_vector("vx", "vy", "oh")
    ok = F.coalesce(F.col("valid"), F.lit(False))
    states = rows.select("sample_id", "agent_id", "is_ego", "k", (F.col("t_s") - F.col("base_t")).alias("t_s"), F.when(ok, fx).alias("x"), F.when(ok, fy).alias("y"),
                         F.when(ok, gvx).alias("vx"), F.when(ok, gvy).alias("vy"), F.when(ok, wrap_to_pi(F.col("heading") - F.col("oh"))).alias("heading"),
                         ok.alias("valid"), "length", "width")
    return agents, states


def lanes_near(samples: DataFrame, map_lanes: DataFrame, roi: Roi, pad: float = 10.0) -> DataFrame:
    """Whole lanes that have a vertex inside the padded region, in ego frame. ``samples`` has sample, scenario and ego pose.

    Lane vertices that come out of an ``explode`` are estimated at the size of what went in, so the join is told not to broadcast them.
    """
    lx, ly = to_local("x", "y", "ox", "oy", "oh")
    rows = samples.join(map_lanes.hint("merge"), "scenario_id").select("sample_id", F.col("lane_id").alias("lane_ix"), "seq", lx.alias("x"), ly.alias("y"))
    hit = rows.groupBy("sample_id", "lane_ix").agg(F.max(in_roi("x", "y", roi, pad)).alias("hit"), F.count("*").alias("n")).filter(
        F.col("hit") & (F.col("n") >= 2)).select("sample_id", "lane_ix")
    return rows.join(hit, ["sample_id", "lane_ix"], "left_semi")


def ego_poses(tracks: DataFrame, steps: DataFrame) -> DataFrame:
    """Sample id and ego pose per requested step, the input of ``lanes_near``."""
    frames = _ego_frames(tracks, steps).filter("ego_valid")
    sid = F.concat_ws("_", F.col("scenario_id"), F.lpad(F.col("step").cast("string"), 4, "0"))
    return frames.select(sid.alias("sample_id"), "scenario_id", "ox", "oy", "oh")


def rolling_steps(scenarios: DataFrame, stride: int, start: int, end: int | None, future_steps: int, n_steps: str = "n_steps") -> DataFrame:
    """Sample steps ``start, start + stride, …`` up to the last step that has a whole future (or ``end``)."""
    last = F.col(n_steps) - 1 - future_steps
    last = F.least(last, F.lit(end)) if end is not None else last
    return scenarios.withColumn("_last", last.cast("int")).filter(F.col("_last") >= start).select(
        "*", F.explode(F.sequence(F.lit(start), F.col("_last"), F.lit(stride))).alias("step")).drop("_last")


def rolling_offsets(scenarios: DataFrame, offsets: Sequence[int], future_steps: int, base: str = "base_step", n_steps: str = "n_steps") -> DataFrame:
    """Sample steps at fixed offsets around the base step that exist and have a whole future."""
    step = F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o")
    rows = scenarios.select("*", step).withColumn("step", F.col(base) + F.col("_o"))
    return rows.filter((F.col("step") >= 0) & (F.col("step") + future_steps < F.col(n_steps))).drop("_o")


def discover_egos(tracks: DataFrame, stride: int, min_speed: float, min_neighbors: int, types: Sequence[str] = ("vehicle",)) -> DataFrame:
    """Every vehicle at every strided step as ego: neighbours, smallest gap, gap-based time to collision and bucket.

    Pairs exist only inside one (scenario, step) and are reduced by minima as they are formed. Egos are filtered and
    steps without enough agents dropped before the pair join.
    """
    now = geo.with_box(tracks.filter("valid"), "")
    counts = now.groupBy("scenario_id", "step").agg(F.count("*").alias("agent_count")).filter(F.col("agent_count") >= min_neighbors + 1)
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    egos = now.filter(F.col("object_type").isin(*types) & (F.col("step") % stride == 0) & (speed >= min_speed)).join(
        counts, ["scenario_id", "step"]).select("scenario_id", "step", F.col("track_id").alias("ego_id"), speed.alias("ego_speed_mps"), "agent_count",
                                                F.col("vx").alias("evx"), F.col("vy").alias("evy"), *[F.col(f).alias(f"e{f}") for f in geo.BOX_FIELDS])
    others = now.filter(F.col("step") % stride == 0).select("scenario_id", "step", "track_id", "vx", "vy", *geo.BOX_FIELDS)
    pairs = egos.join(others, ["scenario_id", "step"]).filter(F.col("track_id") != F.col("ego_id"))
    a, b = geo.box("e"), geo.box("")
    dx, dy = b.x - a.x, b.y - a.y
    center = F.sqrt(dx * dx + dy * dy)
    closing = -(dx * (F.col("vx") - F.col("evx")) + dy * (F.col("vy") - F.col("evy"))) / F.nullif(center, F.lit(0.0))
    gap = F.greatest(center - geo.radius(a) - geo.radius(b), F.lit(0.0))
    ttc = F.when((center > 1e-6) & (closing > 1e-6), gap / closing)
    out = pairs.groupBy("scenario_id", "ego_id", "step").agg(
        F.max("agent_count").alias("agent_count"), F.max("ego_speed_mps").alias("ego_speed_mps"), F.min(geo.obb_distance(a, b)).alias("current_min_distance_m"),
        F.coalesce(F.min(ttc), F.lit(-1.0)).alias("current_ttc_s"))
    d = F.col("current_min_distance_m")
    bucket = F.when(d < 3.0, "close_interaction").when(d < 10.0, "medium_interaction").when(
        F.col("agent_count") - 1 >= 5, "far_but_interactive").otherwise("random_fill")
    return out.withColumn("bucket", bucket)


def fill_future_cv(states: DataFrame, agents: DataFrame, dt: float, ego_only: bool = True) -> DataFrame:
    """Missing states become constant-velocity positions from the current state (of the ego, or of every agent)."""
    cur = agents.select("sample_id", "agent_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("vx").alias("vx0"), F.col("vy").alias("vy0"),
                        F.col("heading").alias("h0"))
    rows = states.join(cur, ["sample_id", "agent_id"])
    may = F.col("is_ego") if ego_only else F.lit(True)
    use = ~F.col("valid") & may
    t = F.col("k") * dt
    pick = lambda c, v: F.when(use, v).otherwise(F.col(c)).alias(c)
    return rows.select("sample_id", "agent_id", "is_ego", "k", "t_s", pick("x", F.col("x0") + F.col("vx0") * t), pick("y", F.col("y0") + F.col("vy0") * t),
                       pick("vx", F.col("vx0")), pick("vy", F.col("vy0")), pick("heading", F.col("h0")), (F.col("valid") | use).alias("valid"),
                       use.alias("cv_used"), "length", "width")


def perturb(agents: DataFrame, kind: str, level: float, seed: int) -> DataFrame:
    """Noise on position, heading or velocity of the other agents, or dropping them with probability ``level``.

    Normal numbers come from hashes of the agent's keys (Box–Muller), so the result does not depend on partitioning.
    """
    def u(tag: str) -> Column:
        return unit_hash(F.lit(f"{seed}|{kind}|{tag}"), F.col("sample_id"), F.col("agent_id").cast("string"))

    def normal(tag: str) -> Column:
        return F.sqrt(-2.0 * F.log(F.greatest(u(f"{tag}a"), F.lit(1e-300)))) * F.cos(2.0 * math.pi * u(f"{tag}b"))
    other = ~F.col("is_ego")
    add = lambda c, tag: F.when(other, F.col(c) + level * normal(tag)).otherwise(F.col(c))
    if kind == "position":
        return agents.withColumns({"x": add("x", "x"), "y": add("y", "y")})
    if kind == "heading":
        return agents.withColumn("heading", F.when(other, wrap_to_pi(F.col("heading") + level * normal("h"))).otherwise(F.col("heading")))
    if kind == "velocity":
        return agents.withColumns({"vx": add("vx", "vx"), "vy": add("vy", "vy")})
    if kind == "dropout":
        return agents.filter(F.col("is_ego") | (u("drop") >= level))
    raise ValueError(f"unknown perturbation {kind!r}")
