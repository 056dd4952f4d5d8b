"""Distances and times to contact between the ego and the other agents of a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo


def _pairs(agents: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Ego columns with prefix ``e``, one row per other agent. Agent order breaks ties."""
    rows = geo.with_box(agents)
    cols = ["vx", "vy", *geo.BOX_FIELDS, *extra]
    ego = rows.filter("is_ego").select("sample_id", *[F.col(c).alias(f"e{c}") for c in cols])
    return rows.filter("not is_ego").select("sample_id", "agent_id", *cols).join(ego, "sample_id")


def _no_agents(agents: DataFrame) -> DataFrame:
    return agents.filter("is_ego").select("sample_id")


def current_proximity(agents: DataFrame, finalize: bool = True) -> DataFrame:
    """Smallest gap, collision, point-model time to collision, speeds relative to the nearest agent, neighbour counts."""
    p = _pairs(agents)
    a, b = geo.box("e"), geo.box("")
    dx, dy, rvx, rvy = b.x - a.x, b.y - a.y, F.col("vx") - F.col("evx"), F.col("vy") - F.col("evy")
    dot, vv = dx * rvx + dy * rvy, rvx * rvx + rvy * rvy
    center = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
    closing = F.greatest(-dot / center, F.lit(0.0))
    meets = (vv > 1e-6) & (dot < 0)
    rows = p.select("sample_id", "agent_id", geo.obb_distance(a, b).alias("d"), F.when(meets, -dot / F.nullif(vv, F.lit(0.0))).alias("ttc"),
                    closing.alias("closing"), F.sqrt(vv).alias("rel"))
    near = F.min(F.struct("d", "agent_id", "rel", "closing"))
    soon = F.min(F.when(F.col("ttc").isNotNull(), F.struct("ttc", "agent_id", "closing")))
    agg = rows.groupBy("sample_id").agg(
        near.alias("n"), soon.alias("s"), F.sum((F.col("d") <= 10).cast("bigint")).alias("c10"), F.sum((F.col("d") <= 20).cast("bigint")).alias("c20"))
    full = _no_agents(agents).join(agg, "sample_id", "left")
    sent = (lambda c, v: F.coalesce(c, F.lit(v))) if finalize else (lambda c, v: c)
    return full.select(
        "sample_id", sent(F.col("n.d"), 9999.0).alias("current_min_distance_m"), F.coalesce(F.col("n.d") == 0, F.lit(False)).alias("current_collision"),
        sent(F.col("s.ttc"), -1.0).alias("current_ttc_s"), F.col("n.agent_id").alias("nearest_agent_id"),
        F.coalesce(F.col("n.rel"), F.lit(0.0)).alias("nearest_agent_rel_speed_mps"), F.coalesce(F.col("n.closing"), F.lit(0.0)).alias("nearest_agent_closing_speed_mps"),
        F.coalesce(F.col("s.closing"), F.lit(0.0)).alias("ttc_closing_speed_mps"), F.coalesce(F.col("c10"), F.lit(0)).alias("nearby_agent_count_10m"),
        F.coalesce(F.col("c20"), F.lit(0)).alias("nearby_agent_count_20m"))


def current_kinematics(agents: DataFrame, lanes: DataFrame | None = None, horizon: float = 3.0, dt: float = 0.1, half_width: float = 1.75) -> DataFrame:
    """Headway, closing and lateral speeds, clearance, constant-velocity separation and overlap, lane margin.

    Circles around the boxes stand for footprints. Works on current states only.
    """
    p = _pairs(agents, ("heading",))
    steps = max(1, round(horizon / max(dt, 1e-6)))
    step = horizon / steps
    speed = F.sqrt(F.col("evx") * F.col("evx") + F.col("evy") * F.col("evy"))
    moving = speed > 1e-3
    hx = F.when(moving, F.col("evx") / F.nullif(speed, F.lit(0.0))).otherwise(F.col("ebc"))
    hy = F.when(moving, F.col("evy") / F.nullif(speed, F.lit(0.0))).otherwise(F.col("ebs"))
    base = p.select("sample_id", "agent_id", (F.col("bx") - F.col("ebx")).alias("rx"), (F.col("by") - F.col("eby")).alias("ry"),
                    (F.col("vx") - F.col("evx")).alias("rvx"), (F.col("vy") - F.col("evy")).alias("rvy"), hx.alias("hx"), hy.alias("hy"),
                    (geo.radius(geo.box("e")) + geo.radius(geo.box(""))).alias("rad"))
    center = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    lon, lat = F.col("rx") * F.col("hx") + F.col("ry") * F.col("hy"), F.col("ry") * F.col("hx") - F.col("rx") * F.col("hy")
    lat_v, lon_v = F.col("rvy") * F.col("hx") - F.col("rvx") * F.col("hy"), F.col("rvx") * F.col("hx") + F.col("rvy") * F.col("hy")
    radial = F.when(center > 1e-6, (F.col("rvx") * F.col("rx") + F.col("rvy") * F.col("ry")) / F.nullif(center, F.lit(0.0))).otherwise(lon_v)
    zero = F.lit(0.0)
    facts = base.withColumns({
        "gap": F.greatest(center - F.col("rad"), zero), "n_closing": F.greatest(-radial, zero), "n_lat": F.abs(lat_v),
        "n_clear": F.greatest(F.abs(lat) - F.col("rad"), zero), "ahead": lon - F.col("rad"), "h_closing": F.greatest(-lon_v, zero),
        "gated": (lon - F.col("rad") > 0) & (F.abs(lat) <= F.greatest(F.lit(3.5), F.col("rad")))})
    # Forecast terms of a pair over the time grid, folded without leaving the row.
    grid = F.sequence(F.lit(0), F.lit(steps))
    sep = lambda k: (F.sqrt((F.col("rx") + F.col("rvx") * k * step) * (F.col("rx") + F.col("rvx") * k * step)
                            + (F.col("ry") + F.col("rvy") * k * step) * (F.col("ry") + F.col("rvy") * k * step)) - F.col("rad"))
    facts = facts.withColumn("seps", F.transform(grid, sep))
    reach = F.greatest(F.col("rad") + 1.0, F.lit(1.0))
    facts = facts.withColumns({
        "min_sep": F.array_min("seps"),
        "hit_k": F.array_position(F.transform("seps", lambda s: s <= 0), True),
        "overlap": F.aggregate("seps", F.lit(0.0), lambda acc, s: acc + F.least(F.greatest(1.0 - s / reach, F.lit(0.0)), F.lit(1.0))) * step})
    near = F.min(F.struct("gap", "agent_id", "n_closing", "n_lat", "n_clear"))
    head = F.min(F.when(F.col("gated"), F.struct("ahead", "agent_id", "h_closing", "n_lat")))
    agg = facts.groupBy("sample_id").agg(near.alias("n"), head.alias("h"), F.min("min_sep").alias("min_sep"),
                                         F.min(F.when(F.col("hit_k") > 0, (F.col("hit_k") - 1) * step)).alias("hit"), F.sum("overlap").alias("overlap"))
    ego = agents.filter("is_ego").select("sample_id", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("ego_speed_mps_current"),
                                         F.col("x").alias("_ex"), F.col("y").alias("_ey"))
    out = ego.join(agg, "sample_id", "left")
    if lanes is not None:
        d2 = (F.col("x") - F.col("_ex")) * (F.col("x") - F.col("_ex")) + (F.col("y") - F.col("_ey")) * (F.col("y") - F.col("_ey"))
        margin = lanes.join(ego, "sample_id").groupBy("sample_id").agg((half_width - F.sqrt(F.min(d2))).alias("road_margin_m"))
        out = out.join(margin, "sample_id", "left")
    else:
        out = out.withColumn("road_margin_m", F.lit(None).cast("double"))
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return out.select(
        "sample_id", "ego_speed_mps_current", F.col("n.gap").alias("current_state_min_distance_m"), pick("h.ahead", "n.gap").alias("headway_m"),
        pick("h.h_closing", "n.n_closing").alias("nearest_agent_closing_speed_mps"), pick("h.n_lat", "n.n_lat").alias("nearest_agent_lateral_speed_mps"),
        F.col("n.n_clear").alias("current_lateral_clearance_m"), F.col("min_sep").alias("cv_min_predicted_separation_3s_m"),
        F.col("hit").alias("cv_min_collision_time_3s_s"), F.coalesce(F.col("overlap"), F.lit(0.0)).alias("cv_occupancy_overlap_integral_3s"), "road_margin_m",
        F.when(F.col("road_margin_m").isNull(), "map_lane_centerlines unavailable").otherwise("").alias("road_margin_unavailable_reason"))


def future_min_distance(states: DataFrame, horizon: float | None = None) -> DataFrame:
    """Smallest future gap over steps where both ego and agent are valid; first agent, then first step, wins a tie."""
    rows = geo.with_box(states.filter("valid and k >= 1"))
    if horizon is not None:
        rows = rows.filter(F.col("t_s") <= horizon + 1e-9)
    ego = rows.filter("is_ego").select("sample_id", "k", *[F.col(c).alias(f"e{c}") for c in geo.BOX_FIELDS])
    pairs = rows.filter("not is_ego").select("sample_id", "k", "agent_id", "t_s", *geo.BOX_FIELDS).join(ego, ["sample_id", "k"])
    d = geo.obb_distance(geo.box("e"), geo.box(""))
    best = F.min(F.struct(d.alias("d"), "agent_id", "k", "t_s"))
    agg = pairs.groupBy("sample_id").agg(best.alias("b"))
    return states.filter("is_ego").select("sample_id").distinct().join(agg, "sample_id", "left").select(
        "sample_id", F.col("b.d").alias("d_min"), F.col("b.t_s").alias("t_at_dmin"), F.coalesce(F.col("b.d") == 0, F.lit(False)).alias("collision_any"),
        F.col("b.agent_id").alias("conflict_track_id"))
