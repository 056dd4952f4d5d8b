"""Feasible-action curves: safety per primitive and step, survival, depletion, collapse, classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo
from feaslens.operators import actions as ac
from feaslens.operators import ordered

# Primitive families, and command limits that tell them apart.
FAMILIES = ("keep", "accelerate", "brake", "hard_brake", "left", "right", "brake_left", "brake_right", "unknown")
STEER_MIN, BRAKE_ON, BRAKE_HARD = 0.05, 0.05, 0.6


def primitive_family(delta: Column, throttle: Column, brake: Column) -> Column:
    straight, braking = F.abs(delta) <= STEER_MIN, brake > BRAKE_ON
    side = F.when(delta > 0, "left").otherwise("right")
    return F.when(straight & braking, F.when(brake >= BRAKE_HARD, "hard_brake").otherwise("brake")).when(
        straight, F.when(throttle > 0.05, "accelerate").otherwise("keep")).when(braking, F.concat(F.lit("brake_"), side)).otherwise(side)


def primitive_cost(delta: Column, throttle: Column, brake: Column, max_steer: float = 0.35, max_throttle: float = 1.0, max_brake: float = 1.0) -> Column:
    """Half for steering, the rest for braking and throttle, each relative to its largest command."""
    rel = lambda x, top: F.abs(x) / max(top, 1e-6)
    return 0.50 * rel(delta, max_steer) + 0.35 * rel(brake, max_brake) + 0.15 * rel(throttle, max_throttle)


def align_times(primitives: DataFrame, times: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Each query time takes the primitive point nearest in time; the earlier point wins a tie."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(t)).alias("t")) for i, t in enumerate(times)])).alias("_q")
    rows = primitives.select("*", grid)
    fields = [c for c in primitives.columns if c not in keys]
    best = F.min_by(F.struct(*fields), F.struct(F.abs(F.col("t_s") - F.col("_q.t")), F.col("t_s")))
    return rows.groupBy(*keys, F.col("_q.k").alias("k"), F.col("_q.t").alias("t")).agg(best.alias("_b")).select(
        *keys, "k", "t", *[F.col(f"_b.{c}").alias(f"src_{c}" if c in ("k", "t_s") else c) for c in fields])


def thin(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """At most ``n`` primitives per key at evenly spaced positions (half-even rounded).

    A primitive library is a small table per key, so a window per key is bounded.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(order)) - 1, "_m": F.count("*").over(w)})
    if n <= 1:
        return rows.filter("_r = 0").drop("_r", "_m")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / float(n - 1)).cast("bigint"))
    return rows.filter((F.col("_m") <= n) | F.array_contains(wanted, F.col("_r").cast("bigint"))).drop("_r", "_m")


def stability_filter(traj: DataFrame, keys: Sequence[str], vehicle: dict[str, float], mu: float, etas: dict[str, float] | None = None) -> DataFrame:
    """Side slip, yaw rate, load transfer, longitudinal acceleration and linear stability over a trajectory, with reasons."""
    e = {"beta": 0.95, "r": 0.95, "ltr": 0.95, "ax": 0.95, "eps_v": 0.5, "ltr_max": 0.95, **(etas or {})}
    g = 9.81
    v = F.greatest(F.col("v_mps"), F.lit(e["eps_v"]))
    s1 = F.abs("beta_rad") < e["beta"] * math.atan(mu)
    s4 = F.abs("ax") <= e["ax"] * mu * g
    s2 = F.abs("r_rps") < e["r"] * mu * g / v
    loads = ("Fz_L1", "Fz_L2", "Fz_R1", "Fz_R2")
    if all(c in traj.columns for c in loads):
        left, right = F.col("Fz_L1") + F.col("Fz_L2"), F.col("Fz_R1") + F.col("Fz_R2")
        s3 = F.abs((left - right) / F.greatest(left + right, F.lit(1e-3))) < e["ltr_max"]
    else:
        s3 = F.abs(vehicle.get("h_cg_m", 0.55) * F.col("ay")) < 0.5 * vehicle.get("track_m", 1.55) * g * e["ltr"]
    cf, cr = mu * vehicle["Cf0_Nprad_front"], mu * vehicle["Cr0_Nprad_rear"]
    m, iz, a, b = vehicle["m_kg"], vehicle["Iz_kgm2"], vehicle["lf_m"], vehicle["lr_m"]
    a11, a22 = -(cf + cr) / (m * v), -(a * a * cf + b * b * cr) / (iz * v)
    a12, a21 = -1.0 - (a * cf - b * cr) / (m * v * v + 1e-9), -(a * cf - b * cr) / iz
    s5 = (a11 + a22 < 0) & (a11 * a22 - a12 * a21 > 0)
    names = {"S1_beta": s1, "S2_r": s2, "S3_ltr": s3, "S4_ax": s4, "S5_spec": s5}
    out = traj.groupBy(*keys).agg(*[F.bool_and(c).alias(n) for n, c in names.items()], F.avg((s1 & s2 & s3 & s4 & s5).cast("double")).alias("ok_fraction"))
    every = F.col("S1_beta")
    for n in list(names)[1:]:
        every = every & F.col(n)
    return out.withColumn("ok", every)


def cumulative_safe(df: DataFrame, keys: Sequence[str], order: str = "k", safe: str = "safe", out: str = "safe_cum") -> DataFrame:
    """Safe in this and every earlier step: up to the first unsafe step.

    The first unsafe step is a minimum over the few steps of a key. As a window it needs no second copy of the rows and no join, and rows that
    are already partitioned by one of the keys stay where they are.
    """
    bad = F.min(F.when(~F.col(safe), F.col(order))).over(Window.partitionBy(*keys))
    return df.withColumn("_bad", bad).withColumn(out, F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def survival_curves(df: DataFrame, keys: Sequence[str] = ("sample_id",), weight: str = "weight") -> DataFrame:
    """Weighted share of safe primitives per step: at the step (``slice``) and so far (``cum``)."""
    w = F.when((F.col(weight) > 0) & F.col(weight).isNotNull(), F.col(weight)).otherwise(1.0)
    share = lambda c: F.sum(F.when(F.col(c), w).otherwise(0.0)) / F.greatest(F.sum(w), F.lit(1e-9))
    return df.groupBy(*keys, "k", "t").agg(share("safe").alias("slice"), share("safe_cum").alias("cum"), F.count("*").alias("n_primitives"))


def curve_points(curves: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """The curve of a key as one sorted array (K points)."""
    return curves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "cum", "slice"))).alias("curve"))


def curve_columns(curves: DataFrame, keys: Sequence[str], times: Sequence[float]) -> DataFrame:
    """Wide names ``asr_cum_t0p5s`` / ``asr_slice_t0p5s`` for the given times."""
    name = lambda t: str(round(float(t), 1)).replace(".", "p")
    at = lambda t, c: F.max(F.when(F.abs(F.col("t") - t) < 1e-6, F.col(c)))
    return curves.groupBy(*keys).agg(*[at(t, c).alias(f"asr_{c}_t{name(t)}s") for c in ("cum", "slice") for t in times])


def depletion_times(curves: DataFrame, keys: Sequence[str] = ("sample_id",), depletion: float = 0.05, conflict: float = 0.999, early_s: float = 0.5) -> DataFrame:
    """Ends of the curves, time to depletion and first conflict, early blocking.

    Without depletion the time is the last one plus the median step; steps of one key are few, so its exact median is a plain aggregate.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    rows = curves.withColumn("_dt", F.col("t") - F.lag("t").over(w))
    agg = rows.groupBy(*keys).agg(
        F.min_by("cum", "t").alias("asr_cum_initial"), F.max_by("cum", "t").alias("asr_cum_final"), F.min("cum").alias("asr_cum_min"),
        F.min_by("slice", "t").alias("asr_slice_initial"), F.max_by("slice", "t").alias("asr_slice_final"), F.min("slice").alias("asr_slice_min"),
        F.min(F.when(F.col("cum") <= depletion, F.col("t"))).alias("_dep"), F.min(F.when(F.col("slice") < conflict, F.col("t"))).alias("_conf"),
        F.max("t").alias("_last"), F.percentile("_dt", 0.5).alias("_med"), F.avg(F.when(F.col("t") <= early_s, F.col("cum"))).alias("_early"))
    ttad = F.coalesce("_dep", F.col("_last") + F.coalesce("_med", F.lit(0.1)))
    return agg.withColumns({"ttad_s": ttad}).withColumns({
        "time_to_first_conflict_s": F.coalesce("_conf", "ttad_s"), "early_blocking_ratio": 1.0 - F.coalesce("_early", "asr_cum_initial"),
    }).drop("_dep", "_conf", "_last", "_med", "_early")


def collapse_rates(curves: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Largest and mean loss of the cumulative curve per second."""
    w = Window.partitionBy(*keys).orderBy("t")
    drop = (F.lag("cum").over(w) - F.col("cum")) / F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-9))
    rows = curves.withColumn("_drop", F.greatest(drop, F.lit(0.0)))
    span = F.greatest(F.max("t") - F.min("t"), F.lit(1e-9))
    fall = F.greatest(F.min_by("cum", "t") - F.max_by("cum", "t"), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.coalesce(F.max("_drop"), F.lit(0.0)).alias("collapse_rate_max_per_s"),
                                   F.when(F.count("*") > 1, fall / span).otherwise(0.0).alias("collapse_rate_mean_per_s"))


def survival_by_class(df: DataFrame, keys: Sequence[str] = ("sample_id",), comfort_cost: float = 0.45, emergency_cost: float = 1.01, weight: str = "weight",
                      families: Sequence[str] = FAMILIES) -> DataFrame:
    """Comfort and emergency survival at the last step, their gap, cheapest safe cost and survival per family (-1 when absent)."""
    rows = df.withColumn("_k", F.max("k").over(Window.partitionBy(*keys))).filter(F.col("k") == F.col("_k"))
    w = F.when((F.col(weight) > 0) & F.col(weight).isNotNull(), F.col(weight)).otherwise(1.0)

    def share(mask: Column, alive: str) -> Column:
        total = F.sum(F.when(mask, w))
        return F.when(total.isNull(), F.lit(-1.0)).otherwise(F.sum(F.when(mask & F.col(alive), w).otherwise(0.0)) / F.greatest(total, F.lit(1e-9)))
    fam = F.col("family")
    agg = rows.groupBy(*keys).agg(
        share(F.col("cost") <= comfort_cost, "safe_cum").alias("comfort_asr"), share(F.col("cost") <= emergency_cost, "safe_cum").alias("emergency_asr"),
        F.min(F.when(F.col("safe_cum"), F.col("cost"))).alias("min_safe_action_cost"),
        *[share(fam == f, "safe_cum").alias(f"survival_{f}") for f in families], *[share(fam == f, "safe").alias(f"slice_survival_{f}") for f in families])
    both = (F.col("comfort_asr") >= 0) & (F.col("emergency_asr") >= 0)
    return agg.withColumn("comfort_to_emergency_gap", F.when(both, F.col("emergency_asr") - F.col("comfort_asr")))


def actionability_features(df: DataFrame, keys: Sequence[str] = ("sample_id",), comfort_cost: float = 0.45, emergency_cost: float = 1.01) -> DataFrame:
    """All curve features of a key from rows (primitive, step, safe)."""
    safe = cumulative_safe(df, [*keys, "primitive_id"])
    curves = survival_curves(safe, keys)
    out = depletion_times(curves, keys).join(collapse_rates(curves, keys), list(keys)).join(survival_by_class(safe, keys, comfort_cost, emergency_cost), list(keys))
    return out.withColumns({"msr": F.col("asr_cum_final"), "c_maneuver": 1.0 - F.col("asr_cum_final")})


def primitive_safety(agents: DataFrame, primitives: DataFrame, occupancy: DataFrame, lane: DataFrame, grid: geo.Grid, min_drivable: float = 0.8) -> DataFrame:
    """Is the ego box of a primitive at a step free of other occupancy and mostly drivable?

    ``primitives`` (already chosen and aligned, one row per sample, primitive and step, in the ego's own frame) become cells; occupancy and lane
    cells join on (sample, step, cell) and (sample, cell).
    """
    ego = agents.filter("is_ego").select("sample_id", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("heading").alias("eh"), "length", "width")
    rows = primitives.join(ego, "sample_id")
    c, s = F.cos("eh"), F.sin("eh")
    info = ["sample_id", "primitive_id", "family", "cost", "weight", "k", "t"]
    placed = rows.select(*info, (F.col("ex") + c * F.col("x") - s * F.col("y")).alias("x"), (F.col("ey") + s * F.col("x") + c * F.col("y")).alias("y"),
                         (F.col("eh") + F.col("heading")).alias("heading"), "length", "width")
    cells = geo.rasterize_boxes(geo.with_box(placed), grid).select("sample_id", "primitive_id", "k", "cell_id")
    taken = occupancy.filter("other").select("sample_id", "k", "cell_id", F.lit(True).alias("taken"))
    road = lane.select("sample_id", "cell_id", F.lit(True).alias("road"))
    have = lane.select("sample_id").distinct().withColumn("has_lanes", F.lit(True))
    per = cells.join(taken, ["sample_id", "k", "cell_id"], "left").join(road, ["sample_id", "cell_id"], "left").groupBy("sample_id", "primitive_id", "k").agg(
        F.max(F.coalesce("taken", F.lit(False))).alias("hit"), (F.count("road") / F.count("*")).alias("drivable_fraction"))
    out = placed.select(*info).join(per, ["sample_id", "primitive_id", "k"], "left").join(have, "sample_id", "left")
    on_road = F.coalesce("has_lanes", F.lit(False)) == F.lit(False)
    frac = F.coalesce("drivable_fraction", F.lit(0.0))
    return out.select(*info, (~F.coalesce("hit", F.lit(False)) & (on_road | (frac >= min_drivable))).alias("safe"), frac.alias("drivable_fraction"))


def aligned_features(agents: DataFrame, states: DataFrame, lanes: DataFrame, dt: float, variants: Sequence[ac.Variant] = ac.VARIANTS) -> DataFrame:
    """Curve features per design variant: rollout poses against constant-velocity obstacles and lane buffers, all variants in one plan."""
    from feaslens.operators import checked

    spark = agents.sparkSession
    acts = [(h, lib, *a) for h, lib in sorted({(v.horizon_s, v.action_library) for v in variants}) for a in ac.LIBRARIES[lib]]
    pairs = [(i, j) for i, a in enumerate(acts) for j, v in enumerate(variants) if (v.horizon_s, v.action_library) == a[:2]]
    of, buffer = np.array([i for i, _ in pairs]), np.array([variants[j].lane_buffer_m for _, j in pairs])[:, None]
    each = pa.array(np.arange(len(pairs), dtype=np.int32))

    def summary(hits, gaps, has_lanes, made):
        safe = ~(hits[0][0] >= 0)[of] & ~((gaps[of] > buffer) & has_lanes)
        there = made[of]
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        return [each, pa.ListArray.from_arrays(pa.array(ends), pa.array(safe[there]))]

    found = checked.check_actions(agents, lanes, [None], [(a[5], a[6], a[0]) for a in acts], dt, max(v.lane_buffer_m for v in variants), "pair int, safe array<boolean>", summary)
    # All that follows is keyed by the sample first: one shuffle of a row a primitive, and tasks that do not grow with the table.
    found = ordered.spread_rows(found, agents.filter("is_ego").count() * int(sum(math.floor(acts[i][0] / dt + 1e-6) for i, _ in pairs)), "sample_id")
    table = spark.createDataFrame([(p, variants[j].variant_id, acts[i][2], acts[i][3], acts[i][4]) for p, (i, j) in enumerate(pairs)], "pair int, variant_id string, action string, family string, cost double")
    rows = found.join(F.broadcast(table), "pair").select("sample_id", "variant_id", "action", "family", "cost", F.posexplode("safe").alias("k", "safe")).withColumn("k", F.col("k") + 1)
    rows = rows.withColumn("t", F.col("k") * F.lit(dt))
    return actionability_features(rows.select("sample_id", "variant_id", F.col("action").alias("primitive_id"), "family", "cost", F.lit(1.0).alias("weight"), "k", "t",
                                              "safe"), ["sample_id", "variant_id"])
