"""Occupancy on a sparse cell table ``(sample_id, k, cell_id, ego, other, cnt)`` and the reachability metrics on it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions import geometry as geo
from feaslens.functions.columns import clip, cos, nearest_bin, sin
from feaslens.operators import ordered
from feaslens.operators.actions import _gap_to_segment


def cv_heading(threshold: float = 0.5) -> Column:
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return F.when(speed >= threshold, F.atan2("vy", "vx")).otherwise(F.col("heading"))


def time_grid(times: Sequence[float]) -> Column:
    """Array of (k, t, previous t); the first interval starts at 0."""
    prev = [0.0, *[float(t) for t in times[:-1]]]
    return F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(t)).alias("t"), F.lit(p).alias("t0")) for i, (t, p) in enumerate(zip(times, prev))])


def rasterize_cv(agents: DataFrame, times: Sequence[float], grid: geo.Grid, inflation: float = 0.5, min_motion: float = 0.05) -> DataFrame:
    """Cells swept by every agent at constant velocity during each interval; a resting agent keeps its box.

    The sweep of a box that does not turn is tested in the box frame, so no hull is built.
    """
    h = cv_heading()
    base = ordered.spread(agents, "sample_id", "agent_id").select("sample_id", "agent_id", "is_ego", "x", "y", "vx", "vy", cos(h).alias("c"), sin(h).alias("s"),
                         F.greatest(F.col("length") + 2 * inflation, F.lit(0.1)).alias("L"), F.greatest(F.col("width") + 2 * inflation, F.lit(0.1)).alias("W"))
    rows = base.select("*", F.explode(time_grid(times)).alias("q")).select(
        "sample_id", "agent_id", "is_ego", "c", "s", (F.col("L") / 2).alias("hl"), (F.col("W") / 2).alias("hw"), F.col("q.k").alias("k"), F.col("q.t").alias("t"),
        (F.col("x") + F.col("vx") * F.col("q.t0")).alias("ax"), (F.col("y") + F.col("vy") * F.col("q.t0")).alias("ay"),
        (F.col("x") + F.col("vx") * F.col("q.t")).alias("bx"), (F.col("y") + F.col("vy") * F.col("q.t")).alias("by"))
    gx, gy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    still = F.sqrt(gx * gx + gy * gy) < min_motion
    rows = rows.withColumns({"ax": F.when(still, F.col("bx")).otherwise(F.col("ax")), "ay": F.when(still, F.col("by")).otherwise(F.col("ay"))})
    ex, ey = F.abs("c") * F.col("hl") + F.abs("s") * F.col("hw"), F.abs("s") * F.col("hl") + F.abs("c") * F.col("hw")
    cells = geo.cells_for_bbox(rows, grid, F.least("ax", "bx") - ex, F.greatest("ax", "bx") + ex, F.least("ay", "by") - ey, F.greatest("ay", "by") + ey)
    turn = lambda dx, dy: (F.col("c") * dx + F.col("s") * dy, F.col("c") * dy - F.col("s") * dx)
    qx, qy = turn(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay"))
    mx, my = turn(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return cells.filter(geo.swept_contains(qx, qy, mx, my, F.col("hl"), F.col("hw"))).select("sample_id", "agent_id", "is_ego", "k", "t", "cell_id")


#: Cells of a scan line that comes so near to an edge or a corner (in metres, and in cells) are tested one by one.
NEAR = 1e-6


def tube_slices(edges: DataFrame) -> DataFrame:
    """One row per (mu, v0_kph, k) with its edges (left end first) as an array and its bounding box. A slice has at most some hundred edges."""
    back = F.col("x2") < F.col("x1")
    end = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a)).alias(a)
    hole = F.col("is_hole") if "is_hole" in edges.columns else F.lit(False)
    edge = F.struct(end("x1", "x2"), end("y1", "y2"), end("x2", "x1"), end("y2", "y1"), hole.alias("is_hole"))
    return edges.groupBy("mu", "v0_kph", "k").agg(
        F.first("t_s").alias("slice_t"), F.collect_list(edge).alias("edges"), F.least(F.min("x1"), F.min("x2")).alias("lx0"), F.greatest(F.max("x1"), F.max("x2")).alias("lx1"),
        F.least(F.min("y1"), F.min("y2")).alias("ly0"), F.greatest(F.max("y1"), F.max("y2")).alias("ly1"))


def in_tube(edges: Column, px: Column, py: Column) -> Column:
    """Is the point inside the outer rings and not inside a hole? Points on an edge are inside neither. Edges have their left end first."""
    def rings(hole: bool) -> Column:
        at = lambda e: e["y1"] + (e["y2"] - e["y1"]) * (px - e["x1"]) / (e["x2"] - e["x1"])
        met = ((lambda e: (e["x1"] <= px) & (px < e["x2"])), (lambda e: (e["x1"] < px) & (px <= e["x2"])))
        beyond = ((lambda e: py < at(e)), (lambda e: py > at(e)))
        odd = lambda m, b: F.size(F.filter(edges, lambda e: (e["is_hole"] == F.lit(hole)) & m(e) & b(e))) % 2 == 1
        return odd(met[0], beyond[0]) & odd(met[0], beyond[1]) & odd(met[1], beyond[0]) & odd(met[1], beyond[1])
    return rings(False) & ~rings(True)


def rasterize_tubes(agents: DataFrame, edges: DataFrame, times: Sequence[float], grid: geo.Grid, mu_bins: Sequence[float], speed_bins: Sequence[float],
                    slice_times: Sequence[float], mu_ego: float = 0.8, mu_other: float = 0.6) -> DataFrame:
    """Cells inside the reachable tube of each agent: nearest friction and speed bin, nearest time slice, even-odd rule.

    Counting crossings over outer rings and holes together removes the holes. Cells are filled by scan lines, so edges are looked at once
    per grid row and only inside cells are made; where a line comes too near to a corner or a crossing to a centre, its cells are tested one
    by one in the frame of the tube (``in_tube``). The slice table is a parameter table (bins × bins × slices) and joins by equality.
    """
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) * 3.6
    base = ordered.spread(agents, "sample_id", "agent_id").select("sample_id", "agent_id", "is_ego", "x", "y", "heading", cos("heading").alias("c"), sin("heading").alias("s"),
                         nearest_bin(F.when(F.col("is_ego"), F.lit(mu_ego)).otherwise(F.lit(mu_other)), mu_bins).alias("mu"),
                         nearest_bin(speed, speed_bins).alias("v0_kph"))
    nearest = [min(range(len(slice_times)), key=lambda i: (abs(slice_times[i] - t), i)) for t in times]
    asks = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(t)).alias("t"), F.lit(n).alias("slice")) for i, (t, n) in enumerate(zip(times, nearest))])).alias("q")
    slices = tube_slices(edges).withColumnRenamed("k", "slice").withColumn("v0_kph", F.col("v0_kph").cast("double"))
    rows = base.select("*", asks).select("*", "q.k", "q.t", "q.slice").drop("q").join(slices, ["mu", "v0_kph", "slice"])
    gx = lambda a, b: F.col("x") + F.col("c") * a - F.col("s") * b
    gy = lambda a, b: F.col("y") + F.col("s") * a + F.col("c") * b
    ends = [(F.col(a), F.col(b)) for a in ("lx0", "lx1") for b in ("ly0", "ly1")]
    res = grid.resolution
    first = lambda v, low: F.ceil((v - low) / res - 0.5).cast("int")
    least, most = (lambda g: F.least(*[g(a, b) for a, b in ends]) - NEAR), (lambda g: F.greatest(*[g(a, b) for a, b in ends]))
    low, high = F.greatest(first(least(gy), grid.y_min), F.lit(0)), F.least(first(most(gy), grid.y_min), F.lit(grid.ny - 1))
    turned = rows.filter(low <= high).withColumns({"_left": F.greatest(first(least(gx), grid.x_min), F.lit(0)), "_right": F.least(first(most(gx), grid.x_min), F.lit(grid.nx - 1)), "_e": F.transform("edges", lambda e: F.struct(
        gx(e["x1"], e["y1"]).alias("x1"), gy(e["x1"], e["y1"]).alias("y1"), gx(e["x2"], e["y2"]).alias("x2"), gy(e["x2"], e["y2"]).alias("y2")))})
    # Scan lines: per grid row the sorted crossings come in pairs, and the cells between a pair are inside.
    place = ("x", "y", "c", "s", "_left", "_right")
    lines = turned.select("sample_id", "agent_id", "is_ego", "k", "t", *place, "edges", "_e", F.explode(F.sequence(low, high)).alias("_iy")).withColumn("_cy", grid.center_y(F.col("_iy")))
    hit = F.filter("_e", lambda e: (e["y1"] > F.col("_cy")) != (e["y2"] > F.col("_cy")))
    at = F.array_sort(F.transform(hit, lambda e: e["x1"] + (F.col("_cy") - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    cell = lambda v: (v - grid.x_min) / res - 0.5
    unsure = F.exists("_e", lambda e: (F.abs(e["y1"] - F.col("_cy")) < NEAR) | (F.abs(e["y2"] - F.col("_cy")) < NEAR)) | F.exists("_xs", lambda v: F.abs(cell(v) - F.rint(cell(v))) < NEAR)
    lines = lines.withColumn("_xs", at).withColumn("_unsure", unsure).drop("_e").withColumn("edges", F.when(F.col("_unsure"), F.col("edges"))).filter(F.col("_unsure") | (F.size("_xs") >= 2))
    last = F.when(F.col("_unsure"), F.lit(0)).otherwise((F.floor(F.size("_xs") / 2) - 1).cast("int"))
    spans = lines.withColumn("_j", F.explode(F.sequence(F.lit(0), last)))
    x0 = F.greatest(first(F.get("_xs", F.col("_j") * 2), grid.x_min), F.lit(0))
    x1 = F.least(first(F.get("_xs", F.col("_j") * 2 + 1), grid.x_min) - 1, F.lit(grid.nx - 1))
    spans = spans.withColumns({"_x0": F.when(F.col("_unsure"), F.col("_left")).otherwise(x0), "_x1": F.when(F.col("_unsure"), F.col("_right")).otherwise(x1)})
    cells = spans.drop("_xs").filter("_x0 <= _x1").withColumn("_ix", F.explode(F.sequence("_x0", "_x1")))
    dx, dy = grid.center_x(F.col("_ix")) - F.col("x"), F.col("_cy") - F.col("y")
    inside = in_tube(F.col("edges"), F.col("c") * dx + F.col("s") * dy, F.col("c") * dy - F.col("s") * dx)
    cells = cells.filter(F.when(F.col("_unsure"), inside).otherwise(F.lit(True)))
    return cells.select("sample_id", "agent_id", "is_ego", "k", "t", (F.col("_iy") * grid.nx + F.col("_ix")).cast("bigint").alias("cell_id"))


def occupancy(cells: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Ego flag, other flag and agent count per cell and step."""
    return cells.groupBy(*keys, "k", "t", "cell_id").agg(
        F.max("is_ego").alias("ego"), F.max(~F.col("is_ego")).alias("other"), F.count("*").alias("cnt"))


def lane_cells(lanes: DataFrame, buffer: float, grid: geo.Grid) -> DataFrame:
    """Cells on a lane."""
    seg = geo.lane_segments(lanes)
    cells = geo.cells_for_bbox(seg, grid, F.least("x1", "x2") - buffer, F.greatest("x1", "x2") + buffer, F.least("y1", "y2") - buffer, F.greatest("y1", "y2") + buffer)
    return cells.filter(_gap_to_segment(F.col("cx"), F.col("cy")) <= buffer * buffer).select("sample_id", "cell_id").distinct()


def step_areas(occ: DataFrame, lane: DataFrame | None, cell_area: float, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Areas per key and step: overlap, union, ego, conflict, free, and their drivable forms."""
    rows = occ
    if lane is not None:
        rows = occ.join(lane.select(*[k for k in keys if k in lane.columns], "cell_id", F.lit(True).alias("drv")), [*[k for k in keys if k in lane.columns], "cell_id"], "left")
    else:
        rows = occ.withColumn("drv", F.lit(None).cast("boolean"))
    ego, other, drv = F.col("ego"), F.col("other"), F.coalesce("drv", F.lit(False))
    area = lambda c: F.sum(F.when(c, 1).otherwise(0)) * F.lit(cell_area)
    return rows.groupBy(*keys, "k", "t").agg(
        area(F.col("cnt") >= 2).alias("overlap"), area(F.col("cnt") > 0).alias("union"), area(ego).alias("ego"), area(ego & other).alias("conflict"),
        area(ego & ~other).alias("free"), area(ego & drv).alias("ego_drv"), area(ego & ~other & drv).alias("free_drv"))


def conflict_time(areas: DataFrame, keys: Sequence[str], last_t: float, dt: float, tau: float = 1.0, min_area: float = 1.0, min_ratio: float = 0.01) -> DataFrame:
    """First step with a reachable conflict, else one step past the horizon with urgency 0."""
    hit = (F.col("conflict") >= min_area) | (F.col("conflict") / F.greatest(F.col("ego"), F.lit(1e-9)) >= min_ratio)
    agg = areas.groupBy(*keys).agg(F.min(F.when(hit, F.col("t"))).alias("_t"))
    return agg.select(*keys, F.coalesce("_t", F.lit(last_t + dt)).alias("tfrc_s"), F.coalesce(F.exp(-F.col("_t") / max(tau, 1e-6)), F.lit(0.0)).alias("c_time"))


def overlap_entropy(occ: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Entropy of the agent count over occupied cells, normalised by log(max + 1), with max and mean count.

    Counts are small integers: the histogram per key is tiny after the first aggregation.
    """
    hist = occ.filter("cnt > 0").groupBy(*keys, "cnt").agg(F.count("*").alias("n"))
    arr = F.collect_list(F.struct("cnt", "n"))
    agg = hist.groupBy(*keys).agg(F.sum("n").alias("_n"), F.max("cnt").alias("max_overlap_count"), (F.sum(F.col("cnt") * F.col("n")) / F.sum("n")).alias("mean_overlap_count_nonzero"),
                                  arr.alias("_h"))
    p = lambda h: h["n"] / F.col("_n")
    ent = -F.aggregate("_h", F.lit(0.0), lambda acc, h: acc + p(h) * F.log(p(h) + 1e-12))
    return agg.withColumn("oce", ent).select(*keys, "oce", (F.col("oce") / F.greatest(F.log(F.col("max_overlap_count") + 1.0), F.lit(1e-9))).alias("oce_norm"),
                                             "max_overlap_count", "mean_overlap_count_nonzero")


def occupancy_metrics(occ: DataFrame, lane: DataFrame | None, samples: DataFrame, times: Sequence[float], grid: geo.Grid, prefix: str = "", tau: float = 1.0,
                      keys: Sequence[str] = ("sample_id",), density: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Time-weighted areas and the ratios on them. Samples without any occupied cell keep a row of zeros."""
    keys = list(keys)
    areas = step_areas(occ, lane, grid.cell_area, keys)
    w = F.exp(-F.col("t") / tau)
    ws = lambda c: F.sum(w * F.col(c)).alias(f"w_{c}")
    sums = areas.groupBy(*keys).agg(*[ws(c) for c in ("overlap", "union", "ego", "conflict", "free", "ego_drv", "free_drv")])
    dt = sorted(b - a for a, b in zip(times, times[1:]))
    step = (dt[len(dt) // 2] + dt[(len(dt) - 1) // 2]) / 2 if dt else 0.1
    time = conflict_time(areas, keys, float(times[-1]), step, tau)
    out = samples.select(*keys).distinct().join(sums, keys, "left").join(time, keys, "left").join(overlap_entropy(occ, keys), keys, "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    g = {c: z(F.col(f"w_{c}")) for c in ("overlap", "union", "ego", "conflict", "free", "ego_drv", "free_drv")}
    ratio = lambda a, b: z(a / F.nullif(b, F.lit(0.0)))
    roi = grid.nx * grid.ny * grid.cell_area * sum(math.exp(-t / tau) for t in times)
    rfr, rfr_drv = ratio(g["free"], g["ego"]), ratio(g["free_drv"], g["ego_drv"])
    cols = {
        "weighted_overlap_area_m2": g["overlap"], "weighted_union_area_m2": g["union"], "gtoa_norm_roi": g["overlap"] / roi, "gtoa_norm_union": ratio(g["overlap"], g["union"]),
        "weighted_ego_area_m2": g["ego"], "weighted_ego_conflict_area_m2": g["conflict"], "weighted_free_area_m2": g["free"], "rcr": ratio(g["conflict"], g["ego"]),
        "rfr": rfr, "c_space": 1.0 - rfr, "weighted_ego_drv_area_m2": g["ego_drv"], "weighted_free_drv_area_m2": g["free_drv"], "rfr_drv": rfr_drv, "c_space_drv": 1.0 - rfr_drv,
        "tfrc_s": F.coalesce("tfrc_s", F.lit(float(times[-1]) + step)), "c_time": z(F.col("c_time")), "oce": z(F.col("oce")), "oce_norm": z(F.col("oce_norm")),
        "max_overlap_count": F.coalesce("max_overlap_count", F.lit(0)), "mean_overlap_count_nonzero": z(F.col("mean_overlap_count_nonzero")),
        "c_density": clip(density[0] * ratio(g["overlap"], g["union"]) + density[1] * z(F.col("oce_norm")), 0.0, 1.0),
    }
    return out.select(*keys, *[v.alias(f"{prefix}{k}") for k, v in cols.items()])


def speed_bin_error(df: DataFrame, bins: Sequence[float], speed: str = "ego_speed_kph") -> DataFrame:
    nearest = nearest_bin(F.col(speed).cast("double"), bins)
    return df.withColumns({"ego_speed_bin_kph": nearest, "ego_speed_mismatch_abs_kph": F.abs(F.col(speed) - nearest), "ego_speed_bin_abs_error_kph": F.abs(F.col(speed) - nearest)})
