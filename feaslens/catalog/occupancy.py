"""Occupancy and curve queries: geometry on derived scenes, aggregates on line items as cells and primitives."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from feaslens.catalog import scenes as sc
from feaslens.catalog.base import query, r, read, rounded
from feaslens.catalog.scenes import LANES_SQL, SAMPLES_SQL, gap2_sql
from feaslens.catalog.tracks import variant_sql
from feaslens.functions import geometry as geo
from feaslens.operators import actions as ac
from feaslens.operators import curves as cv
from feaslens.operators import occupancy as oc
from feaslens.operators import ordered

GRID = geo.Grid(-30.37, 49.63, -24.23, 23.77, 2.0)  # offsets keep cell centres off box edges
TIMES = (0.5, 1.0, 1.5, 2.0)
GRID_SQL = f"""grid as (select iy * {GRID.nx} + ix as cell_id, {GRID.x_min} + (ix + 0.5) * 2.0 as cx, {GRID.y_min} + (iy + 0.5) * 2.0 as cy from range({GRID.nx}) a(ix), range({GRID.ny}) b(iy))"""


@query("OC1_OC2_rasterize_boxes", f"""
with {SAMPLES_SQL}, {GRID_SQL} select sample_id, agent_id, cell_id from agents, grid
where abs(cx - x) <= length + width and abs(cy - y) <= length + width and abs(cos(heading) * (cx - x) + sin(heading) * (cy - y)) <= length / 2 and abs(cos(heading) * (cy - y) - sin(heading) * (cx - x)) <= width / 2""")
def oc2(spark, sf):
    return geo.rasterize_boxes(geo.with_box(sc.samples(spark, sf)[0]), GRID).select("sample_id", "agent_id", "cell_id")


def _sweep_sql() -> str:
    """Swept box test: the point is inside the box at the sweep parameter where it is best, found on the piecewise-linear bound."""
    return f"""cvb as (select sample_id, agent_id, is_ego, k::int as k, (k + 1) * 0.5 as t, case when sqrt(vx ** 2 + vy ** 2) >= 0.5 then atan2(vy, vx) else heading end as h, (length + 1) / 2 as hl, (width + 1) / 2 as hw,
  x + vx * case when 0.5 * sqrt(vx ** 2 + vy ** 2) < 0.06 then (k + 1) * 0.5 else k * 0.5 end as ax, y + vy * case when 0.5 * sqrt(vx ** 2 + vy ** 2) < 0.06 then (k + 1) * 0.5 else k * 0.5 end as ay, x + vx * (k + 1) * 0.5 as bx, y + vy * (k + 1) * 0.5 as by_ from agents, range({len(TIMES)}) g(k)),
cvq as (select c.*, cell_id, cos(h) * (cx - ax) + sin(h) * (cy - ay) as qx, cos(h) * (cy - ay) - sin(h) * (cx - ax) as qy, cos(h) * (bx - ax) + sin(h) * (by_ - ay) as mx, cos(h) * (by_ - ay) - sin(h) * (bx - ax) as my
  from cvb c, grid where cx between least(ax, bx) - hl - hw and greatest(ax, bx) + hl + hw and cy between least(ay, by_) - hl - hw and greatest(ay, by_) + hl + hw),
cvw as (select *, case when abs(mx) < 1e-12 then case when abs(qx) <= hl then -1 else 2 end else least((qx - hl) / mx, (qx + hl) / mx) end as x0, case when abs(mx) < 1e-12 then case when abs(qx) <= hl then 2 else -1 end else greatest((qx - hl) / mx, (qx + hl) / mx) end as x1,
  case when abs(my) < 1e-12 then case when abs(qy) <= hw then -1 else 2 end else least((qy - hw) / my, (qy + hw) / my) end as y0, case when abs(my) < 1e-12 then case when abs(qy) <= hw then 2 else -1 end else greatest((qy - hw) / my, (qy + hw) / my) end as y1 from cvq),
cv as (select sample_id, agent_id, is_ego, k, t, cell_id from cvw where greatest(x0, y0, 0) <= least(x1, y1, 1))"""


CV_SQL = f"{SAMPLES_SQL}, {GRID_SQL}, {_sweep_sql()}"


@query("OC3_rasterize_cv", f"with {CV_SQL} select sample_id, agent_id, k, cell_id from cv")
def oc3(spark, sf):
    return oc.rasterize_cv(sc.samples(spark, sf)[0], TIMES, GRID, min_motion=0.06).select("sample_id", "agent_id", "k", "cell_id")


MU, SPEEDS, SLICES = (0.6, 0.8), (10, 30, 50), (0.5, 1.0, 1.5, 2.0)


def tube_edges(spark):
    """Tube outlines as a parameter table: a forward trapezoid per friction, speed and slice, with a hole behind the front."""
    b = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in MU])).alias("mu")).select("mu", F.explode(F.array(*[F.lit(v) for v in SPEEDS])).alias("v0_kph")).select(
        "mu", "v0_kph", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("t_s")) for i, t in enumerate(SLICES)])).alias("q")).select("mu", "v0_kph", "q.*")
    far, half = F.col("v0_kph") / 3.6 * F.col("t_s") + 4.0, F.bround(F.col("mu") * 4.0 + F.col("t_s"), 6)  # the double nearest to the decimal
    ring = lambda hole, pts: [(hole, pts[i], pts[(i + 1) % len(pts)]) for i in range(len(pts))]
    outer = ring(False, [(F.lit(-2.0), -half), (far, -half * 2), (far, half * 2), (F.lit(-2.0), half)])
    inner = ring(True, [(far * 0.4, -half * 0.5), (far * 0.6, -half * 0.5), (far * 0.6, half * 0.5), (far * 0.4, half * 0.5)])
    edges = F.explode(F.array(*[F.struct(F.lit(h).alias("is_hole"), a[0].alias("x1"), a[1].alias("y1"), c[0].alias("x2"), c[1].alias("y2")) for h, a, c in outer + inner])).alias("e")
    return b.select("mu", "v0_kph", "k", "t_s", edges).select("mu", "v0_kph", "k", "t_s", "e.*")


@query("OC4_rasterize_tubes", f"""
with {SAMPLES_SQL}, {GRID_SQL}, a as (select *, case when is_ego then 0.8 else 0.6 end as mu, sqrt(vx ** 2 + vy ** 2) * 3.6 as v from agents),
b as (select a.*, k::int as k, (k + 1) * 0.5 as t, case when v <= 20 then 10 when v <= 40 then 30 else 50 end as vb from a, range(4) g(k)),
c as (select *, vb / 3.6 * t + 4.0 as far, mu * 4.0 + t as half from b),
p as (select sample_id, agent_id, k, cell_id, far, half, cos(heading) * (cx - x) + sin(heading) * (cy - y) as px, cos(heading) * (cy - y) - sin(heading) * (cx - x) as py from c, grid where abs(cx - x) < 70 and abs(cy - y) < 70)
select sample_id, agent_id, k, cell_id from p where px > -2 and px < far and abs(py) < half + half * (px + 2) / (far + 2) and not (px > far * 0.4 and px < far * 0.6 and abs(py) < half * 0.5)""")
def oc4(spark, sf):
    cells = oc.rasterize_tubes(sc.samples(spark, sf)[0], tube_edges(spark), TIMES, GRID, MU, SPEEDS, SLICES)
    return cells.select("sample_id", "agent_id", "k", "cell_id")


@query("OC5_occupancy", "select l_orderkey as sample_id, l_linenumber as k, (l_partkey % 5)::bigint as cell_id, bool_or(l_returnflag = 'R') as ego, bool_or(l_returnflag != 'R') as other, count(*) as cnt from lineitem group by 1, 2, 3")
def oc5(spark, sf):
    return oc.occupancy(cell_rows(spark, sf)).drop("t")


def cell_rows(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("k"), (F.col("l_linenumber") * 0.5).alias("t"), (F.col("l_partkey") % 5).alias("cell_id"), (F.col("l_returnflag") == "R").alias("is_ego"))


LANE_CELL_SQL = f"""lc as (select distinct g.sample_id, cell_id from (select s.sample_id, cell_id, {gap2_sql('p')} as g2 from seg s, (select cell_id, cx as x, cy as y from grid) p where least(s.x1, s.x2) - 3 <= p.x and greatest(s.x1, s.x2) + 3 >= p.x) g where g2 <= 9.0)"""


@query("OC6_lane_cells", f"with {SAMPLES_SQL}, {LANES_SQL}, {GRID_SQL}, {LANE_CELL_SQL} select * from lc")
def oc6(spark, sf):
    return oc.lane_cells(sc.lanes(spark, sf), 3.0, GRID)


W = sum(math.exp(-t) for t in TIMES)
OCC_METRIC_SQL = f"""{CV_SQL}, {{lanes}}, oc as (select sample_id, k, t, cell_id, bool_or(is_ego) ego, bool_or(not is_ego) oth, count(*) cnt from cv group by 1, 2, 3, 4), od as (select oc.*, lc.cell_id is not null as drv from oc left join lc using (sample_id, cell_id)),
st as (select sample_id, k, t, sum((cnt >= 2)::int) * 4.0 as ov, count(*) * 4.0 as un, sum(ego::int) * 4.0 as eg, sum((ego and oth)::int) * 4.0 as cf, sum((ego and not oth)::int) * 4.0 as fr, sum((ego and drv)::int) * 4.0 as ed, sum((ego and not oth and drv)::int) * 4.0 as fd from od group by 1, 2, 3),
ws as (select sample_id, sum(exp(-t) * ov) ov, sum(exp(-t) * un) un, sum(exp(-t) * eg) eg, sum(exp(-t) * cf) cf, sum(exp(-t) * fr) fr, sum(exp(-t) * ed) ed, sum(exp(-t) * fd) fd, min(t) filter (cf >= 1 or cf / greatest(eg, 1e-9) >= 0.01) as ft from st group by 1),
hi as (select sample_id, cnt, count(*) n from oc group by 1, 2), he as (select sample_id, n, cnt, sum(n) over (partition by sample_id) as tn from hi),
en as (select sample_id, -sum(n / tn * ln(n / tn + 1e-12)) as oce, max(cnt) as mc, sum(cnt * n) / max(tn) as mean_c from he group by 1),
sa as (select distinct sample_id from agents)"""


@query("OC7_OC8_OC9_occupancy_metrics", f"""
with {OCC_METRIC_SQL.format(lanes=LANES_SQL + ', ' + LANE_CELL_SQL)} select sample_id, {r('coalesce(ov, 0)')} as cv_weighted_overlap_area_m2, {r(f'coalesce(ov, 0) / {GRID.nx * GRID.ny * 4.0 * W}')} as cv_gtoa_norm_roi, {r('coalesce(ov / nullif(un, 0), 0)')} as cv_gtoa_norm_union, {r('coalesce(cf / nullif(eg, 0), 0)')} as cv_rcr,
  {r('coalesce(fr / nullif(eg, 0), 0)')} as cv_rfr, {r('coalesce(fd / nullif(ed, 0), 0)')} as cv_rfr_drv, {r('1 - coalesce(fd / nullif(ed, 0), 0)')} as cv_c_space_drv, {r('coalesce(ft, 2.5)')} as cv_tfrc_s, {r('coalesce(exp(-ft), 0)')} as cv_c_time, {r('coalesce(oce, 0)')} as cv_oce,
  {r('coalesce(oce / ln(mc + 1), 0)')} as cv_oce_norm, coalesce(mc, 0) as cv_max_overlap_count, {r('coalesce(mean_c, 0)')} as cv_mean_overlap_count_nonzero, {r('greatest(0, least(1, 0.7 * coalesce(ov / nullif(un, 0), 0) + 0.3 * coalesce(oce / ln(mc + 1), 0)))')} as cv_c_density
from sa left join ws using (sample_id) left join en using (sample_id)""")
def oc7(spark, sf):
    agents, _, lanes = sc.stored(spark, sf)
    occ = oc.occupancy(oc.rasterize_cv(agents, TIMES, GRID, min_motion=0.06))
    out = oc.occupancy_metrics(occ, oc.lane_cells(lanes, 3.0, GRID), agents, TIMES, GRID, "cv_")
    return rounded(out.select("sample_id", "cv_weighted_overlap_area_m2", "cv_gtoa_norm_roi", "cv_gtoa_norm_union", "cv_rcr", "cv_rfr", "cv_rfr_drv", "cv_c_space_drv", "cv_tfrc_s", "cv_c_time", "cv_oce", "cv_oce_norm", "cv_max_overlap_count",
                              "cv_mean_overlap_count_nonzero", "cv_c_density"))


@query("OC13_speed_bins", f"""
select event_id, case when value <= 20 then 10.0 when value <= 45 then 30.0 else 60.0 end as ego_speed_bin_kph, {r('abs(value - case when value <= 20 then 10.0 when value <= 45 then 30.0 else 60.0 end)')} as ego_speed_mismatch_abs_kph from events""")
def oc13(spark, sf):
    df = oc.speed_bin_error(read(spark, sf, "events").withColumnRenamed("value", "ego_speed_kph"), (10, 30, 60))
    return rounded(df.select("event_id", "ego_speed_bin_kph", "ego_speed_mismatch_abs_kph"))


# Primitive rows: order = sample, part = primitive, line number = step; every primitive is listed at all steps of its sample.
PRIM_SQL = """pr0 as (select distinct l_orderkey as sample_id, l_partkey as primitive_id from lineitem),
pr as (select sample_id, primitive_id, ['keep', 'brake', 'hard_brake', 'left', 'right'][primitive_id % 5 + 1] as family, (primitive_id % 8) / 5.0::double as cost, (primitive_id % 4)::double as weight, k::int as k, k * 0.25::double as t, (primitive_id * 31 + sample_id * 17 + k * 7) % 9 > 1 as safe from pr0, range(8) g(k)),
sf as (select *, min(safe::int) over (partition by sample_id, primitive_id order by k) = 1 as safe_cum, case when weight > 0 then weight else 1.0 end as w from pr),
cu as (select sample_id, k, t, sum(case when safe then w else 0 end) / sum(w) as slice, sum(case when safe_cum then w else 0 end) / sum(w) as cum from sf group by 1, 2, 3)"""


def primitives(spark, sf):
    p = F.col("primitive_id")
    listed = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("primitive_id"))
    # One shuffle for all that follows: every key begins with the sample. The count reads no column.
    base = ordered.spread_rows(listed, listed.count(), "sample_id").distinct()
    fam = F.element_at(F.array(*[F.lit(x) for x in ("keep", "brake", "hard_brake", "left", "right")]), (p % 5 + 1).cast("int"))
    return base.select("sample_id", "primitive_id", fam.alias("family"), (p % 8 / 5.0).alias("cost"), (p % 4).cast("double").alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).withColumns(
        {"t": F.col("k") * 0.25, "safe": (p * 31 + F.col("sample_id") * 17 + F.col("k") * 7) % 9 > 1})


def curves(spark, sf):
    return cv.survival_curves(cv.cumulative_safe(primitives(spark, sf), ["sample_id", "primitive_id"]))


@query("AS2_cumulative_safe", f"with {PRIM_SQL} select sample_id, primitive_id, k, safe, safe_cum from sf")
def as2(spark, sf):
    return cv.cumulative_safe(primitives(spark, sf), ["sample_id", "primitive_id"]).select("sample_id", "primitive_id", "k", "safe", "safe_cum")


@query("AS3_survival_curves", f"with {PRIM_SQL} select sample_id, k, {r('slice')} as slice, {r('cum')} as cum from cu")
def as3(spark, sf):
    return rounded(curves(spark, sf).select("sample_id", "k", "slice", "cum"))


@query("AS3_curve_columns", f"""
with {PRIM_SQL} select sample_id, {', '.join(f"{r(f'max(case when k = {i} then {c} end)')} as asr_{c}_t{n}s" for c in ('cum', 'slice') for i, n in ((0, '0p0'), (2, '0p5'), (4, '1p0')))} from cu group by 1""")
def as3b(spark, sf):
    return rounded(cv.curve_columns(curves(spark, sf), ["sample_id"], (0.0, 0.5, 1.0)))


@query("AS4_AS6_depletion", f"""
with {PRIM_SQL}, a as (select sample_id, arg_min(cum, t) i, arg_max(cum, t) f, min(cum) m, arg_min(slice, t) si, arg_max(slice, t) sf, min(slice) sm, coalesce(min(t) filter (cum <= 0.05), 2.0) td, min(t) filter (slice < 0.999) tc, 1 - avg(cum) filter (t <= 0.5) eb from cu group by 1)
select sample_id, {r('i')} as asr_cum_initial, {r('f')} as asr_cum_final, {r('m')} as asr_cum_min, {r('si')} as asr_slice_initial, {r('sf')} as asr_slice_final, {r('sm')} as asr_slice_min, td as ttad_s, coalesce(tc, td) as time_to_first_conflict_s, {r('eb')} as early_blocking_ratio from a""")
def as4(spark, sf):
    return rounded(cv.depletion_times(curves(spark, sf)))


@query("AS5_collapse", f"""
with {PRIM_SQL}, d as (select sample_id, t, cum, greatest((lag(cum) over w - cum) / 0.25, 0) as dr from cu window w as (partition by sample_id order by t))
select sample_id, {r('max(dr)')} as collapse_rate_max_per_s, {r('greatest(arg_min(cum, t) - arg_max(cum, t), 0) / 1.75')} as collapse_rate_mean_per_s from d group by 1""")
def as5(spark, sf):
    return rounded(cv.collapse_rates(curves(spark, sf)))


def class_sql(cond: str, alive: str) -> str:
    return f"coalesce(sum(case when {cond} and {alive} then w else 0 end) / nullif(sum(case when {cond} then w else 0 end), 0), -1)"


@query("AS7_survival_by_class", f"""
with {PRIM_SQL}, l as (select * from sf where k = 7), a as (select sample_id, {class_sql('cost <= 0.45', 'safe_cum')} c, {class_sql('cost <= 1.01', 'safe_cum')} e, min(cost) filter (safe_cum) mc, {class_sql("family = 'keep'", 'safe_cum')} sk, {class_sql("family = 'left'", 'safe')} sl from l group by 1)
select sample_id, {r('c')} as comfort_asr, {r('e')} as emergency_asr, {r('mc')} as min_safe_action_cost, {r('sk')} as survival_keep, {r('sl')} as slice_survival_left, {r('case when c >= 0 and e >= 0 then e - c end')} as comfort_to_emergency_gap from a""")
def as7(spark, sf):
    out = cv.survival_by_class(cv.cumulative_safe(primitives(spark, sf), ["sample_id", "primitive_id"]))
    return rounded(out.select("sample_id", "comfort_asr", "emergency_asr", "min_safe_action_cost", "survival_keep", "slice_survival_left", "comfort_to_emergency_gap"))


@query("AS8_primitive_family", f"""
with c as (select p_partkey, (p_partkey % 11 - 5) * 0.07 as d, (p_partkey % 3) * 0.5 as th, (p_partkey % 4) * 0.25 as br from part)
select p_partkey, case when abs(d) <= 0.05 and br > 0.05 then case when br >= 0.6 then 'hard_brake' else 'brake' end when abs(d) <= 0.05 then case when th > 0.05 then 'accelerate' else 'keep' end when br > 0.05 then 'brake_' || case when d > 0 then 'left' else 'right' end
  when d > 0 then 'left' else 'right' end as family, {r('0.5 * abs(d) / 0.35 + 0.35 * br + 0.15 * th')} as cost from c""")
def as8(spark, sf):
    k = F.col("p_partkey")
    d, th, br = (k % 11 - 5) * 0.07, (k % 3) * 0.5, (k % 4) * 0.25
    return rounded(read(spark, sf, "part").select("p_partkey", cv.primitive_family(d, th, br).alias("family"), cv.primitive_cost(d, th, br).alias("cost")))


@query("AS9_align_times", """
with p as (select l_partkey as primitive_id, l_linenumber * 0.37::double as t_s, max(l_quantity) as x from lineitem group by 1, 2), q as (select k::int as k, k * 0.5::double as t from range(6) g(k))
select primitive_id, k, t, arg_min(x, {'d': abs(t_s - t), 's': t_s}) as x, arg_min(t_s, {'d': abs(t_s - t), 's': t_s}) as src_t_s from p, q group by 1, 2, 3""")
def as9(spark, sf):
    p = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("primitive_id"), (F.col("l_linenumber") * 0.37).alias("t_s")).agg(F.max("l_quantity").alias("x"))
    return cv.align_times(p, [i * 0.5 for i in range(6)], ["primitive_id"])


@query("AS10_thin", """
with p as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as rn, count(*) over (partition by p_brand) as m from part)
select p_partkey, p_brand from p where m <= 7 or rn in (select round_even(i * (m - 1) / 6.0::double, 0)::bigint from range(7) g(i))""")
def as10(spark, sf):
    return cv.thin(read(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"], "p_partkey", 7)


VEH = {"Cf0_Nprad_front": 80000.0, "Cr0_Nprad_rear": 90000.0, "m_kg": 1500.0, "Iz_kgm2": 2500.0, "lf_m": 1.2, "lr_m": 1.5}


@query("AS11_stability", """
with t as (select l_orderkey, l_quantity / 2 as v, greatest(l_quantity / 2, 0.5) as ve, l_discount * 6 as beta, l_tax * 5 as r, (l_linenumber - 4) * 2.0 as ax, l_discount * 100 as ay from lineitem),
e as (select *, 0.8 * 80000 as cf, 0.8 * 90000 as cr from t),
s as (select *, abs(beta) < 0.95 * atan(0.8) as s1, abs(r) < 0.95 * 0.8 * 9.81 / ve as s2, abs(0.55 * ay) < 0.5 * 1.55 * 9.81 * 0.95 as s3, abs(ax) <= 0.95 * 0.8 * 9.81 as s4,
  -(cf + cr) / (1500 * ve) - (1.44 * cf + 2.25 * cr) / (2500 * ve) < 0 and (cf + cr) / (1500 * ve) * (1.44 * cf + 2.25 * cr) / (2500 * ve) - (-1 - (1.2 * cf - 1.5 * cr) / (1500 * ve * ve + 1e-9)) * (-(1.2 * cf - 1.5 * cr) / 2500) > 0 as s5 from e)
select l_orderkey, bool_and(s1) as "S1_beta", bool_and(s2) as "S2_r", bool_and(s3) as "S3_ltr", bool_and(s4) as "S4_ax", bool_and(s5) as "S5_spec", bool_and(s1 and s2 and s3 and s4 and s5) as ok, round_even(avg((s1 and s2 and s3 and s4 and s5)::int), 6) + 0.0 as ok_fraction from s group by 1""")
def as11(spark, sf):
    t = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") / 2).alias("v_mps"), (F.col("l_discount") * 6).alias("beta_rad"), (F.col("l_tax") * 5).alias("r_rps"), ((F.col("l_linenumber") - 4) * 2.0).alias("ax"),
                                           (F.col("l_discount") * 100).alias("ay"))
    return rounded(cv.stability_filter(t, ["l_orderkey"], VEH, 0.8))


PRIMS_SQL = f"""pm as (select a.sample_id, p::int as primitive_id, k::int as k, sqrt(vx ** 2 + vy ** 2) * (k + 1) * 0.5 as x, (p - 2) * 1.5 * ((k + 1) * 0.5) / 2.0 as y, length, width from agents a, range(5) t(p), range({len(TIMES)}) g(k) where is_ego),
pc as (select pm.sample_id, primitive_id, k, cell_id from pm, grid where abs(cx - x) <= length / 2 and abs(cy - y) <= width / 2),
tk as (select distinct sample_id, k, cell_id from cv where not is_ego),
pp as (select pc.sample_id, primitive_id, pc.k, bool_or(tk.cell_id is not null) as hit, count(lc.cell_id) / count(*) as fr from pc left join tk on pc.sample_id = tk.sample_id and pc.k = tk.k and pc.cell_id = tk.cell_id left join lc on pc.sample_id = lc.sample_id and pc.cell_id = lc.cell_id group by 1, 2, 3)"""


@query("AS1_primitive_safety", f"""
with {CV_SQL}, {LANES_SQL}, {LANE_CELL_SQL}, {PRIMS_SQL} select pm.sample_id, pm.primitive_id, pm.k, not coalesce(hit, false) and (pm.sample_id not in (select sample_id from lc) or coalesce(fr, 0) >= 0.8) as safe, {r('coalesce(fr, 0)')} as drivable_fraction
from pm left join pp on pm.sample_id = pp.sample_id and pm.primitive_id = pp.primitive_id and pm.k = pp.k""")
def as1(spark, sf):
    agents, _, lanes = sc.stored(spark, sf, future=False)
    occ = oc.occupancy(oc.rasterize_cv(agents, TIMES, GRID, min_motion=0.06))
    prims = agents.filter("is_ego").select("sample_id", (F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("primitive_id")).select(
        "*", F.explode(oc.time_grid(TIMES)).alias("q"))
    lat = (F.col("primitive_id") - 2) * 1.5 * F.col("q.t") / 2.0
    prims = prims.select("sample_id", "primitive_id", F.lit("keep").alias("family"), F.lit(0.0).alias("cost"), F.lit(1.0).alias("weight"), F.col("q.k").alias("k"), F.col("q.t").alias("t"), (F.col("v") * F.col("q.t")).alias("x"), lat.alias("y"), F.lit(0.0).alias("heading"))
    return rounded(cv.primitive_safety(agents, prims, occ, oc.lane_cells(lanes, 3.0, GRID), GRID).select("sample_id", "primitive_id", "k", "safe", "drivable_fraction"))


@query("AS12_aligned_features", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {variant_sql(ac.VARIANTS)},
ob as (select sample_id, k::int as k, x + vx * k * {sc.DT} as x, y + vy * k * {sc.DT} as y, case when sqrt(vx ** 2 + vy ** 2) > 0.2 then atan2(vy, vx) else heading end as heading, length, width from agents, range(1, 9) t(k) where not is_ego),
hk as (select distinct p.sample_id, p.h, p.lib, p.action, p.k from rollv p join ob o on p.sample_id = o.sample_id and p.k = o.k and {sc.overlap_sql('p', 'o')}),
sa as (select p.sample_id, v.variant_id, p.action, p.cost, p.k, p.t, hk.k is null and (p.sample_id not in (select sample_id from seg) or coalesce(l.g <= v.b, false)) as safe from rollv p join vr v on p.h = v.h and p.lib = v.lib
  left join hk on p.sample_id = hk.sample_id and p.h = hk.h and p.lib = hk.lib and p.action = hk.action and p.k = hk.k left join ltv l on p.sample_id = l.sample_id and p.h = l.h and p.lib = l.lib and p.action = l.action and p.k = l.k),
sc as (select *, min(safe::int) over (partition by sample_id, variant_id, action order by k) = 1 as cs from sa), cu as (select sample_id, variant_id, t, avg(safe::int) as sl, avg(cs::int) as cum from sc group by 1, 2, 3),
dr as (select *, greatest((lag(cum) over w - cum) / {sc.DT}, 0) as d from cu window w as (partition by sample_id, variant_id order by t)),
ft as (select sample_id, variant_id, arg_min(cum, t) i, arg_max(cum, t) f, min(sl) sm, coalesce(min(t) filter (cum <= 0.05), max(t) + {sc.DT}) td, min(t) filter (sl < 0.999) tc, max(d) cm, 1 - avg(cum) filter (t <= 0.5) eb from dr group by 1, 2)
select sample_id, variant_id, {r('i')} as asr_cum_initial, {r('f')} as asr_cum_final, {r('sm')} as asr_slice_min, {r('td')} as ttad_s, {r('coalesce(tc, td)')} as time_to_first_conflict_s, {r('cm')} as collapse_rate_max_per_s, {r('eb')} as early_blocking_ratio from ft""")
def as12(spark, sf):
    agents, states, lanes = sc.stored(spark, sf, future=False)  # obstacles move at constant velocity
    out = cv.aligned_features(agents, states, lanes, sc.DT)
    return rounded(out.select("sample_id", "variant_id", "asr_cum_initial", "asr_cum_final", "asr_slice_min", "ttad_s", "time_to_first_conflict_s", "collapse_rate_max_per_s", "early_blocking_ratio"))
