"""Baseline and composite score queries over orders as samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog.base import SCORED_SQL, query, r, read, rounded
from feaslens.catalog.metrics import AUPRC, curve_sql
from feaslens.operators import metrics
from feaslens.operators import scores as so

# Current-state features per order.
FEAT_SQL = """ft as (select o_orderkey::varchar as sample_id, o_custkey::varchar as scenario_id, case when o_orderkey % 9 = 0 then null else (o_totalprice / 4937)::double end as headway_m, o_totalprice / 3989 as current_min_distance_m,
  case when o_orderkey % 4 = 0 then -1.0 else (o_custkey % 60) / 10.0 end as current_ttc_s, (o_orderkey * 17 % 250) / 10.0 as ego_speed_mps, case when o_orderkey % 7 = 0 then null else (o_orderkey * 29 % 120) / 10.0 - 2.0 end as nearest_agent_closing_speed_mps,
  (o_orderkey * 37 % 80) / 10.0 - 4.0 as nearest_agent_lateral_speed_mps, (o_orderkey * 41 % 90) / 10.0 as current_lateral_clearance_m, case when o_orderkey % 5 = 0 then (o_custkey % 30) / 10.0 end as cv_min_collision_time_3s_s,
  case when o_orderkey % 6 = 0 then null else (o_orderkey * 43 % 300) / 10.0 - 5.0 end as cv_min_predicted_separation_3s_m, (o_orderkey * 47 % 100) / 50.0 as cv_occupancy_overlap_integral_3s, case when o_orderkey % 8 = 0 then null else (o_orderkey * 53 % 40) / 10.0 - 2.0 end as road_margin_m from orders)"""


def features(spark, sf):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return read(spark, sf, "orders").select(
        k.cast("string").alias("sample_id"), c.cast("string").alias("scenario_id"), F.when(k % 9 != 0, p / 4937).alias("headway_m"), (p / 3989).alias("current_min_distance_m"),
        F.when(k % 4 == 0, -1.0).otherwise(c % 60 / 10.0).alias("current_ttc_s"), (k * 17 % 250 / 10.0).alias("ego_speed_mps"), F.when(k % 7 != 0, k * 29 % 120 / 10.0 - 2.0).alias("nearest_agent_closing_speed_mps"),
        (k * 37 % 80 / 10.0 - 4.0).alias("nearest_agent_lateral_speed_mps"), (k * 41 % 90 / 10.0).alias("current_lateral_clearance_m"), F.when(k % 5 == 0, c % 30 / 10.0).alias("cv_min_collision_time_3s_s"),
        F.when(k % 6 != 0, k * 43 % 300 / 10.0 - 5.0).alias("cv_min_predicted_separation_3s_m"), (k * 47 % 100 / 50.0).alias("cv_occupancy_overlap_integral_3s"), F.when(k % 8 != 0, k * 53 % 40 / 10.0 - 2.0).alias("road_margin_m"))


def norm_sql(col: str, invert: bool = False) -> str:
    """Null-keeping percentile scaling of a column of ``s`` with statistics ``q`` (q.<col>_lo/_hi)."""
    if invert:
        return f"case when s.{col} is not null then greatest(0, least(1, (({col}_hi - s.{col}) - ({col}_hi - {col}_hi)) / nullif(({col}_hi - {col}_lo) - ({col}_hi - {col}_hi), 0))) end"
    return f"case when s.{col} is not null then greatest(0, least(1, (s.{col} - {col}_lo) / nullif({col}_hi - {col}_lo, 0))) end"


def stats_sql(cols, source: str = "s") -> str:
    return "q as (select " + ", ".join(f"quantile_cont({c}, 0.01) as {c}_lo, quantile_cont({c}, 0.99) as {c}_hi" for c in cols) + f" from {source})"


def mean_sql(terms) -> str:
    return "(" + " + ".join(f"coalesce({t}, 0)" for t in terms) + ") / nullif(" + " + ".join(f"({t} is not null)::int" for t in terms) + ", 0)"


CRIT_SQL = f"""{FEAT_SQL}, s as (select *, coalesce(headway_m, current_min_distance_m) as hw, coalesce(headway_m, current_min_distance_m) / nullif(ego_speed_mps, 0) as thw,
  case when current_ttc_s >= 0 then current_ttc_s when cv_min_collision_time_3s_s >= 0 then cv_min_collision_time_3s_s end as ttc,
  case when nearest_agent_closing_speed_mps is not null then greatest(nearest_agent_closing_speed_mps, 0) ** 2 / (2 * greatest(coalesce(headway_m, current_min_distance_m), 0.1)) end as al, abs(nearest_agent_lateral_speed_mps) ** 2 / (2 * greatest(current_lateral_clearance_m, 0.1)) as la from ft),
{stats_sql(['hw', 'thw', 'ttc', 'al', 'la'])}"""


@query("BS1_criticality", f"""
with {CRIT_SQL} select sample_id, scenario_id, {r('hw')} as "HW_m", {r('thw')} as "THW_s", {r('ttc')} as "TTC_s", {r('al')} as "ALongReq_mps2", {r('la')} as "ALatReq_mps2", {r('-thw')} as "THW_inverse",
  false as "TTR_available", {r(mean_sql([norm_sql('hw', True), norm_sql('thw', True), norm_sql('ttc', True), norm_sql('al'), norm_sql('la')]))} as commonroad_crime_risk_score from s, q""")
def bs1(spark, sf):
    out = so.criticality_scores(features(spark, sf))
    return rounded(out.select("sample_id", "scenario_id", "HW_m", "THW_s", "TTC_s", "ALongReq_mps2", "ALatReq_mps2", "THW_inverse", "TTR_available", "commonroad_crime_risk_score"))


RSS_SQL = f"""{FEAT_SQL}, b as (select *, coalesce(headway_m, current_min_distance_m) as hw, greatest(ego_speed_mps - coalesce(greatest(nearest_agent_closing_speed_mps, 0), 0), 0) as lead from ft),
b2 as (select *, greatest(ego_speed_mps + 1.0 + (ego_speed_mps + 2.0) ** 2 / 8.0 - lead ** 2 / 16.0, 0) as safe from b), s as (select *, -(hw - safe) as nl, -(current_lateral_clearance_m - (1.0 + 0.5 * abs(nearest_agent_lateral_speed_mps))) as nt from b2), {stats_sql(['nl', 'nt'])}"""


@query("BS2_rss", f"""
with {RSS_SQL} select sample_id, {r('safe')} as rss_longitudinal_safe_distance_m, {r('-nl')} as rss_longitudinal_margin_m, {r('-nt')} as rss_lateral_margin_m, {r(mean_sql([norm_sql('nl'), norm_sql('nt')]))} as rss_danger_score from s, q""")
def bs2(spark, sf):
    return rounded(so.rss_scores(features(spark, sf)).select("sample_id", "rss_longitudinal_safe_distance_m", "rss_longitudinal_margin_m", "rss_lateral_margin_m", "rss_danger_score"))


DRV_SQL = f"""{FEAT_SQL}, b as (select *, coalesce(headway_m, current_min_distance_m) - ego_speed_mps ** 2 / 14.0 as mg, case when cv_min_collision_time_3s_s >= 0 then cv_min_collision_time_3s_s when current_ttc_s >= 0 then current_ttc_s end as tk from ft),
s as (select *, -mg as nm, -road_margin_m as nr, ((not ((tk is null or tk > 3) and coalesce(road_margin_m, 0) > -0.25))::int)::double as inf from b), {stats_sql(['nm', 'nr', 'tk', 'inf'])}"""


@query("BS3_drivability", f"""
with {DRV_SQL} select sample_id, {r('mg')} as emergency_brake_margin_m, mg >= 0 as emergency_brake_feasible, {r('tk')} as min_collision_time_keep_lane, inf = 0 as keep_lane_cv_feasible,
  {r(mean_sql([norm_sql('nm'), norm_sql('nr'), norm_sql('tk', True), norm_sql('inf')]))} as drivability_risk_score from s, q""")
def bs3(spark, sf):
    return rounded(so.drivability_scores(features(spark, sf)).select("sample_id", "emergency_brake_margin_m", "emergency_brake_feasible", "min_collision_time_keep_lane", "keep_lane_cv_feasible", "drivability_risk_score"))


FC_SQL = f"""{FEAT_SQL}, b as (select *, coalesce(cv_min_predicted_separation_3s_m, coalesce(headway_m, current_min_distance_m) - coalesce(greatest(nearest_agent_closing_speed_mps, 0), 0) * 3.0) as sep from ft),
s as (select *, -sep as ns, cv_occupancy_overlap_integral_3s as ov from b), {stats_sql(['ns', 'ov', 'sep'])}"""


@query("BS4_forecast", f"""
with {FC_SQL} select sample_id, {r('sep')} as minimum_predicted_separation_3s_m, {r(norm_sql('ns'))} as cv_forecast_collision_risk, {r('ov')} as occupancy_overlap_integral_3s, {r(mean_sql([norm_sql('ns'), norm_sql('ov'), norm_sql('sep', True)]))} as forecast_risk_score from s, q""")
def bs4(spark, sf):
    return rounded(so.forecast_scores(features(spark, sf)).select("sample_id", "minimum_predicted_separation_3s_m", "cv_forecast_collision_risk", "occupancy_overlap_integral_3s", "forecast_risk_score"))


@query("BS5_baseline_scores", f"""
with c as (with {CRIT_SQL} select sample_id, {r(mean_sql([norm_sql('hw', True), norm_sql('thw', True), norm_sql('ttc', True), norm_sql('al'), norm_sql('la')]))} as commonroad_crime_risk_score from s, q),
d as (with {RSS_SQL} select sample_id, {r(mean_sql([norm_sql('nl'), norm_sql('nt')]))} as rss_danger_score from s, q),
e as (with {DRV_SQL} select sample_id, {r(mean_sql([norm_sql('nm'), norm_sql('nr'), norm_sql('tk', True), norm_sql('inf')]))} as drivability_risk_score from s, q),
f as (with {FC_SQL} select sample_id, {r(mean_sql([norm_sql('ns'), norm_sql('ov'), norm_sql('sep', True)]))} as forecast_risk_score from s, q)
select * from c join d using (sample_id) join e using (sample_id) join f using (sample_id)""")
def bs5(spark, sf):
    return rounded(so.baseline_scores(features(spark, sf)).select("sample_id", "commonroad_crime_risk_score", "rss_danger_score", "drivability_risk_score", "forecast_risk_score"))


# Feature rows of the score catalogue, one per event.
CAT_SQL = """ct as (select event_id, value / 500 as redi_actionability, case when event_id % 6 = 0 then null else (event_id * 7 % 100) / 100.0::double end as asr_cum_final, (event_id * 11 % 100) / 100.0::double as asr_cum_min, (event_id * 13 % 100) / 100.0::double as msr,
  (event_id * 17 % 90) / 90.0::double as comfort_asr, (event_id * 19 % 90) / 90.0::double as asr_slice_final, case when event_id % 5 = 0 then null else (event_id * 23 % 31) / 10.0::double end as ttad_s, (event_id * 29 % 50) / 10.0::double as collapse_rate_max_per_s,
  (event_id * 31 % 40) / 40.0::double as early_blocking_ratio, case when event_id % 7 = 0 then null else (event_id * 37 % 33) / 10.0::double end as time_to_first_conflict_s, value / 10 as current_min_distance_m, case when event_id % 3 = 0 then -1.0 else value / 20 end as current_ttc_s from events)"""


def catalog_rows(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    m = lambda a, b, c: k * a % b / float(c)
    return read(spark, sf, "events").select(
        "event_id", (v / 500).alias("redi_actionability"), F.when(k % 6 != 0, m(7, 100, 100)).alias("asr_cum_final"), m(11, 100, 100).alias("asr_cum_min"), m(13, 100, 100).alias("msr"), m(17, 90, 90).alias("comfort_asr"),
        m(19, 90, 90).alias("asr_slice_final"), F.when(k % 5 != 0, m(23, 31, 10)).alias("ttad_s"), m(29, 50, 10).alias("collapse_rate_max_per_s"), m(31, 40, 40).alias("early_blocking_ratio"),
        F.when(k % 7 != 0, m(37, 33, 10)).alias("time_to_first_conflict_s"), (v / 10).alias("current_min_distance_m"), F.when(k % 3 == 0, -1.0).otherwise(v / 20).alias("current_ttc_s"))


@query("BS6_score_catalog", f"""
with {CAT_SQL}, s as (select *, 1 - asr_cum_final as l1, 1 - asr_cum_min as l2, 1 - comfort_asr as l3, case when current_ttc_s >= 0 then current_ttc_s end as tv from ct), {stats_sql(['redi_actionability', 'l1', 'l2', 'l3', 'ttad_s', 'time_to_first_conflict_s', 'collapse_rate_max_per_s', 'early_blocking_ratio', 'current_min_distance_m', 'tv'])},
n as (select event_id, coalesce({norm_sql('redi_actionability')}, 0) a, coalesce({norm_sql('l1')}, 0) b, coalesce({norm_sql('l2')}, 0) c, coalesce({norm_sql('l3')}, 0) d, coalesce({norm_sql('ttad_s', True)}, 0) e, coalesce({norm_sql('time_to_first_conflict_s', True)}, 0) f,
  coalesce({norm_sql('collapse_rate_max_per_s')}, 0) g, coalesce({norm_sql('early_blocking_ratio')}, 0) h, coalesce({norm_sql('current_min_distance_m', True)}, 0) i, coalesce({norm_sql('tv', True)}, 0) j from s, q)
select event_id, {r('a')} as "REDI_actionability", {r('b')} as "ASR_cum_inverse", {r('c')} as "ASR_cum_min_inverse", {r('d')} as "comfort_ASR_inverse", {r('e')} as "TTAD_inverse", {r('f')} as time_to_first_conflict_inverse, {r('g')} as collapse_rate_max, {r('h')} as early_blocking,
  {r('i')} as distance_inverse, {r('j')} as "TTC_inverse", {r('(a + c + d + e + g + h) / 6')} as "ROF_v2_composite" from n""")
def bs6(spark, sf):
    return rounded(so.score_catalog(catalog_rows(spark, sf), ["event_id"]))


@query("BS7_composite_scores", f"""
with {CAT_SQL}, cap as (select max(current_ttc_s) filter (current_ttc_s >= 0) + 10 as tc, max(ttad_s) + 1 as td, max(time_to_first_conflict_s) + 1 as tf from ct),
s as (select event_id, -current_min_distance_m as di, -case when current_ttc_s >= 0 then current_ttc_s else tc end as ti, redi_actionability as re, 1 - coalesce(asr_cum_final, msr) as ai, -coalesce(ttad_s, td) as ta, collapse_rate_max_per_s as co, -coalesce(time_to_first_conflict_s, tf) as fi, early_blocking_ratio as eb from ct, cap),
{stats_sql(['re', 'ai', 'ta', 'co', 'fi', 'eb'])}
select event_id, {r('di')} as distance_inverse, {r('ti')} as "TTC_inverse", {r('ai')} as "ASR_cum_inverse", {r('ta')} as "TTAD_inverse", {r(mean_sql([norm_sql(c) for c in ('re', 'ai', 'ta', 'co')]))} as "ROF_v2_composite", {r(mean_sql([norm_sql(c) for c in ('re', 'ta', 'co')]))} as "ROF_v2_no_asr_composite",
  {r(mean_sql([norm_sql(c) for c in ('ta', 'co', 'fi', 'eb')]))} as temporal_composite from s, q""")
def bs7(spark, sf):
    return rounded(so.composite_scores(catalog_rows(spark, sf)).select("event_id", "distance_inverse", "TTC_inverse", "ASR_cum_inverse", "TTAD_inverse", "ROF_v2_composite", "ROF_v2_no_asr_composite", "temporal_composite"))


@query("BS8_cv_composite", f"""
select event_id, {r("0.5 * coalesce(case when event_id % 4 != 0 then value / 500 end, 0) + 0.3 * (event_id * 7 % 100) / 100.0::double + 0.2 * (event_id * 11 % 100) / 100.0::double")} as cv_composite from events""")
def bs8(spark, sf):
    k = F.col("event_id")
    df = read(spark, sf, "events").select("event_id", F.when(k % 4 != 0, F.col("value") / 500).alias("cv_rcr"), (k * 7 % 100 / 100.0).alias("cv_c_time"), (k * 11 % 100 / 100.0).alias("cv_c_density"))
    return rounded(df.select("event_id", so.cv_composite(df).alias("cv_composite")))


@query("BS9_availability", f"""
with a as (select 'HW' as metric, o_orderstatus != 'P' as ok, case when o_orderstatus = 'P' then o_orderpriority else '' end as reason from orders union all select 'TTC', o_orderkey % 4 != 0, '' from orders),
c as (select metric, reason, count(*) n, sum(ok::int) ok from a group by 1, 2)
select metric, sum(n)::bigint as n_rows, sum(ok)::bigint as n_available, {r('sum(ok) / sum(n)')} as available_fraction, coalesce(arg_max(reason, {{'n': n, 'r': reason}}) filter (reason != ''), '') as unavailable_reason from c group by 1""")
def bs9(spark, sf):
    o = read(spark, sf, "orders")
    df = o.select(F.col("o_totalprice").alias("HW"), (F.col("o_orderstatus") != "P").alias("HW_available"), F.col("o_orderpriority").alias("HW_unavailable_reason"), F.when(F.col("o_orderkey") % 4 != 0, 1.0).alias("TTC"))
    return rounded(so.availability(df, ["HW", "TTC"]))


@query("BS10_best_by_family", f"""
with {SCORED_SQL}, long as (select s.score_name, s.score, y from scored, lateral (values ('score', score), ('qty', qty), ('disc', disc), ('tax', tax)) s(score_name, score)), {curve_sql('score_name', 'long')},
m as (select score_name, {AUPRC} as auprc, case when score_name in ('score', 'qty') then 'size' else 'rate' end as family from cum group by 1)
select family, arg_max(score_name, auprc) as best_score, {r('max(auprc)')} as auprc, count(*) as n_scores from m group by 1""")
def bs10(spark, sf):
    from feaslens.catalog.base import scored_rows
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("score")) for s in ("score", "qty", "disc", "tax")])).alias("p")
    table = metrics.auprc(scored_rows(spark, sf).select("y", pairs).select("y", "p.*"), "y", "score", ["score_name"])
    fam = spark.createDataFrame([("score", "size"), ("qty", "size"), ("disc", "rate"), ("tax", "rate")], "score_name string, family string")
    return rounded(so.best_by_family(table, fam))


@query("OC10_OC11_OC12_redi", f"""
with s as (select event_id, case when event_id % 4 = 0 then null else value / 500 end as csd, value / 600 as cs, (event_id * 7 % 100) / 100.0::double as ct, (event_id * 11 % 100) / 100.0::double as g, (event_id * 13 % 100) / 100.0::double as oe, case when event_id % 3 = 0 then null else (event_id * 17 % 100) / 100.0::double end as cm,
  (event_id * 19 % 100) / 100.0::double as ac, (event_id * 23 % 120) / 100.0::double - 0.1 as cf, (event_id * 29 % 30) / 10.0::double as cr, (event_id * 31 % 32) / 10.0::double as td from events),
d as (select *, greatest(0, least(1, 0.7 * g + 0.3 * oe)) as cd, coalesce(csd, cs) as sp, greatest(0, least(1, 1 - ac)) as cum from s),
e as (select *, greatest(0, least(1, (0.4 * sp + 0.2 * ct + 0.1 * cd) / 0.7)) as no_msr, greatest(0, least(1, 0.5 * cum + 0.5 * greatest(cum, greatest(0, least(1, 1 - td / 3.1))))) as act from d),
f as (select *, case when cm is not null then greatest(0, least(1, 0.4 * sp + 0.2 * ct + 0.3 * cm + 0.1 * cd)) else no_msr end as full_, greatest(0, least(1, (0.2 * sp + 0.15 * ct + 0.25 * act + 0.15 * case when cf >= 0 then greatest(0, least(1, 1 - cf)) else cum end + 0.15 * greatest(0, least(1, cr)) + 0.1 * cd) / 1.0)) as ra from e)
select event_id, {r('cd')} as c_density, {r('no_msr')} as redi_no_msr, {r('full_')} as redi_full, {r('ra')} as redi_actionability, {r('ra - full_')} as redi_actionability_delta from f""")
def oc11(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    m = lambda a, b, c: k * a % b / float(c)
    df = read(spark, sf, "events").select(
        "event_id", F.when(k % 4 != 0, v / 500).alias("c_space_drv"), (v / 600).alias("c_space"), m(7, 100, 100).alias("c_time"), so.density_term(m(11, 100, 100), m(13, 100, 100)).alias("c_density"), F.when(k % 3 != 0, m(17, 100, 100)).alias("c_maneuver"),
        m(19, 100, 100).alias("asr_cum_final"), (m(23, 120, 100) - 0.1).alias("comfort_asr"), m(29, 30, 10).alias("collapse_rate_max_per_s"), m(31, 32, 10).alias("ttad_s"))
    return rounded(so.with_redi(df).select("event_id", "c_density", "redi_no_msr", "redi_full", "redi_actionability", "redi_actionability_delta"))
