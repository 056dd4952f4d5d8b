"""Matching, lead-time and case queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog.base import query, r, read, rounded
from feaslens.catalog.columns import hash_sql
from feaslens.operators import leadtime as lt
from feaslens.operators import matching as mt
from feaslens.operators import metrics

# Matching rows: one per order; distance, time, speed and agents from price, date and keys.
MATCH_SQL = """mt as (
  select o_orderkey as id, (o_orderstatus = 'F')::int as y, o_totalprice / 5000 as current_min_distance_m,
         case when o_orderkey % 3 = 0 then -1.0 else (o_custkey % 70) / 10.0 end as current_ttc_s,
         (o_orderkey % 97)::double as ego_speed_kph, (o_custkey % 13)::double as agent_count, o_totalprice as s1, (o_custkey % 50)::double as s2
  from orders)"""


def match_rows(spark, sf):
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 5000).alias("current_min_distance_m"),
        F.when(F.col("o_orderkey") % 3 == 0, -1.0).otherwise((F.col("o_custkey") % 70) / 10.0).alias("current_ttc_s"),
        (F.col("o_orderkey") % 97).cast("double").alias("ego_speed_kph"), (F.col("o_custkey") % 13).cast("double").alias("agent_count"),
        F.col("o_totalprice").alias("s1"), (F.col("o_custkey") % 50).cast("double").alias("s2"))


def caliper_sql(setting: mt.Setting) -> str:
    rule = {"": "true", "finite": "{s}.current_ttc_s >= 0", "none": "{s}.current_ttc_s < 0", "large_or_none": "({s}.current_ttc_s < 0 or {s}.current_ttc_s > 3.0)"}[setting.ttc_rule]
    gaps = [f"(n.{c} / {w}::double - p.{c} / {w}::double)" for c, w in setting.calipers]
    d2 = " + ".join(f"{g} * {g}" for g in gaps)
    ok = " and ".join(f"abs({g}) <= 1.0" for g in gaps)
    rough = " and ".join(f"n.{c} between p.{c} - {w * 1.01} and p.{c} + {w * 1.01}" for c, w in setting.calipers)
    return f"""select '{setting.name}' as setting_name, '{setting.family}' as family, p.id as pos_id, min({{'d2': {d2}, 'nid': n.id}}) as best
from mt p join mt n on p.y = 1 and n.y = 0 and {rough} and {ok} where {rule.format(s='p')} and {rule.format(s='n')} group by p.id"""


def _caliper(setting: mt.Setting):
    @query(f"J4_caliper_{setting.name}", f"""
with {MATCH_SQL}, b as ({caliper_sql(setting)})
select setting_name, family, pos_id, best.nid as neg_id, {r('sqrt(best.d2)')} as match_distance_z from b""")
    def run(spark, sf):
        return rounded(mt.caliper_match(match_rows(spark, sf), "id", "y", setting))


for _s in mt.SETTINGS:
    _caliper(_s)


@query("J3_nn_match", f"""
with t as (select c_custkey as id, (c_mktsegment = 'BUILDING')::int as y, c_acctbal as a, c_nationkey::double as b from customer),
s as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb from t),
z as (select id, y, (a - ma) / sa as a, (b - mb) / sb as b from t, s),
d as (select p.id as pos_id, min({{'d2': (n.a - p.a) * (n.a - p.a) + (n.b - p.b) * (n.b - p.b), 'nid': n.id}}) as best from z p join z n on p.y = 1 and n.y = 0 group by 1)
select pos_id, best.nid as neg_id, {r('sqrt(best.d2)')} as match_distance_z from d""")
def j3(spark, sf):
    t = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"),
                                           F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return rounded(mt.nn_match(t, "id", "y", ["a", "b"]))


BIN_SQL = """least(greatest(floor(current_min_distance_m / 3), 0), 50)::bigint || '|' || case when current_ttc_s < 0 then 'no' else (least(greatest(floor(current_ttc_s / 2), 0), 50)::bigint)::varchar end
  || '|' || least(greatest(floor(ego_speed_kph / 10), 0), 30)::bigint || '|' || least(greatest(floor(agent_count / 10), 0), 20)::bigint"""
PAIRS_SQL = f"""{MATCH_SQL}, rk as (select id, y, s1, s2, current_min_distance_m, ego_speed_kph, {BIN_SQL} as match_bin from mt),
rn as (select *, row_number() over (partition by match_bin, y order by {hash_sql("'42|' || id")}, id) as ix from rk),
pairs as (select p.match_bin, p.id as pos_id, n.id as neg_id, p.s1 p1, n.s1 n1, p.s2 p2, n.s2 n2, p.current_min_distance_m pd, n.current_min_distance_m nd, p.ego_speed_kph pe, n.ego_speed_kph ne
  from rn p join rn n on p.match_bin = n.match_bin and p.ix = n.ix and p.y = 1 and n.y = 0)"""


def bin_pairs(spark, sf):
    rows = match_rows(spark, sf).withColumn("b", mt.relaxed_bin("current_min_distance_m", "current_ttc_s", "ego_speed_kph", "agent_count"))
    return mt.bin_match(rows, "id", "y", "b", 42)


@query("J5_bin_match", f"with {PAIRS_SQL} select match_bin, pos_id, neg_id from pairs")
def j5(spark, sf):
    return bin_pairs(spark, sf)


@query("J6_evaluate_pairs", f"""
with {PAIRS_SQL}, l as (select s.score_name, s.p, s.n, neg_id from pairs, lateral (values ('s1', p1, n1), ('s2', p2, n2)) s(score_name, p, n)),
mem as (select score_name, 1 as y, p as score from l union all select score_name, 0, n from l),
cum as (select score_name, pos, neg, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over (partition by score_name) P, sum(neg) over (partition by score_name) N
  from (select score_name, score, sum(y) pos, sum(1 - y) neg from mem group by 1, 2) window w as (partition by score_name order by score desc)),
a as (select score_name, sum(pos * (N - fp + neg / 2.0)) / (max(P)::double * max(N)) as au, sum(pos * tp / (tp + fp)) / max(P) as ap from cum group by 1)
select l.score_name, count(*) as n_pairs, {r('avg((p > n)::int)')} as win_rate, {r('avg((p = n)::int)')} as tie_rate, {r('avg((p < n)::int)')} as loss_rate, {r('avg(p - n)', 3)} as mean_difference,
  {r('max(au)')} as pair_auroc, {r('max(ap)')} as pair_auprc, count(distinct neg_id) as unique_negatives from l join a using (score_name) group by 1""")
def j6(spark, sf):
    out = mt.evaluate_pairs(bin_pairs(spark, sf), match_rows(spark, sf), "id", ["s1", "s2"])
    return rounded(out.withColumn("mean_difference", F.bround("mean_difference", 3)))


@query("J7_balance", f"""
with {PAIRS_SQL}, l as (select s.variable, s.p, s.n from pairs, lateral (values ('current_min_distance_m', pd, nd), ('ego_speed_kph', pe, ne)) s(variable, p, n))
select variable, {r('avg(p)')} as pos_mean, {r('avg(n)')} as neg_mean, {r('avg(abs(p - n))')} as mean_abs_diff, {r('quantile_cont(abs(p - n), 0.95)')} as p95_abs_diff from l group by 1""")
def j7(spark, sf):
    return rounded(mt.balance(bin_pairs(spark, sf), match_rows(spark, sf), "id", ["current_min_distance_m", "ego_speed_kph"]))


# Rolling frames: one key per user and day, seconds within the day, y = error event.
FRAMES_SQL = """fr as (select user_id || '_' || strftime(ts, '%Y%m%d') as scenario_id, event_id, epoch(ts) - epoch(date_trunc('day', ts)) as t, value as score, (event_type = 'error')::int as y, ts from events)"""
ONSET_SQL = f"""{FRAMES_SQL}, o1 as (select *, lag(y) over w as prev, first(t) over w as t0 from fr window w as (partition by scenario_id order by t, event_id)),
o2 as (select scenario_id, arg_min(t, t) filter (prev = 0 and y = 1) as hit, min(t0) as t0, max(t) as t1, max(y) = 1 as has_any_event, count(*) as n_frames from o1 group by 1),
onset as (select scenario_id, coalesce(hit - t0 >= 600, false) as has_valid_onset, case when hit - t0 >= 600 then hit end as event_time_s, coalesce(hit - t0, t1 - t0) as pre_event_duration_s, has_any_event, n_frames from o2)"""


def frames(spark, sf):
    ts = F.col("ts")
    return read(spark, sf, "events").select(
        F.concat_ws("_", F.col("user_id"), F.date_format(ts, "yyyyMMdd")).alias("scenario_id"), "event_id",
        ((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.date_trunc("day", ts).cast("timestamp"))) / 1e6).alias("t"),
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y"), ts)


def onsets(spark, sf):
    return lt.event_onset(frames(spark, sf), "scenario_id", ["t", "event_id"], "t", "y", 600.0)


@query("J9_event_onset", f"with {ONSET_SQL} select scenario_id, has_valid_onset, {r('event_time_s')} as event_time_s, {r('pre_event_duration_s')} as pre_event_duration_s, has_any_event, n_frames from onset")
def j9(spark, sf):
    return rounded(onsets(spark, sf))


LEAD_SQL = f"""{ONSET_SQL}, th as (select unnest([0.01, 0.05])::double as target_fpr, unnest([quantile_cont(score, 0.99), quantile_cont(score, 0.95)]) as threshold from fr where y = 0),
ld as (select fr.scenario_id, target_fpr, threshold, has_valid_onset, event_time_s, pre_event_duration_s, has_any_event,
  min(t) filter (score >= threshold and t < event_time_s) as first_alert, bool_or(score >= threshold) as any_alert from fr join onset using (scenario_id), th group by all)"""


def leads(spark, sf):
    f = frames(spark, sf)
    thr = metrics.fpr_threshold(f, "y", "score", (0.01, 0.05)).select(F.explode(F.array(
        F.struct(F.lit(0.01).alias("target_fpr"), F.col("threshold_at_1pct_fpr").alias("threshold")),
        F.struct(F.lit(0.05).alias("target_fpr"), F.col("threshold_at_5pct_fpr").alias("threshold")))).alias("x")).select("x.*")
    return lt.lead_time(f, onsets(spark, sf), thr, "scenario_id", "t", "score")


@query("J10_lead_time", f"""
with {LEAD_SQL} select scenario_id, target_fpr, {r('threshold')} as threshold, has_any_event as has_event, has_valid_onset, {r('event_time_s')} as event_time_s, {r('pre_event_duration_s')} as pre_event_duration_s,
  {r('first_alert')} as first_pre_event_alert_time_s, {r('event_time_s - first_alert')} as lead_time_s, has_valid_onset and first_alert is null as missed_event, not has_any_event and any_alert as false_alert_non_event from ld""")
def j10(spark, sf):
    return rounded(leads(spark, sf))


@query("J11_lead_time_summary", f"""
with {LEAD_SQL} select target_fpr, sum(has_valid_onset::int)::bigint as n_event_scenarios, sum((has_any_event and not has_valid_onset)::int)::bigint as n_invalid_event_scenarios,
  sum((not has_any_event)::int)::bigint as n_non_event_scenarios, {r('avg(event_time_s - first_alert)', 4)} as mean_lead_time_s, {r('avg(case when has_valid_onset then (first_alert is null)::int end)')} as missed_event_rate,
  {r('avg(case when not has_any_event then any_alert::int end)')} as false_alert_non_event_rate, {r('median(event_time_s - first_alert)', 4)} as median_lead_time_s from ld group by 1""")
def j11(spark, sf):
    out = lt.lead_time_summary(leads(spark, sf), ["target_fpr"])
    return rounded(out.withColumns({c: F.bround(c, 4) for c in ("mean_lead_time_s", "median_lead_time_s")}))


# Two scores; thresholds from 35 % of the scenarios, lead times on the others.
HELD_SQL = f"""{ONSET_SQL}, keys as (select scenario_id, row_number() over (order by {hash_sql("'42|' || scenario_id")}, scenario_id) <= greatest(1, round_even(count(*) over () * 0.35, 0)) as cal from (select distinct scenario_id from fr)),
lg as (select fr.scenario_id, t, fr.y, cal, s.score_name, s.score from fr join keys using (scenario_id), lateral (values ('value', fr.score), ('minute', (event_id * 37 % 1009)::double)) s(score_name, score)),
th as (select score_name, unnest([0.01, 0.05])::double as target_fpr, unnest([quantile_cont(score, 0.99) filter (y = 0), quantile_cont(score, 0.95) filter (y = 0)]) as threshold from lg where cal group by score_name),
ld as (select lg.scenario_id, score_name, target_fpr, threshold, has_valid_onset, event_time_s, pre_event_duration_s, has_any_event,
  min(t) filter (score >= threshold and t < event_time_s) as first_alert, bool_or(score >= threshold) as any_alert from lg join onset using (scenario_id) join th using (score_name) where not cal group by all)"""


def held_out_leads(spark, sf):
    f = frames(spark, sf).withColumn("value", F.col("score")).withColumn("minute", (F.col("event_id") * 37 % 1009).cast("double"))
    return lt.calibrated_lead_time(f, onsets(spark, sf), "scenario_id", "t", "y", ["value", "minute"])


@query("J10_lead_time_held_out", f"""
with {HELD_SQL} select scenario_id, score_name, target_fpr, {r('threshold')} as threshold, has_any_event as has_event, has_valid_onset, {r('event_time_s')} as event_time_s, {r('pre_event_duration_s')} as pre_event_duration_s,
  {r('first_alert')} as first_pre_event_alert_time_s, {r('event_time_s - first_alert')} as lead_time_s, has_valid_onset and first_alert is null as missed_event, not has_any_event and any_alert as false_alert_non_event from ld""")
def j10_held_out(spark, sf):
    return rounded(held_out_leads(spark, sf))


@query("J11_lead_time_summary_held_out", f"""
with {HELD_SQL} select score_name, target_fpr, sum(has_valid_onset::int)::bigint as n_event_scenarios, sum((has_any_event and not has_valid_onset)::int)::bigint as n_invalid_event_scenarios,
  sum((not has_any_event)::int)::bigint as n_non_event_scenarios, {r('avg(event_time_s - first_alert)', 4)} as mean_lead_time_s, {r('avg(case when has_valid_onset then (first_alert is null)::int end)')} as missed_event_rate,
  {r('avg(case when not has_any_event then any_alert::int end)')} as false_alert_non_event_rate, {r('median(event_time_s - first_alert)', 4)} as median_lead_time_s from ld group by 1, 2""")
def j11_held_out(spark, sf):
    out = lt.lead_time_summary(held_out_leads(spark, sf), ["score_name", "target_fpr"])
    return rounded(out.withColumns({c: F.bround(c, 4) for c in ("mean_lead_time_s", "median_lead_time_s")}))


@query("J12_align_to_event", f"""
with {ONSET_SQL} select scenario_id, {r('t - event_time_s')} as time_to_event_s, score, y from fr join onset using (scenario_id)
where has_valid_onset and t - event_time_s between -7200 and 1800""")
def j12(spark, sf):
    return rounded(lt.align_to_event(frames(spark, sf), onsets(spark, sf), "scenario_id", "t", ["score", "y"], -7200.0, 1800.0))


CASE_SQL = """cs as (select o_orderkey as id, o_custkey, (o_orderstatus = 'F')::int as y, o_totalprice as enh, ((o_custkey * 7919 + o_orderkey) % 100003)::double as base,
  least(substr(o_orderpriority, 1, 1)::int - 1, 3) as original_label_id, (o_orderkey % 4)::int as actionability_label_id from orders),
th as (select quantile_cont(base, 0.95) filter (y = 0) b5, quantile_cont(base, 0.99) filter (y = 0) b1, quantile_cont(enh, 0.95) filter (y = 0) e5, quantile_cont(enh, 0.99) filter (y = 0) e1,
  median(base) filter (y = 1) bl, quantile_cont(enh, 0.75) filter (y = 1) eh from cs),
tg as (select cs.*, enh - base as score_delta, k.* from cs, th, lateral (values
  ('recovered_positive_at_5fpr', y = 1 and base < b5 and enh >= e5, enh - base), ('recovered_positive_at_1fpr', y = 1 and base < b1 and enh >= e1, enh - base),
  ('baseline_missed_enhanced_high_score', y = 1 and base <= bl and enh >= eh, enh - base), ('enhanced_false_positive_at_5fpr', y = 0 and base < b5 and enh >= e5, enh),
  ('baseline_false_positive_fixed', y = 0 and base >= b5 and enh < e5, base - enh), ('original_safe_but_actionability_critical', original_label_id in (0, 1) and actionability_label_id >= 2, enh),
  ('original_warning_emergency_but_high_actionability', original_label_id >= 2 and actionability_label_id = 0, base),
  ('infeasible_true_positive', y = 1 and enh >= e5, enh), ('infeasible_missed', y = 1 and enh < e5, -enh)) k(case_category, hit, sort_value)),
cases as (select * from (select *, row_number() over (partition by case_category order by sort_value desc, id) as case_rank from tg where hit) where case_rank <= 25)"""


def case_rows(spark, sf):
    o = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("enh"),
        ((F.col("o_custkey") * 7919 + F.col("o_orderkey")) % 100003).cast("double").alias("base"),
        F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3)).alias("original_label_id"), (F.col("o_orderkey") % 4).cast("int").alias("actionability_label_id"))
    return lt.select_cases(o, "y", "base", "enh", "id", 25)


@query("J13_select_cases", f"with {CASE_SQL} select case_category, case_rank, id, y, base, enh, {r('score_delta')} as score_delta from cases")
def j13(spark, sf):
    return rounded(case_rows(spark, sf).select("case_category", "case_rank", "id", "y", "base", "enh", "score_delta"))


@query("J14_case_summary", f"""
with {CASE_SQL}, o as (select case_category, string_agg(v || ':' || n, ';' order by v::varchar) s from (select case_category, original_label_id v, count(*) n from cases group by 1, 2) group by 1),
a as (select case_category, string_agg(v || ':' || n, ';' order by v::varchar) s from (select case_category, actionability_label_id v, count(*) n from cases group by 1, 2) group by 1)
select c.case_category, count(*) as count, max(o.s) as original_label_id_distribution, max(a.s) as actionability_label_id_distribution, {r('median(base)')} as base_median,
  {r('median(enh)')} as enh_median, {r('median(score_delta)')} as score_delta_median from cases c join o using (case_category) join a using (case_category) group by 1""")
def j14(spark, sf):
    return rounded(lt.case_summary(case_rows(spark, sf), "enh", medians=["base"]))


@query("J15_case_context", f"""
with {CASE_SQL} select case_category, id, c.o_custkey, coalesce(case when c_nationkey < 10 then c_mktsegment end, n_name) as segment, c_acctbal as balance
from cases c left join customer on c.o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def j15(spark, sf):
    c = read(spark, sf, "customer")
    first = c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    second = c.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("segment"), F.col("c_acctbal").alias("balance"))
    cases = case_rows(spark, sf).select("case_category", "id", "o_custkey")
    return lt.case_context(cases, "o_custkey", first, second, columns=["segment", "balance"])
