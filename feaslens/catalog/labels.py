"""Label rule, candidate aggregate and taxonomy queries over line items (a line item is a candidate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog.base import query, r, read, rounded
from feaslens.operators import actions as ac
from feaslens.operators import labels as lb

CAND_SQL = """cd as (select l_orderkey::varchar as sample_id, l_linenumber * 1000000 + l_partkey as candidate_id, case when l_linenumber % 2 = 0 then 'hard_brake' else 'keep_speed' end as longitudinal_profile, 'lat' || l_linenumber as lateral_profile,
  l_extendedprice as action_cost, l_discount <= 0.02 as feasible, l_tax >= 0.05 as collision_flag, l_quantity > 40 as lane_buffer_flag, l_quantity < 4 as progress_flag, l_returnflag = 'R' as kinematic_flag,
  case when l_discount > 0.02 then l_tax * 10 end as first_failure_time_s, case when l_discount <= 0.02 then 'no_failure' when l_tax >= 0.05 then 'Collision' when l_quantity > 40 then 'lane_buffer' when l_linenumber = 7 then 'no_route_found' else 'kinematic' end as failure_reason,
  (l_linenumber % 3)::int as initial_overlap_count from lineitem)"""


def candidate_rows(spark, sf):
    li = read(spark, sf, "lineitem")
    bad = F.col("l_discount") > 0.02
    return li.select(
        F.col("l_orderkey").cast("string").alias("sample_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("candidate_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "hard_brake").otherwise("keep_speed").alias("longitudinal_profile"), F.concat(F.lit("lat"), F.col("l_linenumber")).alias("lateral_profile"),
        F.col("l_extendedprice").alias("action_cost"), (~bad).alias("feasible"), (F.col("l_tax") >= 0.05).alias("collision_flag"), (F.col("l_quantity") > 40).alias("lane_buffer_flag"),
        (F.col("l_quantity") < 4).alias("progress_flag"), (F.col("l_returnflag") == "R").alias("kinematic_flag"), F.when(bad, F.col("l_tax") * 10).alias("first_failure_time_s"),
        F.when(~bad, "no_failure").when(F.col("l_tax") >= 0.05, "Collision").when(F.col("l_quantity") > 40, "lane_buffer").when(F.col("l_linenumber") == 7, "no_route_found").otherwise("kinematic").alias("failure_reason"),
        (F.col("l_linenumber") % 3).cast("int").alias("initial_overlap_count"))


@query("AC1_AC2_action_tables", """
select c_custkey, l.name as candidate, c_acctbal * l.cost as weighted from customer, (values ('keep', 0.0), ('mild_brake', 0.25), ('hard_brake', 1.0), ('left', 0.5), ('right', 0.5), ('brake_left', 1.25), ('brake_right', 1.25)) l(name, cost)""".replace("c_acctbal * l.cost", r("c_acctbal * l.cost::double")))
def ac12(spark, sf):
    lib = ac.action_library(spark, "base7").select(F.col("action").alias("candidate"), "cost")
    c = read(spark, sf, "customer").crossJoin(F.broadcast(lib))
    return rounded(c.select("c_custkey", "candidate", (F.col("c_acctbal") * F.col("cost")).alias("weighted")))


@query("AC9_feasibility_summary", f"""
with {CAND_SQL}, c as (select *, longitudinal_profile = 'keep_speed' as comfort, case when feasible then null else first_failure_time_s end as ft from cd)
select sample_id, sum((ft is null and comfort)::int)::bigint as comfort_feasible_count, sum(comfort::int)::bigint as comfort_total_count, {r('sum((ft is null and comfort)::int) / nullif(sum(comfort::int), 0)')} as comfort_feasible_ratio,
  sum((ft is null)::int)::bigint as emergency_feasible_count, count(*) as emergency_total_count, {r('sum((ft is null)::int) / count(*)')} as emergency_feasible_ratio, min(action_cost) filter (ft is null) as min_required_action_cost,
  {r('case when bool_or(ft is null) filter (comfort) then 3.0 else max(ft) filter (comfort) end')} as time_to_no_comfort_s, {r('case when bool_or(ft is null) then 3.0 else max(ft) end')} as time_to_no_emergency_s from c group by 1""")
def ac9(spark, sf):
    c = candidate_rows(spark, sf).withColumns({"comfort": F.col("longitudinal_profile") == "keep_speed", "failure_time_s": F.col("first_failure_time_s"), "cost": F.col("action_cost")})
    return rounded(lb.feasibility_summary(c, ["sample_id"], 3.0))


def rule_sql(name: str) -> str:
    crit, red = {"original": ("c = 0 and e > 0", "c < 0.25"), "moderate": ("c <= 0.25 or e <= 0.35", "c < 0.75 or e < 0.65"), "strict": ("c <= 0.5 or e <= 0.5", "c < 1 or e < 0.85"),
                 "emergency_sensitive": ("e <= 0.25", "e <= 0.6 or c <= 0.5"), "comfort_sensitive": ("c <= 0.25", "c <= 0.75"), "quantile_like": ("c <= 0.5 or e <= 0.4286", "c <= 0.75 or e <= 0.7143")}[name]
    return f"case when e <= 0 then 3 when {crit} then 2 when {red} then 1 else 0 end"


RATIO_SQL = "rt as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount * 10 as c, l_tax * 12.5 as e from lineitem)"


def ratio_rows(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", (F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * 12.5).alias("e"))


@query("AC10_AC11_label_rules", f"with {RATIO_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f'{rule_sql(n)} as {n}' for n in lb.LABEL_RULES)}, ({rule_sql('moderate')} >= 1)::int as degraded, ({rule_sql('moderate')} >= 2)::int as critical, ({rule_sql('moderate')} = 3)::int as infeasible from rt")
def ac10(spark, sf):
    rt = lb.with_actionability(ratio_rows(spark, sf), "moderate", "c", "e")
    return rt.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[lb.actionability_label("c", "e", n).alias(n) for n in lb.LABEL_RULES], F.col("actionability_binary_degraded").alias("degraded"),
                     F.col("actionability_binary_critical").alias("critical"), F.col("actionability_binary_infeasible").alias("infeasible"))


PLAN_SQL = f"""{CAND_SQL}, pl as (select sample_id, count(*) as candidate_count, sum(feasible::int)::bigint as ok, min({{'cost': action_cost, 'id': candidate_id, 'lo': longitudinal_profile, 'la': lateral_profile}}) filter (feasible) as b,
  bool_or(collision_flag) c, bool_or(lane_buffer_flag) l, bool_or(progress_flag) p, bool_or(kinematic_flag) k, min(first_failure_time_s) ff, sum(initial_overlap_count)::bigint io from cd group by 1)"""


@query("AC14_planner_labels", f"""
with {PLAN_SQL} select sample_id, (ok > 0)::int as planner_success, (ok = 0)::int as planner_failure, ok as feasible_candidate_count, candidate_count, {r('ok / candidate_count')} as feasible_candidate_ratio, b.cost as best_candidate_cost,
  coalesce(b.lo || '+' || b.la, '') as best_action_family, case when ok > 0 then 'no_failure' when c and l then 'collision_and_lane' when c and not (l or p or k) then 'collision_only' when l and not (c or p or k) then 'lane_buffer_only' when p and not (c or l or k) then 'progress_only'
  when k and not (c or l or p) then 'kinematic_only' else 'unknown' end as planner_failure_reason, {r('ff')} as first_failure_time_s_min, io as initial_overlap_count from pl""")
def ac14(spark, sf):
    return rounded(lb.planner_labels(candidate_rows(spark, sf)))


FLAG_SQL = f"""{CAND_SQL}, rs as (select sample_id, string_agg(v || ':' || n, ';' order by v) as s from (select sample_id, lower(failure_reason) v, count(*) n from cd group by 1, 2) group by 1),
fl as (select cd.sample_id, count(*) as candidate_rows, sum(feasible::int)::bigint as candidate_feasible_count, (sum(feasible::int) = 0)::int as candidate_all_invalid, (sum(feasible::int) > 0)::int as candidate_any_feasible, max(collision_flag::int) as collision_flag,
  max(lane_buffer_flag::int) as road_boundary_flag, max(lane_buffer_flag::int) as lane_buffer_flag, max(progress_flag::int) as progress_flag, max(kinematic_flag::int) as kinematic_flag, 0 as no_candidate_flag, max((failure_reason like '%no_route%')::int) as no_route_flag,
  0 as initial_invalid_flag, 0 as parser_error_flag, max(rs.s) as candidate_failure_reasons from cd join rs using (sample_id) group by 1)"""


@query("AC15_candidate_flags", f"with {FLAG_SQL} select * from fl")
def ac15(spark, sf):
    return lb.candidate_flags(candidate_rows(spark, sf))


TAX_SQL = f"""{FLAG_SQL}, pn as (select *, collision_flag + road_boundary_flag + kinematic_flag as nf from fl),
tx as (select *, case when candidate_any_feasible = 1 then 'no_failure' when no_route_flag = 1 then 'unknown_failure' when nf > 0 then 'known_failure' else 'unknown_failure' end as failure_taxonomy,
  case when candidate_any_feasible = 1 then 'no_failure:feasible_trajectory_exists' when no_route_flag = 1 then 'unknown_failure:no_route' when nf = 3 then 'known_failure:collision_road_boundary_and_kinematic'
    when nf = 2 then 'known_failure:' || case when kinematic_flag = 0 then 'collision_and_road_boundary' when road_boundary_flag = 0 then 'collision_and_kinematic' else 'road_boundary_and_kinematic' end
    when collision_flag = 1 then 'known_failure:collision_only' when road_boundary_flag = 1 then 'known_failure:road_boundary_only' when kinematic_flag = 1 then 'known_failure:kinematic_only' else 'unknown_failure:all_invalid_unattributed' end as failure_subtype from pn)"""


def taxonomy_rows(spark, sf):
    return lb.failure_taxonomy(lb.candidate_flags(candidate_rows(spark, sf)))


@query("AC16_failure_taxonomy", f"with {TAX_SQL} select sample_id, failure_taxonomy, failure_subtype, (failure_subtype = 'known_failure:kinematic_only')::int as taxonomy_secondary_sensitivity from tx")
def ac16(spark, sf):
    return taxonomy_rows(spark, sf).select("sample_id", "failure_taxonomy", "failure_subtype", "taxonomy_secondary_sensitivity")


FEW_SQL = f"""{CAND_SQL.replace("from lineitem)", "from lineitem where l_orderkey % 5 != 0)")}, every as (select o_orderkey::varchar as sample_id from orders),
ag as (select sample_id, count(*) as n, sum(feasible::int)::bigint as ok, bool_or(collision_flag) c, bool_or(lane_buffer_flag) l, bool_or(progress_flag) p, bool_or(kinematic_flag) k, bool_or(failure_reason like '%no_route%') nr from cd group by 1),
al as (select every.sample_id, coalesce(n, 0) as n, coalesce(ok, 0) as ok, coalesce(c, false) c, coalesce(l, false) l, coalesce(p, false) p, coalesce(k, false) k, coalesce(nr, false) nr from every left join ag using (sample_id)),
st as (select *, case when ok > 0 then 'no_failure:feasible_trajectory_exists' when nr then 'unknown_failure:no_route' when n = 0 then 'known_failure:no_valid_trajectory' when c and l and k then 'known_failure:collision_road_boundary_and_kinematic'
  when c and l then 'known_failure:collision_and_road_boundary' when c and k then 'known_failure:collision_and_kinematic' when l and k then 'known_failure:road_boundary_and_kinematic' when c then 'known_failure:collision_only' when l then 'known_failure:road_boundary_only'
  when k then 'known_failure:kinematic_only' else 'unknown_failure:all_invalid_unattributed' end as sub from al)"""


@query("AC14_AC18_samples_without_candidates", f"""
with {FEW_SQL} select sample_id, (ok > 0)::int as planner_success, n as candidate_count, (n = 0)::int as no_candidate_flag, case when ok > 0 then 'no_failure' else split_part(sub, ':', 2) end as planner_failure_reason,
  case when ok > 0 then 'no_failure' when n = 0 then 'no_candidate_generated' when c and l then 'collision_and_lane' when c and not (l or p or k) then 'collision_only' when l and not (c or p or k) then 'lane_buffer_only'
  when p and not (c or l or k) then 'progress_only' when k and not (c or l or p) then 'kinematic_only' else 'unknown' end as raw_planner_failure_reason, split_part(sub, ':', 1) as failure_taxonomy, sub as failure_subtype from st""")
def without_candidates(spark, sf):
    cand = candidate_rows(spark, sf).filter(F.col("sample_id").cast("bigint") % 5 != 0)
    every = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"))
    rows = lb.planner_labels(cand, samples=every).drop("initial_overlap_count").join(lb.candidate_flags(cand, samples=every), "sample_id")
    return lb.derived_reason(lb.failure_taxonomy(rows)).select("sample_id", "planner_success", "candidate_count", "no_candidate_flag", "planner_failure_reason", "raw_planner_failure_reason", "failure_taxonomy", "failure_subtype")


@query("AC17_legacy_taxonomy", """
select page_id, case when page_id % 2 = 0 then 'no_failure' when regexp_matches(lower(url), 'unknown|parser|parse_error|runtime|software|numerical|missing|validator|timeout_without|/fr/') then 'unknown_failure' else 'known_failure' end as tax from pages""")
def ac17(spark, sf):
    text = F.when(F.col("url").contains("/fr/"), F.concat(F.col("url"), F.lit(" runtime"))).otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", lb.legacy_taxonomy(F.col("page_id") % 2, text).alias("tax"))


@query("AC18_finalize_labels", f"""
with {TAX_SQL} select sample_id, o_custkey as ego_obstacle_id, (o_orderkey % 90)::varchar as time_step, (failure_taxonomy = 'known_failure')::int as known_failure, (failure_taxonomy = 'unknown_failure')::int as unknown_failure, (failure_taxonomy = 'no_failure')::int as no_failure,
  'lattice_base' as planner_family, 3.0 as horizon_s, 4.0 as lane_buffer_m, candidate_failure_reasons from tx join orders on o_orderkey::varchar = sample_id""")
def ac18(spark, sf):
    man = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_custkey").alias("ego_obstacle_id"), (F.col("o_orderkey") % 90).alias("current_time_step"))
    out = lb.finalize_labels(taxonomy_rows(spark, sf), man)
    return out.select("sample_id", "ego_obstacle_id", "time_step", "known_failure", "unknown_failure", "no_failure", "planner_family", "horizon_s", "lane_buffer_m", "candidate_failure_reasons")


MODES = ", ".join(f"('{m}', {i})" for i, m in enumerate(lb.AUDIT_MODES))
AUDIT_SQL = f"""au as (select l_orderkey as sample_id, m.mode as checked_mode, (l_partkey * 7 + l_linenumber * 13 + m.i * 5) % 10 >= 7 as feasible, case when (l_partkey * 7 + l_linenumber * 13 + m.i * 5) % 10 >= 7 then 'no_failure' when l_linenumber % 2 = 0 then 'map_violation' else 'oracle_future_collision' end as reason
  from lineitem, (values {MODES}) m(mode, i)),
ct as (select sample_id, {', '.join(f"sum((checked_mode = '{m}' and feasible)::int)::bigint as n{i}" for i, m in enumerate(lb.AUDIT_MODES))} from au group by 1),
tp as (select sample_id, arg_min(reason, {{'n': -n, 'r': reason}}) as reason from (select sample_id, reason, count(*) n from au where checked_mode = 'original_oracle_map' and reason != 'no_failure' group by 1, 2) group by 1),
sm as (select o_orderkey as sample_id, o_orderpriority as case_category, least(substr(o_orderpriority, 1, 1)::int - 1, 3) as lab, coalesce(n0, 0) n0, coalesce(n1, 0) n1, coalesce(n2, 0) n2, coalesce(n3, 0) n3, coalesce(tp.reason, 'no_failure') as reason
  from orders left join ct on o_orderkey = ct.sample_id left join tp on o_orderkey = tp.sample_id)"""


def audit_rows(spark, sf):
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i")) for i, m in enumerate(lb.AUDIT_MODES)])).alias("q")
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), "l_partkey", "l_linenumber", modes)
    ok = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13 + F.col("q.i") * 5) % 10 >= 7
    acts = li.select("sample_id", F.col("q.m").alias("checked_mode"), ok.alias("feasible"),
                     F.when(ok, "no_failure").when(F.col("l_linenumber") % 2 == 0, "map_violation").otherwise("oracle_future_collision").alias("unsafe_reason_primary"))
    cases = read(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("case_category"),
                                             F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3)).alias("actionability_label_id"))
    return lb.audit_summary(acts, cases)


@query("AC21_audit_summary", f"""
with {AUDIT_SQL} select sample_id, n0 = 0 and n2 > 0 as map_sensitive_flag, n0 = 0 and n1 > 0 as initial_time_sensitive_flag, n0 = 0 and n3 > 0 as obstacle_prediction_sensitive_flag, lab >= 2 and n0 = 0 and greatest(n1, n2, n3) >= 3 as suspicious_label_flag,
  reason as dominant_unsafe_reason_original from sm""")
def ac21(spark, sf):
    return audit_rows(spark, sf).select("sample_id", "map_sensitive_flag", "initial_time_sensitive_flag", "obstacle_prediction_sensitive_flag", "suspicious_label_flag", "dominant_unsafe_reason_original")


@query("AC21_audit_fractions", f"""
with {AUDIT_SQL} select case_category, count(*) as n_samples, {r('avg((n0 = 0 and n2 > 0)::int)')} as fraction_map_sensitive, {r('avg((n0 = 0 and n1 > 0)::int)')} as fraction_initial_time_sensitive, {r('avg((n0 = 0 and n3 > 0)::int)')} as fraction_obstacle_prediction_sensitive,
  {r('avg((lab >= 2 and n0 = 0 and greatest(n1, n2, n3) >= 3)::int)')} as fraction_suspicious_label, sum((reason = 'map_violation')::int)::bigint as dominant_reason_map_violation_count, sum((reason = 'no_failure')::int)::bigint as dominant_reason_no_failure_count from sm group by 1""")
def ac21b(spark, sf):
    return rounded(lb.audit_fractions(audit_rows(spark, sf), "case_category", ["map_violation", "no_failure"]))


@query("AC22_self_leakage", """
select l_orderkey as sample_id, max(case when l_linenumber = 1 then l_suppkey end) as ego_id, coalesce(sum((l_linenumber != 1 and l_suppkey = e)::int), 0)::bigint as leaked_rows, coalesce(sum((l_linenumber != 1 and l_suppkey = e)::int), 0) > 0 as self_leakage
from lineitem left join (select l_orderkey as k, max(l_suppkey) as e from lineitem where l_linenumber = 1 group by 1) on l_orderkey = k group by 1""")
def ac22(spark, sf):
    a = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_suppkey").alias("agent_id"), (F.col("l_linenumber") == 1).alias("is_ego"))
    return lb.self_leakage(a)


@query("J2_merge_scores_labels", f"""
with {TAX_SQL} select sample_id, o_totalprice as score, o_custkey::varchar as scenario_id, c_mktsegment as source_hint, failure_taxonomy, (failure_taxonomy = 'known_failure')::int as known_failure
from orders join tx on o_orderkey::varchar = sample_id left join customer on c_custkey = o_custkey""")
def j2(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    scores = o.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_custkey").cast("string").alias("scenario_id"), F.col("o_totalprice").alias("score"))
    man = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("source_hint"))
    out = lb.merge_scores_labels(scores, lb.candidate_flags(candidate_rows(spark, sf)), man)
    return out.select("sample_id", "score", "scenario_id", "source_hint", "failure_taxonomy", "known_failure")
