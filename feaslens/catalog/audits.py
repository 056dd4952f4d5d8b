"""Audit, agreement and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog import bootstrap as cb
from feaslens.catalog import scenes as sc
from feaslens.catalog.base import SCORED_SQL, query, r, read, rounded, scored_rows
from feaslens.catalog.labels import RATIO_SQL, TAX_SQL, ratio_rows, rule_sql, taxonomy_rows
from feaslens.catalog.matching import MATCH_SQL, match_rows
from feaslens.catalog.metrics import AUPRC, ORDINAL_SQL, bundle_cols, bundle_sql, curve_sql, ordinal_rows, strict
from feaslens.catalog.columns import hash_sql
from feaslens.catalog.scenes import DT, SAMPLES_SQL, distance_sql
from feaslens.catalog.tracks import normal_sql
from feaslens.operators import actions as ac
from feaslens.operators import audit as au
from feaslens.operators import bootstrap as bt
from feaslens.operators import labels as lb
from feaslens.operators import metrics as m
from feaslens.operators import samples as sm


@query("J1_merge_checked", "select o_orderkey, o_custkey, a.n, b.n as n_right from (select o_orderkey, o_custkey, o_totalprice as n from orders) a join (select l_orderkey as o_orderkey, count(*) as n from lineitem group by 1) b using (o_orderkey)")
def j1(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("n"))
    li = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return au.merge_checked(o, li, "o_orderkey", "one_to_one")


@query("AU1_cardinality", """
with o as (select o_custkey k, count(*) n from orders group by 1), c as (select c_custkey k, count(*) n from customer group by 1), e as (select user_id k, count(*) n from events group by 1),
j as (select 'orders' a, 'customer' b, o.n * c.n as x from o join c using (k) union all select 'orders', 'events', o.n * e.n from o join e using (k) union all select 'customer', 'events', c.n * e.n from c join e using (k))
select 'orders' as "table", '' as other, sum(n)::bigint as n_rows, count(*) as n_keys, (sum(n) - count(*))::bigint as n_duplicates from o union all select 'customer', '', sum(n)::bigint, count(*), (sum(n) - count(*))::bigint from c
union all select 'events', '', sum(n)::bigint, count(*), (sum(n) - count(*))::bigint from e union all select a, b, sum(x)::bigint, count(*), (sum(x) - count(*))::bigint from j group by 1, 2""")
def au1(spark, sf):
    t = {"orders": read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "customer": read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "events": read(spark, sf, "events").select(F.col("user_id").alias("k"))}
    return au.cardinality_audit(t, "k")


@query("AU4_future_validity", f"""
with {SAMPLES_SQL}, s as (select * from states where not is_ego)
select g as grain, v as value, count(*) as total_slots, sum(valid::int)::bigint as valid_slots, {r('avg(valid::int)')} as future_valid_rate, avg(valid::int) < 0.75 as low_validity
from (select 'sample_id' g, sample_id v, valid from s union all select 'k', k::varchar, valid from s union all select 'width', width::varchar, valid from s) group by 1, 2""")
def au4(spark, sf):
    return rounded(au.future_validity(sc.samples(spark, sf)[1], ["sample_id", "k", "width"]))


IMP_SQL = f"""{SAMPLES_SQL}, pi as (select sample_id, count(*) as total_future_slots, sum((not valid)::int)::bigint as invalid_future_slots, sum((not valid)::int)::bigint as imputed_future_slots, count(distinct case when not valid then agent_id end) as actors_with_invalid_future from states where not is_ego and k >= 1 group by 1),
pf as (select *, imputed_future_slots / total_future_slots as f from pi), pl as (select pf.*, (a.agent_id % 4)::int as label_id from pf join agents a on pf.sample_id = a.sample_id and a.is_ego)"""


def imputation(spark, sf):
    agents, states = sc.samples(spark, sf)
    labels = agents.filter("is_ego").select("sample_id", (F.col("agent_id") % 4).cast("int").alias("actionability_label_id"))
    return au.imputation_stats(ac.impute_future(agents, states, "cv_last_valid", DT), labels)


@query("AU5_imputation_by_label", f"""
with {IMP_SQL} select label_id, count(*) as n_samples, sum(total_future_slots)::bigint as total_future_slots, sum(invalid_future_slots)::bigint as invalid_future_slots, sum(imputed_future_slots)::bigint as imputed_future_slots, {r('avg(f)')} as mean_sample_imputed_fraction, {r('median(f)')} as median_sample_imputed_fraction from pl group by 1""")
def au5(spark, sf):
    return rounded(imputation(spark, sf)[1])


@query("AU5_imputation_top", f"with {IMP_SQL} select sample_id, total_future_slots, invalid_future_slots, imputed_future_slots, actors_with_invalid_future, {r('f')} as imputed_fraction from pf where f >= (select quantile_cont(f, 0.95) from pf)")
def au5b(spark, sf):
    return rounded(imputation(spark, sf)[2])


@query("AU6_label_shift", f"""
with {ORDINAL_SQL}, s as (select *, (o_custkey % 4)::int as orig from ord)
select metric, n as count, d as denominator, {r('n / nullif(d, 0)')} as fraction from (
select 'fraction_changed' as metric, sum((a != b)::int)::bigint n, count(*) d from s union all select 'fraction_map_critical_infeasible_to_nomap_high_reduced', sum((a >= 2 and b <= 1)::int)::bigint, sum((a >= 2)::int)::bigint from s
union all select 'fraction_map_infeasible_to_nomap_non_infeasible', sum((a = 3 and b != 3)::int)::bigint, sum((a = 3)::int)::bigint from s
union all select 'fraction_original_safe_map_critical_infeasible_to_nomap_high_reduced', sum((orig <= 1 and a >= 2 and b <= 1)::int)::bigint, sum((orig <= 1 and a >= 2)::int)::bigint from s)""")
def au6(spark, sf):
    return rounded(au.label_shift(ordinal_rows(spark, sf).withColumn("orig", F.col("o_custkey") % 4), "a", "b", "orig"))


@query("AU7_rule_sweep", f"""
with {RATIO_SQL}, rk as (select *, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as rx from rt),
lg as (select rx, u.rule_name, u.label from rk, lateral (values {', '.join(f"('{n}', {rule_sql(n)})" for n in lb.LABEL_RULES)}) u(rule_name, label)),
ry as (select *, rank() over (partition by rule_name order by label) + (count(*) over (partition by rule_name, label) - 1) / 2.0 as ry from lg),
a as (select rule_name, count(*) as n, avg((label = 0)::int) h, avg((label = 1)::int) d, avg((label = 2)::int) c, avg((label = 3)::int) i, corr(rx, ry) s from ry group by 1)
select rule_name, n, {r('h')} as high_fraction, {r('d')} as reduced_fraction, {r('c')} as critical_fraction, {r('i')} as infeasible_fraction, {r('s')} as spearman_current_min_distance_m,
  h between 0.3 and 0.8 and d >= 0.05 and c >= 0.02 and i between 0.002 and 0.15 and abs(s) < 0.6 as non_degenerate from a""")
def au7(spark, sf):
    return rounded(au.rule_sweep(ratio_rows(spark, sf).withColumn("o", F.lit(0)), "c", "e", "l_extendedprice", "o"))


@query("AU7_rule_tables", f"""
with {RATIO_SQL}, lg as (select l_linenumber % 4 as original_label_id, c, e, u.rule_name, u.label from rt, lateral (values {', '.join(f"('{n}', {rule_sql(n)})" for n in lb.LABEL_RULES)}) u(rule_name, label))
select rule_name, original_label_id, label as new_label_id, count(*) as count, {r('avg(c)')} as comfort_mean, {r('avg(e)')} as emergency_mean from lg group by 1, 2, 3""")
def au7b(spark, sf):
    return rounded(au.rule_tables(ratio_rows(spark, sf).withColumn("o", F.col("l_linenumber") % 4), "c", "e", "o"))


@query("AU8_ttc_missingness", f"""
with {MATCH_SQL}, t as (select case when id % 11 = 0 then null else current_ttc_s end as t from mt)
select 'valid_ttc' as category, sum(coalesce(t >= 0, false)::int)::bigint as count, {r('avg(coalesce(t >= 0, false)::int)')} as rate from t union all select 'invalid_or_no_closing_ttc', sum(coalesce(t < 0, false)::int)::bigint, {r('avg(coalesce(t < 0, false)::int)')} from t
union all select 'non_finite_ttc', sum((t is null)::int)::bigint, {r('avg((t is null)::int)')} from t""")
def au8(spark, sf):
    return rounded(au.ttc_missingness(match_rows(spark, sf).withColumn("current_ttc_s", F.when(F.col("id") % 11 != 0, F.col("current_ttc_s"))), "current_ttc_s"))


@query("AU8_ttc_strata", f"""
with {MATCH_SQL}, t as (select (id % 4)::int as l, current_min_distance_m as d, least(case when current_ttc_s >= 0 then current_ttc_s else 10 end, 10) as t from mt),
s as (select l, u.stratum_type, u.stratum from t, lateral (values ('distance_stratum', case when d <= 2 then 'lt2m' when d <= 5 then '2to5m' when d <= 10 then '5to10m' else 'ge10m' end), ('ttc_stratum', case when t <= 1 then 'lt1s' when t <= 3 then '1to3s' when t <= 10 then '3to10s' else 'no_or_ge10s' end)) u(stratum_type, stratum))
select stratum_type, stratum, count(*) as n, sum((l = 0)::int)::bigint as label_0_count, sum((l = 1)::int)::bigint as label_1_count, sum((l = 2)::int)::bigint as label_2_count, sum((l = 3)::int)::bigint as label_3_count from s group by 1, 2""")
def au8b(spark, sf):
    return au.ttc_strata(match_rows(spark, sf).withColumn("l", F.col("id") % 4), "current_ttc_s", "current_min_distance_m", "l")


SENS_SQL = f"""{MATCH_SQL}, sv as (select (id % 50)::varchar as scenario, (s2 % 4)::int as yy, u.variable, u.x from mt, lateral (values ('current_min_distance_m', current_min_distance_m), ('valid_ttc_only', case when current_ttc_s >= 0 then current_ttc_s end), ('no_ttc_as_category', case when current_ttc_s >= 0 then current_ttc_s else 999 end),
  ('capped_ttc_prespecified_10s', least(case when current_ttc_s >= 0 then current_ttc_s else 10 end, 10)), ('inverse_ttc_prespecified', 1 / greatest(case when current_ttc_s >= 0 then current_ttc_s else 10 end, 0.1)), ('legacy_sentinel', current_ttc_s)) u(variable, x)),
ok as (select * from sv where x is not null)"""


@query("AU8_ttc_sensitivity", f"""
with {SENS_SQL}, {cb.index_sql('variable', 'ok')}, {cb.draws_sql(cb.N, 'variable')},
rk as (select variable, scenario as g, rank() over (partition by variable order by x) + (count(*) over (partition by variable, x) - 1) / 2.0 - (count(*) over (partition by variable) + 1) / 2.0 as rx,
  rank() over (partition by variable order by yy) + (count(*) over (partition by variable, yy) - 1) / 2.0 - (count(*) over (partition by variable) + 1) / 2.0 as ry from ok),
mo as (select variable, g, count(*)::double w, sum(rx) a, sum(ry) b_, sum(rx * rx) aa, sum(ry * ry) bb, sum(rx * ry) ab from rk group by 1, 2),
ev as (select variable, b, weight * w w, weight * a a, weight * b_ b_, weight * aa aa, weight * bb bb, weight * ab ab from mo join weights using (variable, g) union all select variable, 0, w, a, b_, aa, bb, ab from mo),
s as (select variable, b, sum(w) w, sum(a) a, sum(b_) b_, sum(aa) aa, sum(bb) bb, sum(ab) ab from ev group by 1, 2), cr as (select variable, b, (ab / w - a / w * b_ / w) / sqrt((aa / w - (a / w) * (a / w)) * (bb / w - (b_ / w) * (b_ / w))) as value from s)
select variable, {r('max(case when b = 0 then value end)')} as spearman, {r('quantile_cont(case when b > 0 then value end, 0.025)')} as ci_low, {r('quantile_cont(case when b > 0 then value end, 0.975)')} as ci_high, count(case when b > 0 then value end) as n_bootstrap_valid from cr group by 1""")
def au8c(spark, sf):
    df = match_rows(spark, sf).withColumns({"l": F.col("s2") % 4, "sc": (F.col("id") % 50).cast("string")})
    return rounded(au.ttc_sensitivity(df, "current_ttc_s", "l", "current_min_distance_m", "sc", cb.N))


# Two taxonomies of the same order: from its first and second priority-like columns.
PAIR_SQL = """tp as (select o_orderkey::varchar as sample_id, o_custkey as scenario_id, case o_orderkey % 5 when 0 then 'known_failure' when 1 then 'unknown_failure' else 'no_failure' end as ta, case (o_orderkey * 7 + o_custkey) % 6 when 0 then 'known_failure' when 1 then 'unknown_failure' else 'no_failure' end as tb, o_orderpriority as sa, o_orderstatus as sb from orders)"""


def pair_rows(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tax = lambda x: F.when(x == 0, "known_failure").when(x == 1, "unknown_failure").otherwise("no_failure")
    return read(spark, sf, "orders").select(k.cast("string").alias("sample_id"), c.alias("scenario_id"), tax(k % 5).alias("ta"), tax((k * 7 + c) % 6).alias("tb"), F.col("o_orderpriority").alias("sa"), F.col("o_orderstatus").alias("sb"))


@query("AU9_taxonomy_agreement", f"""
with {PAIR_SQL}, f as (select ta = 'known_failure' x, tb = 'known_failure' y, ta = tb as same from tp), w as (select count(*)::double as matched_samples, sum(same::int)::double as taxonomy_agreement_count, avg(same::int) as taxonomy_agreement_rate, sum((x = y)::int)::double as known_failure_agreement_count, avg((x = y)::int) as known_failure_agreement_rate,
  sum(x::int)::double as base_known_failure_count, sum(y::int)::double as extended_known_failure_count, sum((x and not y)::int)::double as base_only_positives, sum((y and not x)::int)::double as extended_only_positives, sum((x and y)::int)::double as both_positive, sum((not x and not y)::int)::double as both_not_positive from f),
u as (unpivot w on columns(*) into name metric value value) select metric, {r('value')} as value from u""")
def au9(spark, sf):
    return rounded(au.taxonomy_agreement(pair_rows(spark, sf), "ta", "tb"))


@query("AU9_disagreement", f"""
with {PAIR_SQL}, lg as (select sa, sb, u.section, u.transition from tp, lateral (values ('taxonomy_transition', ta || ' -> ' || tb), ('positive_transition', case when ta = 'known_failure' and tb != 'known_failure' then 'base_only_positive' when ta != 'known_failure' and tb = 'known_failure' then 'extended_only_positive'
  when ta = 'known_failure' then 'positive_agreement' else 'negative_or_unknown_agreement' end)) u(section, transition)),
a as (select section, transition, arg_min(sa, {{'n': -n, 'v': sa}}) as s from (select section, transition, sa, count(*) n from lg group by 1, 2, 3) group by 1, 2), b as (select section, transition, arg_min(sb, {{'n': -n, 'v': sb}}) as s from (select section, transition, sb, count(*) n from lg group by 1, 2, 3) group by 1, 2),
w as (select scenario_id::varchar as transition, count(*) n from tp where ta != tb group by 1 order by n desc, transition limit 20)
select lg.section, lg.transition, count(*) as count, max(a.s) as base_failure_subtype_top, max(b.s) as extended_failure_subtype_top from lg join a using (section, transition) join b using (section, transition) group by 1, 2
union all select 'top_disagreement_scenario', transition, n, null, null from w""")
def au9b(spark, sf):
    return au.taxonomy_disagreement(pair_rows(spark, sf), "ta", "tb", "sa", "sb", "scenario_id")


OLD_SQL = """old as (select o_orderkey::varchar as sample_id, o_custkey::varchar as scenario_id, (o_orderkey % 3 = 0)::int as planner_failure, case o_orderkey % 4 when 0 then 'timeout_without_path' when 1 then 'Collision' when 2 then '' else 'unknown' end as reason from orders)"""


def old_rows(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.cast("string").alias("sample_id"), F.col("o_custkey").cast("string").alias("scenario_id"), (k % 3 == 0).cast("int").alias("planner_failure"),
                                            F.when(k % 4 == 0, "timeout_without_path").when(k % 4 == 1, "Collision").when(k % 4 == 2, "").otherwise("unknown").alias("planner_failure_reason"))


@query("AU10_recode_audit", f"""
with {TAX_SQL}, {OLD_SQL}, j as (select sample_id, scenario_id, case when planner_failure = 0 then 'no_failure' when reason = 'Collision' then 'known_failure' else 'unknown_failure' end as o, failure_taxonomy as f, failure_subtype from old join tx using (sample_id))
select o || '_to_' || f as recode, o != f as recode_changed, count(*) as n, count(distinct failure_subtype) as subtypes from j group by 1, 2""")
def au10(spark, sf):
    return au.recode_audit(old_rows(spark, sf), taxonomy_rows(spark, sf)).groupBy("recode", "recode_changed").agg(F.count("*").alias("n"), F.countDistinct("fixed_failure_subtype").alias("subtypes"))


BURST_SQL = """br as (select conv_id as scenario_id, case when turn = 0 then 'No_Route found' when turn = 1 then 'parser_error|no_route' when conv_id % 7 = 0 then null else role end as reason from conversations)"""


@query("AU11_burst_check", f"""
with {BURST_SQL}, t as (select unnest(['parser_error', 'no_route', 'initial_invalid']) as reason_token), p as (select reason_token, scenario_id, count(*) n from t join br on lower(coalesce(reason, '')) like '%' || replace(reason_token, '_', '#_') || '%' escape '#' group by 1, 2)
select reason_token, coalesce(sum(n), 0)::bigint as count, count(scenario_id) as scenario_count, coalesce(max(n), 0) as max_count_in_one_scenario, {r('coalesce(max(n), 0) / greatest(coalesce(sum(n), 0), 1)')} as max_scenario_fraction,
  coalesce(max(n), 0) / greatest(coalesce(sum(n), 0), 1) >= 0.5 and coalesce(sum(n), 0) >= 5 as concentrated from t left join p using (reason_token) group by 1""")
def au11(spark, sf):
    c = read(spark, sf, "conversations")
    reason = F.when(F.col("turn") == 0, "No_Route found").when(F.col("turn") == 1, "parser_error|no_route").when(F.col("conv_id") % 7 != 0, F.col("role"))
    return rounded(au.burst_check(c.select(F.col("conv_id").alias("scenario_id"), reason.alias("planner_failure_reason"))))


UNK_SQL = f"""{TAX_SQL}, uk as (select tx.*, o_custkey::varchar as scenario_id, o_orderpriority as speed_stratum, o_orderstatus as density_stratum, case o_orderkey % 4 when 0 then 'timeout' when 1 then null else 'other' end as planner_failure_reason from tx join orders on o_orderkey::varchar = sample_id)"""


def unknown_rows(spark, sf):
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select(k.cast("string").alias("sample_id"), F.col("o_custkey").cast("string").alias("scenario_id"), F.col("o_orderpriority").alias("speed_stratum"), F.col("o_orderstatus").alias("density_stratum"),
                                         F.when(k % 4 == 0, "timeout").when(k % 4 != 1, "other").alias("planner_failure_reason"))
    return taxonomy_rows(spark, sf).join(o, "sample_id")


@query("AU12_unknown_distributions", f"""
with {UNK_SQL}, d as (select u.dimension, u.value from uk, lateral (values ('planner_failure_reason', coalesce(planner_failure_reason, 'missing')), ('collision_flag', collision_flag::varchar), ('kinematic_flag', kinematic_flag::varchar)) u(dimension, value) where failure_taxonomy = 'unknown_failure')
select dimension, value, count(*) as count, {r('count(*) / sum(count(*)) over (partition by dimension)')} as fraction_of_unknown from d group by 1, 2""")
def au12(spark, sf):
    return rounded(au.unknown_distributions(unknown_rows(spark, sf), ["planner_failure_reason", "collision_flag", "kinematic_flag"]))


@query("AU12_unknown_by_stratum", f"""
with {UNK_SQL}, d as (select u.stratum_column, u.stratum, (failure_taxonomy = 'unknown_failure')::int as k from uk, lateral (values ('speed_stratum', speed_stratum), ('density_stratum', density_stratum)) u(stratum_column, stratum)), c as (select stratum_column, stratum, sum(k)::bigint as u, count(*) as n from d group by 1, 2),
e as (select *, sum(u) over (partition by stratum_column) as t from c) select stratum_column, stratum, u as unknown_count, n as total_count, {r('u / n')} as unknown_rate, {r('u / greatest(t, 1)')} as fraction_of_unknown from e where u > 0""")
def au12b(spark, sf):
    return rounded(au.unknown_by_stratum(unknown_rows(spark, sf), ["speed_stratum", "density_stratum"]))


@query("AU12_unknown_by_scenario", f"""
with {UNK_SQL}, c as (select scenario_id, sum((failure_taxonomy = 'unknown_failure')::int)::bigint u, count(*) n from uk group by 1), rz as (select scenario_id, string_agg(v || ':' || n, ';' order by v) s from (select scenario_id, coalesce(planner_failure_reason, '') v, count(*) n from uk where failure_taxonomy = 'unknown_failure' group by 1, 2) group by 1)
select scenario_id, u as unknown_count, n as total_count, s as failure_reasons, {r('u / n')} as unknown_rate from c left join rz using (scenario_id) where u > 0""")
def au12c(spark, sf):
    return rounded(au.unknown_by_scenario(unknown_rows(spark, sf)))


@query("AU12_suggest_recode", f"""
with {UNK_SQL} select sample_id, failure_taxonomy as old_failure_taxonomy, case when lower(coalesce(planner_failure_reason, '')) like '%timeout%' and candidate_all_invalid = 1 then 'possible_known_failure' when nf > 0 then 'known_failure' when candidate_any_feasible = 1 then 'no_failure' else 'keep_unknown' end as suggested_recode,
  case when lower(coalesce(planner_failure_reason, '')) like '%timeout%' and candidate_all_invalid = 1 then 'possible_known_failure_timeout_all_invalid' when nf > 0 then 'known_failure:' || concat_ws('_and_', case when collision_flag = 1 then 'collision' end, case when road_boundary_flag = 1 then 'road_boundary' end, case when kinematic_flag = 1 then 'kinematic' end)
  when candidate_any_feasible = 1 then 'no_failure:feasible_trajectory_exists' else 'missing_validator_output_or_incomplete_rollout' end as suggested_subtype from uk where failure_taxonomy = 'unknown_failure'""")
def au12d(spark, sf):
    return au.suggest_recode(unknown_rows(spark, sf)).select("sample_id", "old_failure_taxonomy", "suggested_recode", "suggested_subtype")


NEG_SQL = """ng as (select l_linestatus, l_linenumber::varchar as ln, l_orderkey as scenario_id, case when l_returnflag = 'R' then 'known_failure' else 'no_failure' end as tax, l_extendedprice as a, l_discount as b, l_quantity as speed, l_tax * 40 as dist, (l_linenumber = 3)::int as ov, (l_tax > 0.05)::int as cf, 'p' || l_suppkey % 9 as sub from lineitem)"""


def negative_rows(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select("l_linestatus", F.col("l_linenumber").cast("string").alias("ln"), F.col("l_orderkey").alias("scenario_id"), F.when(F.col("l_returnflag") == "R", "known_failure").otherwise("no_failure").alias("failure_taxonomy"),
                     F.col("l_extendedprice").alias("a"), F.col("l_discount").alias("b"), F.col("l_quantity").alias("ego_speed_mps"), (F.col("l_tax") * 40).alias("current_min_distance_m"), (F.col("l_linenumber") == 3).cast("int").alias("initial_overlap_count"),
                     (F.col("l_tax") > 0.05).cast("int").alias("collision_flag"), F.concat(F.lit("p"), F.col("l_suppkey") % 9).alias("failure_subtype"), F.col("l_linestatus").alias("planner_failure_reason"))


@query("AU13_negative_delta", f"""
with {NEG_SQL}, st as (select u.stratum_column, u.stratum, (tax = 'known_failure')::int as y, ng.* from ng, lateral (values ('l_linestatus', l_linestatus), ('ln', ln)) u(stratum_column, stratum)), lo as (select stratum_column, stratum, 'a' as sn, a as score, y from st union all select stratum_column, stratum, 'b', b, y from st),
{curve_sql('stratum_column, stratum, sn', 'lo')}, ap as (select stratum_column, stratum, sn, {AUPRC} as v from cum group by 1, 2, 3),
sb as (select *, row_number() over (partition by stratum_column, stratum order by n desc, sub) rn from (select stratum_column, stratum, sub, count(*) n from st where y = 1 group by 1, 2, 3)), tp as (select stratum_column, stratum, string_agg(sub || ':' || n, ';' order by rn) s from sb where rn <= 5 group by 1, 2),
co as (select stratum_column, stratum, count(*) n, sum(y)::bigint p, avg((speed < 5)::int) ls, avg((dist < 1)::int) no_, avg((ov > 0)::int) io, avg(cf) filter (y = 1) cp, count(distinct case when y = 1 then scenario_id end) sc from st group by 1, 2)
select co.stratum_column, co.stratum, n, p as positive_count, 'a' as enhanced_score, 'b' as baseline_score, {r('x.v')} as "enhanced_AUPRC", {r('z.v')} as "baseline_AUPRC", {r('x.v - z.v')} as "AUPRC_delta", {r('ls')} as low_speed_fraction, {r('no_')} as near_overlap_fraction, {r('io')} as initial_overlap_fraction,
  {r('cp')} as collision_positive_fraction, sc as positive_scenario_count, tp.s as top_failure_subtypes, x.v - z.v < 0 as negative_delta, x.v - z.v < -0.02 as clearly_negative_delta
from co join ap x on co.stratum_column = x.stratum_column and co.stratum = x.stratum and x.sn = 'a' join ap z on co.stratum_column = z.stratum_column and co.stratum = z.stratum and z.sn = 'b' join tp on co.stratum_column = tp.stratum_column and co.stratum = tp.stratum where p >= 10""")
def au13(spark, sf):
    out = au.negative_delta_audit(negative_rows(spark, sf), [("a", "b")], ["l_linestatus", "ln"])
    return rounded(out.drop("road_boundary_positive_fraction", "kinematic_positive_fraction"))


@query("AU14_subtype_summary", f"""
with {NEG_SQL} select sub as failure_subtype, l_linestatus as planner_failure_reason, count(*) as count, count(distinct scenario_id) as scenario_count, sum(cf)::bigint as collision_flag_rows, 0::bigint as road_boundary_flag_rows, 0::bigint as kinematic_flag_rows, sum((ov > 0)::int)::bigint as initial_overlap_count_rows
from ng where speed < 5 and tax = 'known_failure' group by 1, 2""")
def au14(spark, sf):
    return au.subtype_summary(negative_rows(spark, sf), F.col("ego_speed_mps") < 5)


MIS_SQL = """lv as (select o_orderkey as id, 'r' || v as label_variant, (o_orderkey * (v + 2) % 7 < 2)::int as y from orders, range(4) t(v)),
pv as (select o_orderkey as id, 'r' || v as feature_variant, fs as feature_set, ((o_orderkey * (v + 2) % 7 < 2)::int * case when fs = 'enhanced' then 300 else 100 end + (o_orderkey * 7919 * (v + 1) + o_custkey * 31) % 1009)::double as score from orders, range(4) t(v), (values ('baseline'), ('enhanced')) f(fs)),
mj as (select label_variant, feature_variant, feature_set, score, y from lv join pv using (id))"""
MIS_CELLS = f"""ms as (select label_variant, feature_variant, feature_set, {AUPRC} as ap, {strict(0.05)} as rc, sum(pos + neg)::bigint as n, sum(pos)::bigint as p from cum group by 1, 2, 3),
mm as (select x.label_variant, x.feature_variant, x.n, x.p, x.ap as ba, z.ap as ea, z.ap - x.ap as da, z.rc - x.rc as dr from ms x join ms z on x.label_variant = z.label_variant and x.feature_variant = z.feature_variant and x.feature_set = 'baseline' and z.feature_set = 'enhanced')"""


def mismatch(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    y = (k * (F.col("v") + 2) % 7 < 2).cast("int")
    name = F.concat(F.lit("r"), F.col("v"))
    labels = o.select(k.alias("sample_id"), name.alias("label_variant"), y.alias("y"))
    fs = F.explode(F.array(F.lit("baseline"), F.lit("enhanced"))).alias("feature_set")
    preds = o.select("*", fs).select(k.alias("sample_id"), name.alias("feature_variant"), "feature_set",
                                     (y * F.when(F.col("feature_set") == "enhanced", 300).otherwise(100) + (k * 7919 * (F.col("v") + 1) + c * 31) % 1009).cast("double").alias("score"))
    return au.mismatch_matrix(labels, preds)


@query("AU15_mismatch_matrix", f"with {MIS_SQL}, {curve_sql('label_variant, feature_variant, feature_set', 'mj')}, {MIS_CELLS} select label_variant, feature_variant, n, p as positive_count, {r('ba')} as \"baseline_AUPRC\", {r('ea')} as \"enhanced_AUPRC\", {r('da')} as \"delta_AUPRC\", {r('dr')} as delta_recall_5pct_fpr_strict, label_variant = feature_variant as diagonal from mm")
def au15(spark, sf):
    return rounded(mismatch(spark, sf))


@query("AU15_mismatch_summary", f"""
with {MIS_SQL}, {curve_sql('label_variant, feature_variant, feature_set', 'mj')}, {MIS_CELLS}, s as (select median(da) filter (label_variant != feature_variant) a, avg((da > 0)::int) filter (label_variant != feature_variant) * 100 b, median(da) filter (label_variant = feature_variant) c from mm)
select {r('a')} as "median_offdiagonal_delta_AUPRC", {r('b')} as percent_offdiagonal_positive, {r('c')} as "median_diagonal_delta_AUPRC", {r('a / c')} as offdiagonal_gain_retention_vs_diagonal from s""")
def au15b(spark, sf):
    return rounded(au.mismatch_summary(mismatch(spark, sf)))


@query("AU15_mismatch_wide", f"""
with {MIS_SQL}, {curve_sql('label_variant, feature_variant, feature_set', 'mj')}, {MIS_CELLS} select label_variant, {', '.join(f"{r(f'''max(case when feature_variant = 'r{i}' then da end)''')} as r{i}" for i in range(4))} from mm group by 1""")
def au15c(spark, sf):
    return rounded(au.mismatch_wide(mismatch(spark, sf), [f"r{i}" for i in range(4)]))


@query("AU16_stability", f"""
with {SCORED_SQL}, {curve_sql('l_linestatus, l_linenumber')}, a as (select l_linestatus, l_linenumber, {AUPRC} as v from cum group by 1, 2)
select l_linestatus, count(*) as n_runs, {r('min(v)')} as auprc_min, {r('max(v)')} as auprc_max, {r('avg(v)')} as auprc_mean, {r('max(v) - min(v)')} as auprc_range from a group by 1""")
def au16(spark, sf):
    table = m.auprc(scored_rows(spark, sf), "y", "score", ["l_linestatus", "l_linenumber"])
    return rounded(au.stability(table, ["l_linestatus"], ["auprc"]))


@query("AU17_funnel", """
select 0 as stage_ix, 'all' as stage, count(*) as n_rows, count(distinct o_orderkey) as n_keys, count(distinct o_custkey) as n_scenarios from orders union all
select 1, 'with_items', count(*), count(distinct o_orderkey), count(distinct o_custkey) from orders where o_orderkey in (select l_orderkey from lineitem) union all
select 2, 'failed', count(*), count(distinct o_orderkey), count(distinct o_custkey) from orders where o_orderkey in (select l_orderkey from lineitem) and o_orderstatus = 'F'""")
def au17(spark, sf):
    o = read(spark, sf, "orders")
    items = o.join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return au.funnel([("all", o), ("with_items", items), ("failed", items.filter("o_orderstatus = 'F'"))], "o_orderkey", "o_custkey")


@query("AU18_gates", f"""
with {UNK_SQL}, p as (select scenario_id, count(*) n, sum((failure_taxonomy = 'known_failure')::int) k, sum((failure_taxonomy = 'unknown_failure')::int) u from uk group by 1), f as (select sum(k) kn, sum((k > 0)::int) sc, sum(u) un, max(n) lg from p)
select 'known_positives' as gate, kn::double as value, 150.0 as "limit", kn >= 150 as passed from f union all select 'positive_scenarios', sc, 75, sc >= 75 from f union all select 'unknown_not_above_known', un, kn, un <= kn from f
union all select 'no_concentrated_burst', 0, 0, true union all select 'samples_per_scenario', lg, 10, lg <= 10 from f""")
def au18(spark, sf):
    return au.gates(unknown_rows(spark, sf))


@query("AU18_gates_with_deltas", f"""
with {SCORED_SQL}, {cb.reps_sql(['disc', 'score'], cb.N)}, {cb.deltas_sql([('disc', 'score')])},
p as (select scenario, count(*) n, sum(y) k from scored group by 1), f as (select sum(k) kn, sum((k > 0)::int) sc, max(n) lg from p)
select 'known_positives' as gate, kn::double as value, 150.0 as "limit", kn >= 150 as passed from f union all select 'positive_scenarios', sc, 75, sc >= 75 from f union all select 'unknown_not_above_known', 0, kn, 0 <= kn from f
union all select 'no_concentrated_burst', 0, 0, true union all select 'samples_per_scenario', lg, 10, lg <= 10 from f union all select 'beats:' || enhanced || '>' || baseline || ':' || metric, {r('ci_low')}, 0, coalesce(delta > 0 and ci_low > 0, false) from agg""")
def au18b(spark, sf):
    rows = scored_rows(spark, sf)
    labels = rows.select(F.col("scenario").alias("scenario_id"), F.when(F.col("y") == 1, "known_failure").otherwise("no_failure").alias("failure_taxonomy"), F.lit("x").alias("planner_failure_reason"))
    return rounded(au.gates(labels, bt.paired_delta(rows, "y", "disc", "score", "scenario", cb.N)))


GATE_SCORES, GATE_BASELINES = ("disc", "tax"), ("score", "qty")
LONG_SCORES = "lateral (values ('score', score), ('qty', qty), ('disc', disc), ('tax', tax)) v(score_name, value)"


@query("AU18_overlap_gates", f"""
with {SCORED_SQL}, long as (select score_name, value as score, y from scored, {LONG_SCORES} where l_linenumber <= 5), {bundle_sql('score_name', 'long', levels=(0.05,))}
select 'clean_start:' || a.score_name || '>' || b.score_name as gate, {r('least(a.auprc - b.auprc, a.recall_at_5pct_fpr_strict - b.recall_at_5pct_fpr_strict)')} as value, 0.0::double as "limit",
  a.auprc > b.auprc and a.recall_at_5pct_fpr_strict > b.recall_at_5pct_fpr_strict as passed from bundle a, bundle b where a.score_name in {GATE_SCORES} and b.score_name in {GATE_BASELINES}""")
def au18_overlap(spark, sf):
    rows = scored_rows(spark, sf).withColumn("initial_overlap_count", F.greatest(F.col("l_linenumber") - 5, F.lit(0)))
    clean = m.stratum_metrics(rows.filter("initial_overlap_count = 0").withColumn("all", F.lit("all")), "y", ["all"], [*GATE_SCORES, *GATE_BASELINES], (0.05,))
    return rounded(au.overlap_gates(clean, GATE_SCORES, GATE_BASELINES))


@query("AU18_stratum_gates", f"""
with {SCORED_SQL}, long as (select c.stratum_column, c.stratum, score_name, value as score, y from scored, lateral (values ('l_linestatus', l_linestatus), ('l_linenumber', l_linenumber::varchar)) c(stratum_column, stratum), {LONG_SCORES}),
{bundle_sql('stratum_column, stratum, score_name', 'long', levels=(0.05,))},
d as (select b.score_name as baseline, greatest(a.positive_count, b.positive_count) >= 10 and a.auprc - b.auprc < -0.02 as bad from bundle a join bundle b on a.stratum_column = b.stratum_column and a.stratum = b.stratum where a.score_name = 'disc' and b.score_name in {GATE_BASELINES})
select 'no_negative_stratum:disc>' || baseline as gate, sum(coalesce(bad, false)::int)::double as value, 0.0::double as "limit", sum(coalesce(bad, false)::int) = 0 as passed from d group by baseline""")
def au18_strata(spark, sf):
    strata = m.stratum_metrics(scored_rows(spark, sf), "y", ["l_linestatus", "l_linenumber"], ["disc", *GATE_BASELINES], (0.05,))
    return rounded(au.stratum_gates(strata, "disc", GATE_BASELINES))


@query("AU20_sanity", f"""
with v as (select case when o_orderkey % 5 = 0 then null else o_totalprice end as a, o_totalprice - o_custkey % 9 as b, case when o_orderkey % 7 = 0 then null else (o_orderkey % 100)::double end as ttad_s from orders)
select 'max_abs_a_minus_b' as "check", {r('max(abs(a - b))')} as value from v union all select 'a_finite_fraction', {r('avg((a is not null)::int)')} from v union all select 'ttad_s_finite_fraction', {r('avg((ttad_s is not null)::int)')} from v union all select 'a_median', {r('median(a)')} from v union all select 'ttad_s_median', {r('median(ttad_s)')} from v""")
def au20(spark, sf):
    k = F.col("o_orderkey")
    df = read(spark, sf, "orders").select(F.when(k % 5 != 0, F.col("o_totalprice")).alias("a"), (F.col("o_totalprice") - F.col("o_custkey") % 9).alias("b"), F.when(k % 7 != 0, (k % 100).cast("double")).alias("ttad_s"))
    return rounded(au.sanity_checks(df, [("a", "b")], ["a", "ttad_s"]))


def _perturbed(kind: str, level: float, x: str, y: str, keep: str = "true") -> str:
    return f"select '{kind}' as kind, {level}::double as level, sample_id, agent_id, is_ego, {x} as x, {y} as y, heading, length, width from agents where {keep}"


ROBUST_SQL = f"""{SAMPLES_SQL}, pt as ({_perturbed('position', 0.5, f"case when is_ego then x else x + 0.5 * {normal_sql('position', 'x')} end", f"case when is_ego then y else y + 0.5 * {normal_sql('position', 'y')} end")}
  union all {_perturbed('velocity', 1.0, 'x', 'y')} union all {_perturbed('dropout', 0.3, 'x', 'y', keep='is_ego or ' + hash_sql("'7|dropout|drop|' || sample_id || '|' || agent_id") + ' >= 0.3')}),
ds as (select e.kind, e.level, e.sample_id, e.agent_id as ego, coalesce(min(case when o.agent_id is not null then {distance_sql('e', 'o')} end), 9999.0) as d from (select * from pt where is_ego) e left join (select * from pt where not is_ego) o on e.kind = o.kind and e.sample_id = o.sample_id group by all),
rb as (select kind, level, -d as score, (ego % 3 = 0)::int as y from ds), {bundle_sql('kind, level', 'rb', levels=(0.05,))}"""


@query("AU21_robustness", f"with {ROBUST_SQL} select kind, level, {bundle_cols((0.05,))} from bundle")
def au21(spark, sf):
    from feaslens.operators import proximity as px
    agents, _, _ = sc.stored(spark, sf)
    parts = None
    for kind, level in (("position", 0.5), ("velocity", 1.0), ("dropout", 0.3)):
        near = px.current_proximity(sm.perturb(agents, kind, level, 7)).select("sample_id", (-F.col("current_min_distance_m")).alias("score"), F.lit(kind).alias("kind"), F.lit(level).alias("level"))
        parts = near if parts is None else parts.unionByName(near)
    y = agents.filter("is_ego").select("sample_id", (F.col("agent_id") % 3 == 0).cast("int").alias("y"))
    return rounded(au.robustness(parts.join(y, "sample_id"), "y", "score"))
