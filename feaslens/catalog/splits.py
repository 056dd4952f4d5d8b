"""Split, cohort and sampling queries over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog.base import query, read
from feaslens.catalog.columns import hash_sql
from feaslens.operators import splits as sp


@query("SP1_group_folds", f"""
select o_orderkey, least(floor({hash_sql("'42|' || o_custkey")} * 5), 4)::int as fold, least(floor({hash_sql("'outer:7:' || o_custkey")} * 5), 4)::int as outer_fold from orders""")
def sp1(spark, sf):
    o = sp.group_folds(read(spark, sf, "orders"), "o_custkey", 5, 42)
    return sp.group_folds(o, "o_custkey", 5, 7, "outer", "outer_fold").select("o_orderkey", "fold", "outer_fold")


@query("SP2_hash_split", f"""
with k as (select distinct o_custkey as k, {hash_sql("'42:' || o_custkey")} as u from orders),
e as (select min({{'u': u, 'k': k::varchar}}) lo, max({{'u': u, 'k': k::varchar}}) hi from k)
select o_orderkey, ({hash_sql("'42:' || o_custkey")} < 0.25 or {{'u': {hash_sql("'42:' || o_custkey")}, 'k': o_custkey::varchar}} = lo) as is_test from orders, e""")
def sp2(spark, sf):
    return sp.hash_split(read(spark, sf, "orders"), "o_custkey", 0.25, 42).select("o_orderkey", "is_test")


@query("SP3_exact_split", f"""
with k as (select k, row_number() over (order by u, k::varchar) as rn, count(*) over () as n from (select distinct o_custkey as k, {hash_sql("'42|' || o_custkey")} as u from orders))
select o_orderkey, rn <= greatest(1, round_even(n * 0.25, 0)) as is_test from orders join k on o_custkey = k""")
def sp3(spark, sf):
    return sp.exact_split(read(spark, sf, "orders"), "o_custkey", 0.25, 42).select("o_orderkey", "is_test")


@query("SP4_calibration_split", f"""
with f as (select o_orderkey, o_custkey, least(floor({hash_sql("'42|' || o_custkey")} * 5), 4)::int as fold from orders)
select o_orderkey, fold, {hash_sql("'cal:42:' || fold || ':' || o_custkey")} < 0.2 as is_calibration from f""")
def sp4(spark, sf):
    o = sp.group_folds(read(spark, sf, "orders"), "o_custkey", 5, 42)
    return sp.calibration_split(o, "o_custkey", 42, F.col("fold"), 0.2, ["fold"]).select("o_orderkey", "fold", "is_calibration")


@query("SP5_neutral_cohort", f"""
with a as (select o_orderkey, o_custkey, o_orderpriority, {hash_sql("'42|' || o_orderkey")} as u from orders),
c as (select * from (select *, row_number() over (partition by o_custkey order by u, o_orderkey) as c from a) where c <= 3),
s as (select *, row_number() over (partition by o_orderpriority order by u, o_orderkey) as rnd, {hash_sql("'42|bucket|' || o_orderpriority")} as h from c)
select o_orderkey, o_custkey, o_orderpriority, row_number() over (order by rnd, h, o_orderpriority)::int as selected_order
from s order by rnd, h, o_orderpriority limit 500""")
def sp5(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sp.neutral_cohort(o, "o_orderkey", "o_orderpriority", 500, 42, "o_custkey", 3)


@query("SP5_cohort_diagnostics", f"""
with a as (select o_orderkey, o_custkey, o_orderpriority, {hash_sql("'42|' || o_orderkey")} as u from orders),
c as (select * from (select *, row_number() over (partition by o_custkey order by u, o_orderkey) as c from a) where c <= 3),
s as (select *, row_number() over (partition by o_orderpriority order by u, o_orderkey) as rnd, {hash_sql("'42|bucket|' || o_orderpriority")} as h from c),
p as (select * from s order by rnd, h, o_orderpriority limit 500)
select count(*)::bigint as selected_samples, count(distinct o_custkey) as unique_scenarios, (select max(n) from (select count(*) n from p group by o_custkey)) as max_samples_per_scenario,
       count(distinct o_orderpriority) as strata, count(*) between 400 and 500 as size_ok, count(distinct o_custkey) >= 100 as scenarios_ok from p""")
def sp5b(spark, sf):
    return sp.cohort_diagnostics(sp5(spark, sf), "o_custkey", "o_orderpriority", 400, 500, 100)


@query("SP6_neutral_strata", """
select o_orderkey, source_hint || '|' || scenario_family || '|' || lanelet_stratum || '|' || density_stratum || '|' || horizon_stratum as neutral_scenario_stratum, lanelet_stratum, density_stratum, horizon_stratum
from (select o_orderkey, lower(o_orderstatus) as source_hint, 'unknown' as scenario_family,
  case when o_custkey % 100 = 0 then 'missing_lanelets' when o_custkey % 100 <= 20 then 'lt20_lanelets' when o_custkey % 100 <= 60 then '20to60_lanelets' else 'gte60_lanelets' end as lanelet_stratum,
  case when o_totalprice / 10000 <= 5 then 'lt5_dyn' when o_totalprice / 10000 <= 15 then '5to15_dyn' else 'gte15_dyn' end as density_stratum,
  case when o_orderkey % 120 <= 30 then 'lt30_steps' when o_orderkey % 120 <= 90 then '30to90_steps' else 'gte90_steps' end as horizon_stratum from orders)""")
def sp6(spark, sf):
    o = read(spark, sf, "orders").select(
        "o_orderkey", F.lower("o_orderstatus").alias("source_hint"), F.when(F.col("o_custkey") % 100 != 0, F.col("o_custkey") % 100).alias("lanelet_count"),
        (F.col("o_totalprice") / 10000).alias("dynamic_obstacle_count"), (F.col("o_orderkey") % 120).alias("max_time_step"))
    return sp.neutral_strata(o).select("o_orderkey", "neutral_scenario_stratum", "lanelet_stratum", "density_stratum", "horizon_stratum")


@query("SP7_hash_sample", f"select page_id, url from pages order by {hash_sql("'42|' || url")}, url limit 50")
def sp7(spark, sf):
    return sp.hash_sample(read(spark, sf, "pages").select("page_id", "url"), "url", 50, 42)


SETS_SQL = f"""b as (select o_orderkey::varchar as sample_id, o_custkey, least(substr(o_orderpriority, 1, 1)::int - 1, 3) as label_id, o_totalprice / 20000 as current_min_distance_m,
  case when o_orderstatus = 'F' then -1.0 else o_totalprice / 50000 end as current_ttc_s, o_totalprice / 9000 as ego_speed_kph, (o_orderkey % 40)::double as agent_count from orders),
q as (select quantile_cont(agent_count, 0.75) as p75 from b),
h as (select b.*, p75, (current_min_distance_m < 5 and label_id <= 1) or ((current_ttc_s < 0 or current_ttc_s > 3) and label_id >= 2) or (ego_speed_kph < 15 and label_id >= 2) or (agent_count >= p75 and label_id >= 2) as is_hard from b, q)"""


def risk_rows(spark, sf):
    p = F.col("o_totalprice")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"), "o_custkey", F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3)).alias("label_id"),
        (p / 20000).alias("current_min_distance_m"), F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(p / 50000).alias("current_ttc_s"),
        (p / 9000).alias("ego_speed_kph"), (F.col("o_orderkey") % 40).cast("double").alias("agent_count"))


@query("SP8_stratified_sets", f"""
with {SETS_SQL}, k as (select k, row_number() over (order by u, k::varchar) as rn, count(*) over () as n from (select distinct o_custkey as k, {hash_sql("'42|' || o_custkey")} as u from orders)),
t as (select h.*, rn <= greatest(1, round_even(n * 0.25, 0)) as is_test, row_number() over (partition by label_id, rn <= greatest(1, round_even(n * 0.25, 0)) order by {hash_sql("'42|' || sample_id")}, sample_id) as rr from h join k on o_custkey = k),
m as (select 'stratified_train' as split, * from t where not is_test and (is_hard or label_id >= 2 or (label_id = 0 and rr <= 800) or (label_id = 1 and rr <= 500))
  union all select 'natural_test', * from t where is_test union all select 'hard_cases', * from t where is_hard
  union all select 'emergency_enriched', * from t where label_id >= 2 or is_hard)
select split, count(*)::bigint as n, count(distinct o_custkey) as n_scenarios, sum((label_id = 0)::int)::bigint as label_0_n, sum((label_id = 1)::int)::bigint as label_1_n,
  sum((label_id = 2)::int)::bigint as label_2_n, sum((label_id = 3)::int)::bigint as label_3_n from m group by 1""")
def sp8(spark, sf):
    return sp.set_summary(sp.stratified_sets(risk_rows(spark, sf), "sample_id", "o_custkey", {0: 800, 1: 500}, 0.25, 42), "o_custkey")


@query("SP9_hard_cases", f"with {SETS_SQL} select sample_id, label_id from h where is_hard")
def sp9(spark, sf):
    return sp.hard_cases(risk_rows(spark, sf)).select("sample_id", "label_id")


@query("SP10_subsets", f"""
with {SETS_SQL}, m as (select sample_id, unnest(['all', case when current_ttc_s < 0 then 'no_ttc' end, case when current_ttc_s < 0 or current_ttc_s > 3 then 'large_or_no_ttc' end,
  case when ego_speed_kph < 15 then 'low_speed_lt15kph' end, case when agent_count >= p75 then 'dense_agents_p75' end, case when current_min_distance_m < 5 then 'close_distance_lt5m' end,
  case when current_min_distance_m < 5 and label_id <= 1 then 'hard_safe_close' end, case when current_ttc_s < 0 and label_id >= 2 then 'future_risk_no_ttc' end,
  case when (current_ttc_s < 0 or current_ttc_s > 3) and label_id >= 2 then 'future_risk_large_ttc' end, case when label_id = 0 then 'original_safe' end,
  case when label_id = 2 then 'original_warning' end, case when label_id = 3 then 'original_emergency' end]) as subset from h)
select sample_id, subset from m where subset is not null""")
def sp10(spark, sf):
    return sp.subset_membership(risk_rows(spark, sf), ["sample_id"])


@query("SP11_coverage", """
select 'before' as stage, count(*) as n_rows, count(distinct doc_id) as n_keys from documents
union all select 'after', count(*), count(distinct doc_id) from documents where doc_id in (select doc_id from labels)""")
def sp11(spark, sf):
    return sp.coverage_counts(read(spark, sf, "documents"), "doc_id", read(spark, sf, "labels"))


QUOTA_SQL = f"""w as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'close_interaction' when '2-HIGH' then 'medium_interaction' when '3-MEDIUM' then 'far_but_interactive' else 'random_fill' end as bucket,
  {hash_sql("'42|' || o_orderkey")} as u, {hash_sql("'42|fill|' || o_orderkey")} as f from orders)"""


@query("SC9_quota_sample", f"""
with {QUOTA_SQL}, r1 as (select *, row_number() over (partition by bucket order by u, o_orderkey) as r from w),
first as (select * from r1 where r <= case bucket when 'medium_interaction' then 140 when 'far_but_interactive' then 80 when 'close_interaction' then 100 else 0 end),
rest as (select * from w where bucket != 'close_interaction' and o_orderkey not in (select o_orderkey from first) order by f, o_orderkey limit 80)
select o_orderkey, bucket from first union all select o_orderkey, bucket from rest""")
def sc9(spark, sf):
    p = F.col("o_orderpriority")
    b = F.when(p == "1-URGENT", "close_interaction").when(p == "2-HIGH", "medium_interaction").when(p == "3-MEDIUM", "far_but_interactive").otherwise("random_fill")
    return sp.quota_sample(read(spark, sf, "orders").select("o_orderkey", b.alias("bucket")), ["o_orderkey"], "bucket", 400, 42)


@query("SC9_quota_fill", f"""
with {QUOTA_SQL}, r1 as (select *, row_number() over (partition by bucket order by u, o_orderkey) as r from w),
first as (select * from r1 where r <= case bucket when 'close_interaction' then 5 when 'medium_interaction' then 8 else 0 end),
k1 as (select *, row_number() over (partition by bucket order by f, o_orderkey) as k from w where o_orderkey not in (select o_orderkey from first)),
rest as (select * from k1 where k <= case bucket when 'close_interaction' then 15 when 'medium_interaction' then 2 else 1000000 end order by f, o_orderkey limit 87)
select o_orderkey, bucket from first union all select o_orderkey, bucket from rest""")
def sc9_fill(spark, sf):
    p = F.col("o_orderpriority")
    b = F.when(p == "1-URGENT", "close_interaction").when(p == "2-HIGH", "medium_interaction").when(p == "3-MEDIUM", "far_but_interactive").otherwise("random_fill")
    rows = read(spark, sf, "orders").select("o_orderkey", b.alias("bucket"))
    return sp.quota_sample(rows, ["o_orderkey"], "bucket", 100, 42, {"close_interaction": 5, "medium_interaction": 8}, {"close_interaction": 20, "medium_interaction": 10})


@query("SC11_severity_sample", f"""
with w as (select o_orderkey, case when o_orderstatus = 'P' then null else least(substr(o_orderpriority, 1, 1)::int - 1, 3) end as label, {hash_sql("'42|' || o_orderkey")} as u from orders),
g as (select *, case when label >= 2 then 0 when label = 1 then 1 when label = 0 then 2 else 3 end as g from w),
r1 as (select *, row_number() over (partition by g order by u, o_orderkey) as rn from g),
p as (select *, case when g = 0 and rn > 200 then 3 when g = 1 and rn > 300 then 3 else g end as p from r1)
select o_orderkey, label from p order by p, u, o_orderkey limit 900""")
def sc11(spark, sf):
    lab = F.when(F.col("o_orderstatus") != "P", F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3)))
    return sp.severity_sample(read(spark, sf, "orders").select("o_orderkey", lab.alias("label")), "o_orderkey", "label", 900, 42)
