"""Queries for cleaning, hashing and bucketing helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog.base import query, r, read, rounded
from feaslens.functions import columns as c
from feaslens.functions import frames as fr


@query("C1_num", f"""
select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 or event_id % 13 = 0 then null else {r('value')} end as raw,
       case when event_id % 7 = 0 or event_id % 11 = 0 or event_id % 13 = 0 then -1.0 else {r('value')} end as x
from events""")
def c1(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "NaN").when(
        F.col("event_id") % 13 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    df = read(spark, sf, "events").select("event_id", text.alias("t"))
    return rounded(df.select("event_id", c.num("t").alias("raw"), c.num("t", -1.0).alias("x")))


TTC = "case when event_id % 5 = 0 then -1.0 else value / 10 end"


@query("C2_ttc_policies", f"""
with t as (select event_id, {TTC} as ttc from events),
q as (select greatest(quantile_cont(ttc, 0.95), 10.0) as big from t where ttc >= 0)
select event_id, {r('case when ttc >= 0 then ttc end')} as as_null, {r('case when ttc >= 0 then ttc else big end')} as as_large,
       {r('least(case when ttc >= 0 then ttc else 10 end, 10)')} as capped,
       {r('coalesce(case when ttc >= 0 then 1 / greatest(ttc, 0.1) end, 0)')} as inverse,
       {r('case when ttc >= 0 then ttc else 999 end')} as sentinel
from t, q""")
def c2(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(F.col("value") / 10).alias("ttc"))
    both = fr.ttc_large(df.withColumn("as_large", F.col("ttc")), "as_large")
    return rounded(both.select(
        "event_id", c.non_negative_or_null("ttc").alias("as_null"), "as_large", c.ttc_capped("ttc", 10.0).alias("capped"),
        c.ttc_inverse("ttc").alias("inverse"), c.ttc_sentinel("ttc").alias("sentinel")))


@query("C3_median_fill", f"""
with t as (select event_id, case when event_id % 3 = 0 then null else value end as a, case when event_id % 4 = 0 then null else value * 2 end as b from events),
m as (select median(a) ma, median(b) mb from t)
select event_id, {r('coalesce(a, ma)')} as a, {r('coalesce(b, mb)')} as b, 0.0 as empty from t, m""")
def c3(spark, sf):
    df = read(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("b"), F.lit(None).cast("double").alias("empty"))
    return rounded(fr.median_fill(df, ["a", "b", "empty"]))


@query("C4_normalize_score", f"""
with t as (select event_id, case when event_id % 3 = 0 then null else value end as a from events),
q as (select quantile_cont(a, 0.01) lo, quantile_cont(a, 0.99) hi, max(a) mx from t),
i as (select event_id, a, hi - a as ia, mx - a as xa from t, q),
qi as (select quantile_cont(ia, 0.01) lo, quantile_cont(ia, 0.99) hi, quantile_cont(xa, 0.01) xlo, quantile_cont(xa, 0.99) xhi from i)
select event_id, {r('coalesce(greatest(0, least(1, (a - q.lo) / (q.hi - q.lo))), 0)')} as plain,
       {r('greatest(0, least(1, (a - q.lo) / (q.hi - q.lo)))')} as kept,
       {r('coalesce(greatest(0, least(1, (ia - qi.lo) / (qi.hi - qi.lo))), 0)')} as inverted,
       {r('coalesce(greatest(0, least(1, (xa - qi.xlo) / (qi.xhi - qi.xlo))), 0)')} as inverted_max
from i, q, qi""".replace("greatest(0, least(1, (a - q.lo) / (q.hi - q.lo)))", "case when a is not null then greatest(0, least(1, (a - q.lo) / (q.hi - q.lo))) end")
.replace("greatest(0, least(1, (ia - qi.lo) / (qi.hi - qi.lo)))", "case when a is not null then greatest(0, least(1, (ia - qi.lo) / (qi.hi - qi.lo))) end")
.replace("greatest(0, least(1, (xa - qi.xlo) / (qi.xhi - qi.xlo)))", "case when a is not null then greatest(0, least(1, (xa - qi.xlo) / (qi.xhi - qi.xlo))) end"))
def c4(spark, sf):
    df = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"))
    specs = [fr.Norm("a", "plain"), fr.Norm("a", "kept", keep_null=True), fr.Norm("a", "inverted", invert=True),
             fr.Norm("a", "inverted_max", invert=True, anchor="max")]
    return rounded(fr.normalize(df, specs).drop("a"))


@query("C5_mean_of", f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       {r("(coalesce(case when l_returnflag = 'R' then l_quantity end, 0) + coalesce(case when l_linestatus = 'O' then l_discount end, 0)) / nullif((l_returnflag = 'R')::int + (l_linestatus = 'O')::int, 0)")} as m
from lineitem""")
def c5(spark, sf):
    li = read(spark, sf, "lineitem")
    m = c.mean_of([F.when(F.col("l_returnflag") == "R", F.col("l_quantity")), F.when(F.col("l_linestatus") == "O", F.col("l_discount"))])
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", m.alias("m")))


@query("C6_C7_frames_of_reference", f"""
with t as (select vec_id, embedding[1]::double * 20 as x, embedding[2]::double * 20 as y, embedding[3]::double * 30 as h,
                  embedding[4]::double as ox, embedding[5]::double as oy from embeddings)
select vec_id, {r('(h + pi()) - 2 * pi() * floor((h + pi()) / (2 * pi())) - pi()')} as wrapped,
       {r('cos(h) * (x - ox) + sin(h) * (y - oy)')} as lx, {r('cos(h) * (y - oy) - sin(h) * (x - ox)')} as ly,
       {r('cos(h) * x + sin(h) * y')} as vx, {r('cos(h) * y - sin(h) * x')} as vy
from t""")
def c67(spark, sf):
    e = lambda i, k=1.0: F.col("embedding")[i].cast("double") * k
    t = read(spark, sf, "embeddings").select("vec_id", e(0, 20).alias("x"), e(1, 20).alias("y"), e(2, 30).alias("h"), e(3).alias("ox"), e(4).alias("oy"))
    lx, ly = c.to_local("x", "y", "ox", "oy", "h")
    vx, vy = c.to_local_vector("x", "y", "h")
    return rounded(t.select("vec_id", c.wrap_to_pi("h").alias("wrapped"), lx.alias("lx"), ly.alias("ly"), vx.alias("vx"), vy.alias("vy")))


@query("C8_nearest_bin", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when l_quantity <= 15 then 10.0 when l_quantity <= 25 then 20.0 when l_quantity <= 35 then 30.0 else 40.0 end as bin
from lineitem""")
def c8(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.nearest_bin("l_quantity", [10, 20, 30, 40]).alias("bin"))


@query("C9_smoothstep", f"""
with t as (select event_id, value / 97 - 0.2 as u from events), z as (select event_id, greatest(0, least(1, u)) as z from t)
select event_id, {r('z * z * (3 - 2 * z)', 10)} as s, {r('6 * z * (1 - z)', 10)} as slope from z""")
def c9(spark, sf):
    u = F.col("value") / 97 - 0.2
    return rounded(read(spark, sf, "events").select("event_id", c.smoothstep(u).alias("s"), c.smoothstep_slope(u).alias("slope")), 10)


@query("C10_C11_buckets", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when l_linestatus = 'F' then 'none' when l_quantity <= 5 then 'lo' when l_quantity <= 15 then 'mid' else 'hi' end as right_closed,
       case when l_quantity < 3 then '<3m' when l_quantity < 10 then '3-10m' else '>=10m' end as distance_bucket,
       case when l_quantity - 2 < 0 then 'ttc<0' when l_quantity - 2 < 1 then '0-1s' when l_quantity - 2 < 3 then '1-3s' else '>=3s' end as ttc_bucket
from lineitem""")
def c10(spark, sf):
    li = read(spark, sf, "lineitem")
    q = F.when(F.col("l_linestatus") != "F", F.col("l_quantity"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.bucket(q, [5, 15], ["lo", "mid", "hi"], "none").alias("right_closed"),
                     c.distance_bucket("l_quantity").alias("distance_bucket"), c.ttc_bucket(F.col("l_quantity") - 2).alias("ttc_bucket"))


def hash_sql(text: str) -> str:
    return f"('0x' || substr(sha1({text}), 1, 16))::ubigint::double / 18446744073709551616.0"


@query("C12_C13_hashes", f"""
select o_orderkey, {r(hash_sql("'42|' || o_orderkey"), 10)} as u, {r(hash_sql("'outer:42:' || o_orderkey"), 10)} as outer_u,
       {r(hash_sql("'cal:42:3:' || o_orderkey"), 10)} as cal_u,
       {r("('0x' || substr(sha1('42:' || o_orderkey), 1, 12))::ubigint::double / 281474976710655.0", 10)} as u12,
       ('0x' || substr(sha1('job|' || o_orderkey), 1, 8))::ubigint::bigint as job, substr(sha1(o_orderkey::varchar), 1, 12) as row_id
from orders""")
def c12(spark, sf):
    k = "o_orderkey"
    return rounded(read(spark, sf, "orders").select(
        k, c.unit_hash(F.lit("42"), k).alias("u"), c.unit_hash(F.lit("outer"), F.lit("42"), k, sep=":").alias("outer_u"),
        c.unit_hash(F.lit("cal"), F.lit("42"), F.lit("3"), k, sep=":").alias("cal_u"), c.unit_hash12(F.lit("42"), k).alias("u12"),
        c.job_seed(F.lit("job"), k).alias("job"), c.row_hash(k).alias("row_id")), 10)


@query("C15_truthy", """
select event_id, lower(trim(t)) in ('true', '1', 'yes', 'y') as truthy from (
  select event_id, case event_id % 6 when 0 then ' TRUE ' when 1 then 'no' when 2 then '1' when 3 then 'Yes' when 4 then event_type else 'y' end as t from events)""")
def c15(spark, sf):
    m = F.col("event_id") % 6
    t = F.when(m == 0, " TRUE ").when(m == 1, "no").when(m == 2, "1").when(m == 3, "Yes").when(m == 4, F.col("event_type")).otherwise("y")
    return read(spark, sf, "events").select("event_id", c.truthy(t).alias("truthy"))


@query("C16_scenario_id", """
select d.doc_id::varchar as sample_id, coalesce(l.quality::varchar, d.source, d.doc_id::varchar) as scenario_id
from documents d left join labels l using (doc_id)""")
def c16(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").cast("string").alias("scenario_id"), F.col("source").alias("commonroad_scenario_id"))
    return c.with_scenario_id(d).select("sample_id", "scenario_id")


LABEL_SQL = "least(substr(o_orderpriority, 1, 1)::int - 1, 3)"


@query("C17_binary_target", f"""
select o_orderkey, ({LABEL_SQL} >= 1)::int as safe_vs_risky, ({LABEL_SQL} >= 2)::int as ge2, ({LABEL_SQL} = 3)::int as emergency_only from orders""")
def c17(spark, sf):
    lab = F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3))
    return read(spark, sf, "orders").select("o_orderkey", c.binary_target(lab, "safe_vs_risky").alias("safe_vs_risky"),
                                            c.binary_target(lab, "ge2").alias("ge2"), c.binary_target(lab, "emergency_only").alias("emergency_only"))


@query("C18_round6", f"select event_id, {r('value / 7')} as x from events")
def c18(spark, sf):
    return read(spark, sf, "events").select("event_id", c.round6(F.col("value") / 7).alias("x"))


@query("C19_count_string", """
select user_id, string_agg(event_type || ':' || n, ';' order by event_type) as counts
from (select user_id, event_type, count(*) n from events group by 1, 2) group by user_id""")
def c19(spark, sf):
    return c.count_string(read(spark, sf, "events"), ["user_id"], "event_type")


@query("C19_split_counts", "select user_id, event_type as value, count(*) as n from events group by 1, 2")
def c19b(spark, sf):
    return c.split_counts(c.count_string(read(spark, sf, "events"), ["user_id"], "event_type"), "counts").drop("counts")
