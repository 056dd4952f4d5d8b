"""Source, model and streaming-window queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feaslens.catalog import scenes as sc
from feaslens.catalog.base import query, r, read, rounded
from feaslens.catalog.scores import FEAT_SQL, features
from feaslens.operators import models as ml
from feaslens.operators import splits
from feaslens.session import shared_folder
from feaslens.sources import tables as io
from feaslens.streaming import alerts as al


@query("IO1_read_table", "select o_orderkey, o_totalprice from orders")
def io1(spark, sf):
    return io.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")


@query("IO8_predictions_round_trip", "select l_orderkey::varchar || '_' || l_linenumber as sample_id, l_orderkey as scenario_id, l_extendedprice as score, (l_returnflag = 'R')::int as y_true, l_linestatus as endpoint, 'set_' || l_returnflag as feature_set from lineitem")
def io8(spark, sf):
    li = read(spark, sf, "lineitem")
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    io.write_predictions(li.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("sample_id"), F.col("l_orderkey").alias("scenario_id"), F.col("l_extendedprice").alias("score"),
                                   (F.col("l_returnflag") == "R").cast("int").alias("y_true"), F.col("l_linestatus").alias("endpoint"), F.concat(F.lit("set_"), "l_returnflag").alias("feature_set")), path)
    return spark.read.parquet(path)


@query("IO2_nested_json", """select event_id, (props::json->>'k')::int as k from events""")
def io2(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def wide_samples(spark, sf):
    """Sample documents built from the derived scenes, in the nested layout of the JSON files."""
    agents, states, lanes = sc.stored(spark, sf)
    st = states.groupBy("sample_id", "agent_id").agg(F.array_sort(F.collect_list(F.struct("k", "t_s", F.array("x", "y").alias("p"), F.array("vx", "vy").alias("v"), "heading", "valid"))).alias("s"))
    a = agents.join(st, ["sample_id", "agent_id"]).groupBy("sample_id").agg(
        F.first("scenario_id").alias("scenario_id"), F.array_sort(F.collect_list(F.struct("agent_id", "agent_type", "is_ego", F.array("x", "y").alias("xy"), F.array("vx", "vy").alias("v"), "heading", F.array("length", "width").alias("lw"), "s"))).alias("a"))
    per_lane = lanes.groupBy("sample_id", "lane_ix").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("p")))).alias("l"))
    l = per_lane.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane_ix", "l"))), lambda q: F.transform(q["l"], lambda p: p["p"])).alias("map_lane_centerlines"))
    each = lambda f: F.transform("a", f)
    return a.join(l, "sample_id", "left").select(
        "sample_id", "scenario_id", F.lit(None).cast("string").alias("commonroad_scenario_id"), (F.array_position(each(lambda q: q["is_ego"]), True) - 1).cast("int").alias("ego_index"), F.size("a").alias("agent_count"),
        each(lambda q: q["agent_id"].cast("string")).alias("agent_ids"), each(lambda q: q["agent_type"]).alias("agent_types"), F.transform(F.get("a", F.lit(0))["s"], lambda s: s["t_s"]).alias("times_s"),
        each(lambda q: q["xy"]).alias("current_xy"), each(lambda q: q["v"]).alias("current_vel_xy"), each(lambda q: q["heading"]).alias("current_heading"), each(lambda q: q["lw"]).alias("current_size_lw"),
        each(lambda q: F.transform(q["s"], lambda s: s["p"])).alias("future_xy"), each(lambda q: F.transform(q["s"], lambda s: s["v"])).alias("future_vel_xy"), each(lambda q: F.transform(q["s"], lambda s: s["heading"])).alias("future_heading"),
        each(lambda q: F.transform(q["s"], lambda s: s["valid"])).alias("future_valid"), "map_lane_centerlines", F.lit(None).cast("string").alias("_corrupt"), F.lit("derived").alias("source_file"))


@query("IO2_flatten_samples", f"with {sc.SAMPLES_SQL} select sample_id, agent_id::varchar as agent_id, is_ego, k, t_s, {r('x')} as x, {r('y')} as y, {r('heading')} as heading, valid from states")
def io2b(spark, sf):
    _, states, _, _ = io.flatten_samples(wide_samples(spark, sf))
    return rounded(states.select("sample_id", "agent_id", "is_ego", "k", "t_s", "x", "y", "heading", "valid"))


@query("IO3_scenario_xml", """
select o_orderkey as scenario, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then 'failed' else 'ok' end as parse_status, case when o_orderkey % 7 != 0 and o_orderkey % 11 != 0 then (o_orderkey % 4 + 1)::int end as lanelet_count, case when o_orderkey % 7 != 0 and o_orderkey % 11 != 0 then (o_custkey % 3)::int end as dynamic_obstacle_count,
  case when o_orderkey % 7 != 0 and o_orderkey % 11 != 0 then 1 end as planning_problem_count, case when o_orderkey % 7 != 0 and o_orderkey % 11 != 0 and o_custkey % 3 > 0 then (o_orderkey % 90)::int end as max_time_step, case when o_orderkey % 7 != 0 and o_orderkey % 11 != 0 then case when o_custkey % 3 > 0 then 'car:' || (o_custkey % 3) else '' end end as obstacle_types from orders""")
def io3(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lane = F.array_join(F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.format_string('<lanelet id="%d"/>', i)), "")
    obst = F.when(c % 3 > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest((c % 3).cast("int"), F.lit(1))), lambda i: F.format_string(
        '<dynamicObstacle id="%d"><type>car</type><trajectory><state><time><exact>%d</exact></time></state></trajectory></dynamicObstacle>', i, k % 90)), "")).otherwise("")
    xml = F.when(k % 7 == 0, F.lit("broken")).otherwise(F.concat(F.format_string('<commonRoad benchmarkID="S_%d">', k), lane, F.when(k % 11 == 0, F.lit('<lanelet id="0">')).otherwise(F.lit("")), obst, F.lit('<planningProblem id="9"/></commonRoad>')))
    docs = read(spark, sf, "orders").select(k.cast("string").alias("path"), xml.alias("text"))
    out = io.parse_scenario_xml(docs, "path", "text")
    return out.select(F.col("xml_path").cast("bigint").alias("scenario"), "parse_status", "lanelet_count", "dynamic_obstacle_count", "planning_problem_count", "max_time_step", "obstacle_types")


PATH_SQL = """pa as (select page_id, url || case page_id % 4 when 0 then '/USA_US101-1_T-1.xml' when 1 then '/highway/city-3.net.xml' when 2 then '/sumo/DEU_x.xml' else '/plain.xml' end as p, (page_id % 30)::double as dyn, (page_id % 50)::double as ln from pages)"""
TOKENS = ", ".join(f"case when lower(p) like '%{t}%' then '{t.upper() if t in io.COUNTRY_TOKENS else t}' end" for t in io.COUNTRY_TOKENS + io.ROAD_TOKENS)
BONUS = " + ".join("case when " + " or ".join(f"lower(p) like '%{w}%'" for w in ws) + f" then {g} else 0 end" for ws, g in io.BONUSES)


def paths(spark, sf):
    m = F.col("page_id") % 4
    tail = F.when(m == 0, "/USA_US101-1_T-1.xml").when(m == 1, "/highway/city-3.net.xml").when(m == 2, "/sumo/DEU_x.xml").otherwise("/plain.xml")
    return read(spark, sf, "pages").select("page_id", F.concat("url", tail).alias("xml_path"), (F.col("page_id") % 30).cast("double").alias("dynamic_obstacle_count"), (F.col("page_id") % 50).cast("double").alias("lanelet_count"))


@query("IO4_path_attributes", f"""
with {PATH_SQL} select page_id, case page_id % 4 when 0 then 'USA' when 1 then 'city' when 2 then 'DEU' else regexp_extract(p, '([^/]+)/[^/]+$', 1) end as scenario_family, coalesce(nullif(concat_ws('|', {TOKENS}), ''), 'unknown') as source_hint, {r(f'dyn * 2 + ln * 0.2 + {BONUS}')} as difficulty_score from pa""")
def io4(spark, sf):
    return rounded(io.path_attributes(paths(spark, sf), "xml_path").select("page_id", "scenario_family", "source_hint", "difficulty_score"))


@query("IO5_filter_manifest", f"with {PATH_SQL} select page_id from pa where page_id % 4 in (0, 3) and dyn >= 1 and ln >= 1 and page_id % 60 >= 20 and page_id % 5 != 0")
def io5(spark, sf):
    man = paths(spark, sf).withColumns({"planning_problem_count": F.lit(1), "max_time_step": F.col("page_id") % 60, "parse_status": F.when(F.col("page_id") % 5 == 0, "failed").otherwise("OK")})
    return io.filter_manifest(man, 20).select("page_id")


@query("IO6_union_rows", """
select o_orderkey as id, o_totalprice as score, null as segment, 'abc' as config_hash from orders union all select c_custkey, null, c_mktsegment, 'abc' from customer""")
def io6(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    b = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return io.union_rows(a, b).withColumn("config_hash", F.lit("abc"))


def digest_sql(columns: str, rows: str) -> str:
    """``digests(h)`` of rows and ``lanes`` from them."""
    text = " || ".join(f"coalesce('v' || length({c}::varchar) || ':' || {c}::varchar, 'n')" for c in sorted(columns.split()))
    return f"select sha256({text}) as h from {rows}"


def fingerprint_sql(columns: str, digests: str) -> str:
    lane = lambda i: f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::ubigint::hugeint) % {io.LANE}, 0)::ubigint"
    return f"select '{','.join(sorted(columns.split()))}' as columns, count(*) as row_count, " + " || ".join(f"lpad(lower(to_hex({lane(i)})), 8, '0')" for i in range(io.LANES)) + f" as hash from ({digests})"


LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_orderpriority"


@query("IO7_fingerprint", fingerprint_sql(LINE_COLUMNS, digest_sql(LINE_COLUMNS, "lineitem")))
def io7(spark, sf):
    return io.fingerprint(read(spark, sf, "lineitem").select(*LINE_COLUMNS.split())).drop("lanes")


@query("IO7_fingerprint_of_increments", fingerprint_sql(ORDER_COLUMNS, digest_sql(ORDER_COLUMNS, "(select * from orders where o_orderstatus <> 'P')")))
def io7_increments(spark, sf):
    """The open and the finished orders from the fingerprints of the parts of the table: all parts added, the pending one taken away again."""
    orders = read(spark, sf, "orders").select(*ORDER_COLUMNS.split())
    part = lambda status: io.fingerprint(orders.filter(F.col("o_orderstatus") == status))
    return io.combined(part("F").unionByName(part("O")).unionByName(part("P")), part("P")).drop("lanes")


@query("IO9_pending", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def io9(spark, sf):
    return io.pending(read(spark, sf, "orders"), read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


PROFILE = {"pair": ("o_totalprice", "o_custkey", "gone"), "flat": ("zero", "hole")}


@query("ML1_feature_profile", f"""
with t as (select o_totalprice, o_custkey, 0.0 as zero, case when o_orderkey % 4 != 0 then o_totalprice end as hole from orders)
select feature_set, "column", present, {r('nn')} as non_null_fraction, {r('nn')} as finite_fraction, constant, present and nn > 0 as usable from (
select 'pair' as feature_set, 'o_totalprice' as "column", true as present, 1.0 as nn, false as constant union all select 'pair', 'o_custkey', true, 1.0, false union all select 'pair', 'gone', false, 0.0, true union all select 'flat', 'zero', true, 1.0, true
union all select 'flat', 'hole', true, (select avg((hole is not null)::int) from t), false)""")
def ml1(spark, sf):
    o = read(spark, sf, "orders").select("o_totalprice", "o_custkey", F.lit(0.0).alias("zero"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("hole"))
    return rounded(ml.feature_profile(o, PROFILE))


@query("ML2_preprocessor", f"""
with {FEAT_SQL}, m as (select median(case when current_ttc_s >= 0 then current_ttc_s end) a, median(headway_m) b, median(road_margin_m) c from ft)
select sample_id, {r('coalesce(case when current_ttc_s >= 0 then current_ttc_s end, a)')} as f0, {r('coalesce(headway_m, b)')} as f1, {r('coalesce(road_margin_m, c)')} as f2 from ft, m""")
def ml2(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = features(spark, sf)
    pre = ml.fit_preprocessor(df, ["current_ttc_s", "headway_m", "road_margin_m"])
    v = vector_to_array("features")
    return rounded(pre.apply(df).select("sample_id", v[0].alias("f0"), v[1].alias("f1"), v[2].alias("f2")))


@query("ML9_balanced_weight", f"select o_orderkey, {r('count(*) over () / (2.0 * count(*) over (partition by o_orderstatus = $$F$$))')} as weight from orders")
def ml9(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(ml.balanced_weight(o, "y").select("o_orderkey", "weight"))


COLS = ["current_min_distance_m", "current_ttc_s", "ego_speed_mps", "road_margin_m"]


def model_rows(spark, sf):
    f = features(spark, sf)
    return f.withColumn("label", ((F.col("current_min_distance_m") < 40) & (F.col("ego_speed_mps") > 5)).cast("int"))


@query("ML3_ML5_oof_forest")
def ml5(spark, sf):
    return ml.grouped_oof(model_rows(spark, sf), COLS, "label", "scenario_id", 5, 42, "rf")


@query("ML4_ML6_calibrated_oof")
def ml6(spark, sf):
    return ml.calibrated_oof(model_rows(spark, sf), COLS, "label", "scenario_id", 5, 42, "logreg")


@query("ML7_train_grid")
def ml7(spark, sf):
    return ml.train_grid(model_rows(spark, sf), {"near": COLS[:2], "all": COLS}, {"label": "label"}, ["logreg", "rf"], "scenario_id")


@query("ML8_permutation_importance")
def ml8(spark, sf):
    """80 trees on all columns; five shuffles a column, judged on the quarter of the scenarios that is held out."""
    rows = splits.hash_split(model_rows(spark, sf).withColumn("y", F.col("label")), "scenario_id", 0.25, 42)
    pre, model = ml.fit(rows.filter(~F.col("is_test")), COLS, "rf", 42)
    return ml.permutation_importance(rows.filter("is_test"), pre, model, "sample_id")


CELLS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("ML8_shuffled_cells", """
with v as (select unnest([o_orderkey, o_custkey, round(o_totalprice * 100)::bigint]) as x, unnest([0, 1, 2]) as column_ix from orders)
select column_ix, repeat::int as repeat, count(*) as cells, count(*) as places, 0::bigint as first_place, count(*) - 1 as last_place, sum(x)::bigint as total from v, range(3) t(repeat) group by 1, 2""")
def ml8_cells(spark, sf):
    """Each of nine shuffles of the orders moves every value to a place of its own."""
    o = read(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("x"))
    cells = ml.shuffled_cells(ml.in_hash_order(o, "o_orderkey", 7), "x", CELLS, 7, 3)
    once = cells.groupBy("column_ix", "repeat", "ix").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return once.groupBy("column_ix", "repeat").agg(F.sum("n").alias("cells"), F.count("*").alias("places"), F.min("ix").alias("first_place"), F.max("ix").alias("last_place"), F.sum("s").alias("total"))


@query("J8_residual_association")
def j8(spark, sf):
    return rounded(ml.residual_association(model_rows(spark, sf), "label", COLS[:2], ["ego_speed_mps", "road_margin_m"]))


def frames(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("scenario_id"), "ts", F.col("value").alias("score"))


def window_sql(start: str, size: str) -> str:
    return f"""select user_id as scenario_id, {start} as window_start, {start} + {size} as window_end, {r('avg(value)')} as mean_score, max(value) as max_score, sum((value >= 100)::int)::bigint as alerts, count(*) as n_frames from events"""


@query("ST2_tumbling", f"{window_sql('time_bucket(interval 1 hour, ts)', 'interval 1 hour')} group by 1, 2")
def st2(spark, sf):
    return rounded(al.risk_rollup(frames(spark, sf), "tumbling", "1 hour", threshold=100.0))


@query("ST2_sliding", f"""
with w as (select *, time_bucket(interval 1 hour, ts) - k * interval 1 hour as s from events, range(3) t(k)) select user_id as scenario_id, s as window_start, s + interval 3 hour as window_end, {r('avg(value)')} as mean_score, max(value) as max_score, sum((value >= 100)::int)::bigint as alerts, count(*) as n_frames from w group by 1, 2""")
def st2b(spark, sf):
    return rounded(al.risk_rollup(frames(spark, sf), "sliding", "3 hours", "1 hour", 100.0))


@query("ST2_session", f"""
with g as (select *, coalesce(ts - lag(ts) over w >= interval 2 hour, true)::int as fresh from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from g)
select user_id as scenario_id, min(ts) as window_start, max(ts) + interval 2 hour as window_end, {r('avg(value)')} as mean_score, max(value) as max_score, sum((value >= 100)::int)::bigint as alerts, count(*) as n_frames from s group by user_id, sid""")
def st2c(spark, sf):
    return rounded(al.risk_rollup(frames(spark, sf), "session", "2 hours", threshold=100.0))


ONSETS = al.OnsetRule(threshold=100.0, min_pre_s=3600.0, lateness_s=10.0, expire_s=60.0)


@query("ST1_alert_onsets", f"""
with f as (select user_id as scenario_id, epoch_us(ts) as t, (event_type = 'purchase')::int as y, value as score from events),
z as (select scenario_id, min(t) as t0, max(t) as last, min(case when y = 0 then t end) as zero from f group by 1),
o as (select scenario_id, min(f.t) as onset, any_value(t0) as t0, any_value(last) as last from f join z using (scenario_id) where y = 1 and t >= zero group by 1),
a as (select scenario_id, min(f.t) as alert from f join o using (scenario_id) where score >= {ONSETS.threshold} and (t < onset or (t = onset and y = 0)) group by 1),
v as (select *, onset - t0 >= {ONSETS.min_pre_s} * 1e6 as valid from o left join a using (scenario_id) where last + {ONSETS.expire_s} * 1e6 < (select max(t) from f) - {ONSETS.lateness_s} * 1e6)
select scenario_id::varchar as scenario_id, {r('onset / 1e6')} as event_time_s, case when valid then {r('alert / 1e6')} end as first_alert_time_s,
  case when valid then {r('(onset - alert) / 1e6', 3)} end as lead_time_s, valid and alert is null as missed_event, valid from v""")
def st1(spark, sf):
    """The stored events as a stream that runs until nothing new is left. Users seen within the lateness and expiry of the
    last event are still open then and come with a later run."""
    events = read(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    rows = stream.select(F.col("user_id").cast("string").alias("scenario_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("score"))
    out = al.run_available(al.alert_onsets(rows, ONSETS), f"{shared_folder(spark)}/onsets-{uuid.uuid4().hex}")
    return out.select("scenario_id", F.bround("event_time_s", 6).alias("event_time_s"), F.bround("first_alert_time_s", 6).alias("first_alert_time_s"), F.bround("lead_time_s", 3).alias("lead_time_s"), "missed_event", "valid")
