"""Scenes that Spark derives from the driver tables: a customer is a scenario, each of its orders an agent track.

The SQL twins build the same tracks, so every track operator can be checked on all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feaslens.catalog.base import read
from feaslens.functions.columns import cos, sin
from feaslens.operators import samples as sm
from feaslens.session import checkpointed

STEPS = 9
DT = 0.5
BASE = 2
FUTURE = 6
ROI = sm.Roi(-30.0, 50.0, -25.0, 25.0)


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    first = o.groupBy("c").agg(F.min("o").alias("first"))
    k = F.col("o")
    base = o.join(first, "c").select(
        F.col("c").cast("string").alias("scenario_id"), k.alias("track_id"),
        F.when(k % 10 == 0, "pedestrian").when(k % 10 == 5, "cyclist").otherwise("vehicle").alias("object_type"), (k == F.col("first")).alias("is_ego"),
        (k * 7919 % 12000 / 100.0 - 60.0).alias("x0"), (k * 104729 % 4000 / 100.0 - 20.0).alias("y0"), ((k * 13 % 63 - 31) * 0.1).alias("heading"),
        (k * 17 % 150 / 10.0).alias("v"), (4.0 + (k % 3) * 0.5).alias("length"), (1.8 + (k % 2) * 0.2).alias("width"))
    base = base.withColumns({"vx": F.col("v") * cos("heading"), "vy": F.col("v") * sin("heading")})
    # A join and no explode, which Spark would estimate at the size of the orders: the nine-fold table then went through the driver.
    base = base.crossJoin(F.broadcast(spark.range(STEPS).select(F.col("id").cast("int").alias("step"))))
    t = F.col("step") * F.lit(DT)
    return base.select("scenario_id", "track_id", "object_type", "is_ego", "step", t.alias("t_s"), ((F.col("track_id") * 31 + F.col("step") * 17) % 11 != 0).alias("valid"),
                       (F.col("x0") + F.col("vx") * t).alias("x"), (F.col("y0") + F.col("vy") * t).alias("y"), "vx", "vy", "heading", "length", "width")


def map_lanes(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select("c_custkey")
    rows = c.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("lane_id")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"))
    return rows.select(F.col("c_custkey").cast("string").alias("scenario_id"), "lane_id", "seq", (F.col("seq") * 40.0 - 80.0).alias("x"),
                       ((F.col("lane_id") - 1) * 6.0 + (F.col("c_custkey") % 7 - 3) * 0.5 * (F.col("seq") % 2)).alias("y"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("scenario_id")).distinct().withColumn("step", F.lit(BASE))


def samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sm.build_samples(tracks(spark, sf), steps(spark, sf), ROI, FUTURE, 2, ("vehicle", "cyclist"))


def lanes(spark: SparkSession, sf: str) -> DataFrame:
    poses = sm.ego_poses(tracks(spark, sf), steps(spark, sf))
    agents, _ = samples(spark, sf)
    keep = agents.filter("is_ego").select("sample_id")
    return sm.lanes_near(poses.join(keep, "sample_id", "left_semi"), map_lanes(spark, sf), ROI)


def stored(spark: SparkSession, sf: str, future: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Agents, states and lanes written once, for plans that read them several times. States are left as a plan where no ``future`` is read."""
    agents, states = samples(spark, sf)
    agents = checkpointed(agents)
    poses = sm.ego_poses(tracks(spark, sf), steps(spark, sf))
    near = sm.lanes_near(poses.join(agents.filter("is_ego").select("sample_id"), "sample_id", "left_semi"), map_lanes(spark, sf), ROI)
    return agents, checkpointed(states) if future else states, checkpointed(near)


TRACKS_SQL = f"""tr as (
  select c::varchar as scenario_id, o as track_id, case when o % 10 = 0 then 'pedestrian' when o % 10 = 5 then 'cyclist' else 'vehicle' end as object_type,
         is_ego, k::int as step, k * {DT}::double as t_s, (o * 31 + k * 17) % 11 != 0 as valid, x0 + v * cos(heading) * (k * {DT}::double) as x, y0 + v * sin(heading) * (k * {DT}::double) as y,
         v * cos(heading) as vx, v * sin(heading) as vy, heading, length, width
  from (select o_custkey as c, o_orderkey as o, o_orderkey = min(o_orderkey) over (partition by o_custkey) as is_ego, (o_orderkey * 7919 % 12000) / 100.0::double - 60.0 as x0,
               (o_orderkey * 104729 % 4000) / 100.0::double - 20.0 as y0, (o_orderkey * 13 % 63 - 31) * 0.1::double as heading, (o_orderkey * 17 % 150) / 10.0::double as v,
               4.0::double + (o_orderkey % 3) * 0.5::double as length, 1.8::double + (o_orderkey % 2) * 0.2::double as width from orders), range({STEPS}) s(k))"""


def wrap_sql(a: str) -> str:
    return f"(({a}) + pi() - 2 * pi() * floor((({a}) + pi()) / (2 * pi())) - pi())"


LOCAL_X, LOCAL_Y = "cos(oh) * (x - ox) + sin(oh) * (y - oy)", "cos(oh) * (y - oy) - sin(oh) * (x - ox)"
SAMPLES_SQL = f"""{TRACKS_SQL},
ego as (select scenario_id, track_id as ego_id, x as ox, y as oy, heading as oh, t_s as base_t from tr where is_ego and step = {BASE} and valid and object_type = 'vehicle'),
loc as (select e.scenario_id || '_' || lpad('{BASE}', 4, '0') as sample_id, t.scenario_id, track_id as agent_id, object_type as agent_type, track_id = ego_id as is_ego, {LOCAL_X} as x, {LOCAL_Y} as y,
  cos(oh) * vx + sin(oh) * vy as vx, cos(oh) * vy - sin(oh) * vx as vy, {wrap_sql('heading - oh')} as heading, length, width, ox, oy, oh, base_t
  from tr t join ego e on t.scenario_id = e.scenario_id where step = {BASE} and valid and object_type in ('vehicle', 'cyclist')),
inroi as (select * from loc where is_ego or (x between {ROI.x_min} and {ROI.x_max} and y between {ROI.y_min} and {ROI.y_max})),
agents as (select * from inroi where sample_id in (select sample_id from inroi group by 1 having count(*) >= 2)),
states as (select a.sample_id, a.agent_id, a.is_ego, (t.step - {BASE})::int as k, t.t_s - base_t as t_s, case when t.valid then cos(oh) * (t.x - ox) + sin(oh) * (t.y - oy) end as x,
  case when t.valid then cos(oh) * (t.y - oy) - sin(oh) * (t.x - ox) end as y, case when t.valid then cos(oh) * t.vx + sin(oh) * t.vy end as vx, case when t.valid then cos(oh) * t.vy - sin(oh) * t.vx end as vy,
  case when t.valid then {wrap_sql('t.heading - oh')} end as heading, t.valid, a.length, a.width
  from agents a join tr t on a.scenario_id = t.scenario_id and a.agent_id = t.track_id and t.step between {BASE} and {BASE + FUTURE})"""

LANES_SQL = f"""ml as (select c_custkey::varchar as scenario_id, l::int as lane_id, s::int as seq, s * 40.0::double - 80.0 as x, (l - 1) * 6.0::double + (c_custkey % 7 - 3) * 0.5::double * (s % 2) as y
  from customer, range(3) a(l), range(5) b(s)),
lr as (select e.sample_id, lane_id as lane_ix, seq, cos(oh) * (m.x - ox) + sin(oh) * (m.y - oy) as x, cos(oh) * (m.y - oy) - sin(oh) * (m.x - ox) as y
  from (select sample_id, scenario_id, ox, oy, oh from agents where is_ego) e join ml m using (scenario_id)),
lanes as (select * from lr where (sample_id, lane_ix) in (select (sample_id, lane_ix) from lr where x between {ROI.x_min - 10} and {ROI.x_max + 10} and y between {ROI.y_min - 10} and {ROI.y_max + 10})),
seg as (select * from (select sample_id, lane_ix, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2, lead(seq, 2) over w is not null as "inner" from lanes window w as (partition by sample_id, lane_ix order by seq)) where x2 is not null)"""


def overlap_sql(a: str, b: str, ga: float = 0.0) -> str:
    """Separating axes between poses ``a`` and ``b`` (aliases with x, y, heading, length, width); ``ga`` grows a."""
    hl, hw = f"({a}.length / 2 + {ga})", f"({a}.width / 2 + {ga})"
    bl, bw = f"({b}.length / 2)", f"({b}.width / 2)"
    dx, dy = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)"
    cd, sd = f"abs(cos({a}.heading - {b}.heading))", f"abs(sin({a}.heading - {b}.heading))"
    along = lambda h: f"abs({dx} * cos({h}.heading) + {dy} * sin({h}.heading))"
    across = lambda h: f"abs({dy} * cos({h}.heading) - {dx} * sin({h}.heading))"
    return (f"({along(a)} <= {hl} + {bl} * {cd} + {bw} * {sd} + 1e-9 and {across(a)} <= {hw} + {bl} * {sd} + {bw} * {cd} + 1e-9 and "
            f"{along(b)} <= {bl} + {hl} * {cd} + {hw} * {sd} + 1e-9 and {across(b)} <= {bw} + {hl} * {sd} + {hw} * {cd} + 1e-9)")


def distance_sql(a: str, b: str) -> str:
    def corner(p: str, q: str, i: int, j: int) -> str:
        px = f"({p}.x + {i} * {p}.length / 2 * cos({p}.heading) - {j} * {p}.width / 2 * sin({p}.heading))"
        py = f"({p}.y + {i} * {p}.length / 2 * sin({p}.heading) + {j} * {p}.width / 2 * cos({p}.heading))"
        u = f"greatest(abs(({px} - {q}.x) * cos({q}.heading) + ({py} - {q}.y) * sin({q}.heading)) - {q}.length / 2, 0)"
        v = f"greatest(abs(({py} - {q}.y) * cos({q}.heading) - ({px} - {q}.x) * sin({q}.heading)) - {q}.width / 2, 0)"
        return f"({u} * {u} + {v} * {v})"
    parts = [corner(p, q, i, j) for p, q in ((a, b), (b, a)) for i, j in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
    return f"(case when {overlap_sql(a, b)} then 0.0 else sqrt(least({', '.join(parts)})) end)"


def gap2_sql(p: str, s: str = "s") -> str:
    """Squared buffer at which point alias ``p`` gets on segment alias ``s``; null when none does."""
    e2 = f"(({s}.x2 - {s}.x1) ** 2 + ({s}.y2 - {s}.y1) ** 2)"
    along = f"(({p}.x - {s}.x1) * ({s}.x2 - {s}.x1) + ({p}.y - {s}.y1) * ({s}.y2 - {s}.y1))"
    across = f"(({p}.x - {s}.x1) * ({s}.y2 - {s}.y1) - ({p}.y - {s}.y1) * ({s}.x2 - {s}.x1))"
    return f"least(case when {along} >= 0 and {along} <= {e2} then {across} ** 2 / {e2} end, case when {s}.\"inner\" then ({p}.x - {s}.x2) ** 2 + ({p}.y - {s}.y2) ** 2 end)"
