"""Sample construction, proximity, rollout and candidate queries on scenes derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog import scenes as sc
from feaslens.catalog.base import query, r, rcol, read, rounded
from feaslens.catalog.columns import hash_sql
from feaslens.catalog.scenes import DT, FUTURE, LANES_SQL, SAMPLES_SQL, TRACKS_SQL, distance_sql, gap2_sql, overlap_sql
from feaslens.functions import geometry as geo
from feaslens.operators import actions as ac
from feaslens.operators import checked
from feaslens.operators import labels as lb
from feaslens.operators import proximity as px
from feaslens.operators import samples as sm
from feaslens.session import checkpointed


@query("SC1_screen_scenarios", f"""
with {TRACKS_SQL}, e as (select scenario_id, track_id, object_type, valid, x as ox, y as oy, heading as oh from tr where is_ego and step = 2),
c as (select e.scenario_id, max(track_id) as ego, bool_or(e.valid) as ok, max(e.object_type) as tp, coalesce(sum((cos(oh) * (t.x - ox) + sin(oh) * (t.y - oy) between -30 and 50 and cos(oh) * (t.y - oy) - sin(oh) * (t.x - ox) between -25 and 25)::int), 0)::bigint as n
  from e left join (select scenario_id, x, y from tr where step = 2 and valid and object_type = 'vehicle') t using (scenario_id) group by 1),
w as (select *, case when tp != 'vehicle' then 'ego_not_vehicle' when not ok then 'ego_current_invalid' when n < 5 then 'too_few_vehicles_in_roi' else 'ok' end as reason from c)
select scenario_id, 2 as step, reason = 'ok' as keep, reason, case when reason in ('ok', 'too_few_vehicles_in_roi') then n else 0 end as vehicle_count_roi,
  case when reason in ('ok', 'too_few_vehicles_in_roi') then ego else -1 end as ego_track_id, reason in ('ok', 'too_few_vehicles_in_roi') as has_future from w""")
def sc1(spark, sf):
    return sm.screen_scenarios(sc.tracks(spark, sf), sc.steps(spark, sf), sc.ROI, FUTURE, 5)


@query("SC2_SC3_SC4_agents", f"with {SAMPLES_SQL} select sample_id, scenario_id, agent_id, agent_type, is_ego, {r('x')} as x, {r('y')} as y, {r('vx')} as vx, {r('vy')} as vy, {r('heading')} as heading, length, width from agents")
def sc4(spark, sf):
    return rounded(sc.samples(spark, sf)[0].drop("base_step"))


@query("SC4_states", f"with {SAMPLES_SQL} select sample_id, agent_id, is_ego, k, t_s, {r('x')} as x, {r('y')} as y, {r('vx')} as vx, {r('vy')} as vy, {r('heading')} as heading, valid from states")
def sc4b(spark, sf):
    return rounded(sc.samples(spark, sf)[1].drop("length", "width"))


@query("SC3_object_types", "select o_orderkey, case o_orderkey % 5 when 1 then 'vehicle' when 2 then 'pedestrian' when 3 then 'cyclist' else 'other' end as t from orders")
def sc3(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", sm.object_type_name(F.col("o_orderkey") % 5).alias("t"))


@query("SC5_lanes_near", f"with {SAMPLES_SQL}, {LANES_SQL} select sample_id, lane_ix, seq, {r('x')} as x, {r('y')} as y from lanes")
def sc5(spark, sf):
    return rounded(sc.lanes(spark, sf))


@query("SC6_rolling_steps", "select c_custkey, (10 + c_custkey % 50)::bigint as n_steps, k::int as step from customer, range(0, 100, 3) t(k) where k <= 10 + c_custkey % 50 - 1 - 6")
def sc6(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", (10 + F.col("c_custkey") % 50).alias("n_steps"))
    return sm.rolling_steps(c, 3, 0, None, 6)


@query("SC6_rolling_offsets", """
select c_custkey, b + o as step from (select c_custkey, 10 + c_custkey % 50 as n, c_custkey % 11 as b from customer), (select unnest([-4, 0, 4]) as o) where b + o >= 0 and b + o + 6 < n""")
def sc6b(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", (10 + F.col("c_custkey") % 50).alias("n_steps"), (F.col("c_custkey") % 11).alias("base_step"))
    return sm.rolling_offsets(c, (-4, 0, 4), 6).select("c_custkey", "step")


@query("SC7_SC8_discover_egos", f"""
with {TRACKS_SQL}, n as (select * from tr where valid and step % 4 = 0), c as (select scenario_id, step, count(*) as agent_count from n group by 1, 2),
e as (select n.*, sqrt(vx * vx + vy * vy) as speed, agent_count from n join c using (scenario_id, step) where object_type = 'vehicle' and sqrt(vx * vx + vy * vy) >= 2.0 and agent_count >= 4),
p as (select e.scenario_id, e.track_id as ego_id, e.step, agent_count, speed, {distance_sql('e', 'o')} as d, sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2) as cd,
  -((o.x - e.x) * (o.vx - e.vx) + (o.y - e.y) * (o.vy - e.vy)) / nullif(sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2), 0) as cl, sqrt(e.length ** 2 + e.width ** 2) / 2 + sqrt(o.length ** 2 + o.width ** 2) / 2 as rad
  from e join n o on e.scenario_id = o.scenario_id and e.step = o.step and e.track_id != o.track_id),
a as (select scenario_id, ego_id, step, max(agent_count) as agent_count, max(speed) as ego_speed_mps, min(d) as dm, coalesce(min(case when cd > 1e-6 and cl > 1e-6 then greatest(cd - rad, 0) / cl end), -1.0) as ttc from p group by 1, 2, 3)
select scenario_id, ego_id, step, agent_count, {r('ego_speed_mps')} as ego_speed_mps, {r('dm')} as current_min_distance_m, {r('ttc', 4)} as current_ttc_s,
  case when dm < 3 then 'close_interaction' when dm < 10 then 'medium_interaction' when agent_count - 1 >= 5 then 'far_but_interactive' else 'random_fill' end as bucket from a""")
def sc7(spark, sf):
    out = sm.discover_egos(sc.tracks(spark, sf), 4, 2.0, 3)
    return rounded(out.withColumn("current_ttc_s", rcol(F.col("current_ttc_s"), 4)))


@query("SC10_fill_future", f"""
with {SAMPLES_SQL} select s.sample_id, s.agent_id, k, {r('case when not valid and s.is_ego then a.x + a.vx * k * 0.5 else s.x end')} as x, {r('case when not valid and s.is_ego then a.y + a.vy * k * 0.5 else s.y end')} as y,
  {r('case when not valid and s.is_ego then a.heading else s.heading end')} as heading, valid or s.is_ego as valid, not valid and s.is_ego as cv_used from states s join agents a using (sample_id, agent_id)""")
def sc10(spark, sf):
    agents, states = sc.samples(spark, sf)
    return rounded(sm.fill_future_cv(states, agents, DT).select("sample_id", "agent_id", "k", "x", "y", "heading", "valid", "cv_used"))


def normal_sql(kind: str, tag: str) -> str:
    u = lambda s: hash_sql(f"'7|{kind}|{tag}{s}|' || sample_id || '|' || agent_id")
    return f"sqrt(-2 * ln(greatest({u('a')}, 1e-300))) * cos(2 * pi() * {u('b')})"


@query("SC12_perturb", f"""
with {SAMPLES_SQL}
select 'position' as kind, sample_id, agent_id, {r(f"case when is_ego then x else x + 0.5 * {normal_sql('position', 'x')} end")} as x, {r(f"case when is_ego then y else y + 0.5 * {normal_sql('position', 'y')} end")} as y from agents
union all select 'dropout', sample_id, agent_id, {r('x')}, {r('y')} from agents where is_ego or {hash_sql("'7|dropout|drop|' || sample_id || '|' || agent_id")} >= 0.3""")
def sc12(spark, sf):
    agents, _ = sc.samples(spark, sf)
    pick = lambda k, v: sm.perturb(agents, k, v, 7).select(F.lit(k).alias("kind"), "sample_id", "agent_id", "x", "y")
    return rounded(pick("position", 0.5).unionByName(pick("dropout", 0.3)))


PAIRS = "pr as (select e.sample_id, o.agent_id, {what} from agents e join agents o on e.sample_id = o.sample_id and e.is_ego and not o.is_ego)"


@query("PX1_PX2_boxes", f"with {SAMPLES_SQL}, {PAIRS.format(what=overlap_sql('e', 'o') + ' as hit, ' + distance_sql('e', 'o') + ' as gap')} select sample_id, agent_id, hit, {r('gap')} as gap from pr")
def px12(spark, sf):
    agents, _ = sc.samples(spark, sf)
    rows = geo.with_box(agents)
    ego = rows.filter("is_ego").select("sample_id", *[F.col(f).alias(f"e{f}") for f in geo.BOX_FIELDS])
    pairs = rows.filter("not is_ego").join(ego, "sample_id")
    a, b = geo.box("e"), geo.box("")
    return rounded(pairs.select("sample_id", "agent_id", geo.obb_overlap(a, b).alias("hit"), geo.obb_distance(a, b).alias("gap")))


@query("PX3_current_proximity", f"""
with {SAMPLES_SQL}, pr as (select e.sample_id, o.agent_id, {distance_sql('e', 'o')} as d, (o.x - e.x) * (o.vx - e.vx) + (o.y - e.y) * (o.vy - e.vy) as dot, (o.vx - e.vx) ** 2 + (o.vy - e.vy) ** 2 as vv,
  greatest(sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2), 1e-6) as cd from agents e join agents o on e.sample_id = o.sample_id and e.is_ego and not o.is_ego),
q as (select *, case when vv > 1e-6 and dot < 0 then -dot / vv end as ttc, greatest(-dot / cd, 0) as cl from pr)
select sample_id, {r('min(d)')} as current_min_distance_m, min(d) = 0 as current_collision, {r('coalesce(min(ttc), -1)', 5)} as current_ttc_s, arg_min(agent_id, {{'d': d, 'i': agent_id}}) as nearest_agent_id,
  {r("arg_min(sqrt(vv), {'d': d, 'i': agent_id})")} as nearest_agent_rel_speed_mps, {r("arg_min(cl, {'d': d, 'i': agent_id})")} as nearest_agent_closing_speed_mps, {r('coalesce(arg_min(cl, ttc), 0)')} as ttc_closing_speed_mps,
  sum((d <= 10)::int)::bigint as nearby_agent_count_10m, sum((d <= 20)::int)::bigint as nearby_agent_count_20m from q group by 1""")
def px3(spark, sf):
    out = px.current_proximity(sc.samples(spark, sf)[0])
    return rounded(out.withColumn("current_ttc_s", rcol(F.col("current_ttc_s"), 5)))


@query("PX4_current_kinematics", f"""
with {SAMPLES_SQL}, {LANES_SQL}, b as (select e.sample_id, o.agent_id, o.x - e.x as rx, o.y - e.y as ry, o.vx - e.vx as rvx, o.vy - e.vy as rvy, sqrt(e.vx ** 2 + e.vy ** 2) as sp,
  case when sqrt(e.vx ** 2 + e.vy ** 2) > 1e-3 then e.vx / sqrt(e.vx ** 2 + e.vy ** 2) else cos(e.heading) end as hx, case when sqrt(e.vx ** 2 + e.vy ** 2) > 1e-3 then e.vy / sqrt(e.vx ** 2 + e.vy ** 2) else sin(e.heading) end as hy,
  sqrt(e.length ** 2 + e.width ** 2) / 2 + sqrt(o.length ** 2 + o.width ** 2) / 2 as rad from agents e join agents o on e.sample_id = o.sample_id and e.is_ego and not o.is_ego),
c as (select *, sqrt(rx ** 2 + ry ** 2) as cd, rx * hx + ry * hy as lon, ry * hx - rx * hy as lat, rvy * hx - rvx * hy as latv, rvx * hx + rvy * hy as lonv from b),
g as (select *, greatest(cd - rad, 0) as gap, greatest(-case when cd > 1e-6 then (rvx * rx + rvy * ry) / cd else lonv end, 0) as ncl, abs(latv) as nlat, greatest(abs(lat) - rad, 0) as nclear, lon - rad as ahead, greatest(-lonv, 0) as hcl,
  lon - rad > 0 and abs(lat) <= greatest(3.5, rad) as gated from c),
s as (select sample_id, agent_id, k, sqrt((rx + rvx * k * 0.5) ** 2 + (ry + rvy * k * 0.5) ** 2) - rad as sep, rad from g, range(7) t(k)),
sp as (select sample_id, min(sep) as ms, min(case when sep <= 0 then k * 0.5 end) as hit, sum(greatest(0, least(1, 1 - sep / greatest(rad + 1, 1))) * 0.5) as ov from s group by 1),
m as (select e.sample_id, 1.75 - min(sqrt((l.x - e.x) ** 2 + (l.y - e.y) ** 2)) as margin from agents e join lanes l using (sample_id) where e.is_ego group by 1),
a as (select sample_id, max(sp) as speed, min({{'gap': gap, 'id': agent_id, 'c': ncl, 'l': nlat, 'k': nclear}}) as n, min({{'a': ahead, 'id': agent_id, 'c': hcl, 'l': nlat}}) filter (gated) as h from g group by 1)
select sample_id, {r('speed')} as ego_speed_mps_current, {r('n.gap')} as current_state_min_distance_m, {r('coalesce(h.a, n.gap)')} as headway_m, {r('coalesce(h.c, n.c)')} as nearest_agent_closing_speed_mps,
  {r('coalesce(h.l, n.l)')} as nearest_agent_lateral_speed_mps, {r('n.k')} as current_lateral_clearance_m, {r('ms')} as cv_min_predicted_separation_3s_m, {r('hit')} as cv_min_collision_time_3s_s,
  {r('ov')} as cv_occupancy_overlap_integral_3s, {r('margin')} as road_margin_m, case when margin is null then 'map_lane_centerlines unavailable' else '' end as road_margin_unavailable_reason
from a join sp using (sample_id) left join m using (sample_id)""")
def px4(spark, sf):
    return rounded(px.current_kinematics(sc.samples(spark, sf)[0], sc.lanes(spark, sf), 3.0, 0.5))


FUTURE_SQL = f"""fd as (select e.sample_id, o.agent_id, e.k, e.t_s, {distance_sql('e', 'o')} as d from states e join states o on e.sample_id = o.sample_id and e.k = o.k and e.is_ego and not o.is_ego and e.valid and o.valid and e.k >= 1 and e.t_s <= 2.0),
fm as (select s.sample_id, b.d as d_min, b.t_s as t_at, coalesce(b.d = 0, false) as hit, b.id as conflict from (select distinct sample_id from states) s left join
  (select sample_id, min({{'d': d, 'id': agent_id, 'k': k, 't_s': t_s}}) as b from fd group by 1) using (sample_id))"""


@query("PX5_future_min_distance", f"with {SAMPLES_SQL}, {FUTURE_SQL} select sample_id, {r('d_min')} as d_min, t_at as t_at_dmin, hit as collision_any, conflict as conflict_track_id from fm")
def px5(spark, sf):
    return rounded(px.future_min_distance(sc.samples(spark, sf)[1], 2.0))


@query("PX6_proximity_label", """
select event_id, round_even(value / 30, 4) + 0.0 as dmin_future_m, round_even((event_id % 21) / 10.0::double - 0.1::double, 4) + 0.0 as t_at_dmin_s, event_type = 'error' and value < 10 as collision_any, l as label_id,
  ['safe', 'caution', 'warning', 'emergency'][l + 1] as label_name, round_even(least(1, 0.5 * exp(-value / 30 / 2) + 0.25 * case when tt >= 0 then exp(-tt) else 0 end + 0.5 * (event_type = 'error' and value < 10)::int), 6) as risk_score
from (select *, (event_id % 21) / 10.0::double - 0.1::double as tt, case when (event_type = 'error' and value < 10) or value / 30 <= 0.5 then 3 when value / 30 <= 2 or ((event_id % 21) / 10.0::double - 0.1::double > 0 and (event_id % 21) / 10.0::double - 0.1::double <= 1 and value / 30 <= 5) then 2
  when value / 30 <= 5 then 1 else 0 end as l from events)""")
def px6(spark, sf):
    e = read(spark, sf, "events").select("event_id", (F.col("value") / 30).alias("d_min"), ((F.col("event_id") % 21) / 10.0 - 0.1).alias("t_at_dmin"),
                                         ((F.col("event_type") == "error") & (F.col("value") < 10)).alias("collision_any"))
    return rounded(lb.proximity_label(e).drop("d_min", "t_at_dmin"))


def values_sql(rows) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::double" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


H = 3.0
ACT_SQL = f"""act as (select * from (values {values_sql(ac.BASE_ACTIONS)}) a(action, family, cost, accel, lat_m, comfort)),
e0 as (select sample_id, x, y, length, width, sqrt(vx ** 2 + vy ** 2) as v0, case when sqrt(vx ** 2 + vy ** 2) > 0.2 then atan2(vy, vx) else heading end as h0 from agents where is_ego),
ru as (select sample_id, action, family, cost, comfort, k::int as k, k * {DT}::double as t, x, y, h0, length, width, lat_m, case when accel < 0 then least(k * {DT}::double, v0 / greatest(-accel, 1e-9)) else k * {DT}::double end as tt, v0, accel,
  least(1, k * {DT}::double / {H}) as u from e0, act, range(1, {int(H / DT) + 1}) g(k)),
roll as (select sample_id, action, family, cost, comfort, k, t, x + cos(h0) * greatest(v0 * tt + 0.5 * accel * tt * tt, 0) - sin(h0) * lat_m * u * u * (3 - 2 * u) as x,
  y + sin(h0) * greatest(v0 * tt + 0.5 * accel * tt * tt, 0) + cos(h0) * lat_m * u * u * (3 - 2 * u) as y, h0 + atan2(lat_m * 6 * u * (1 - u) / {H}, greatest(greatest(v0 + accel * tt, 0), 0.2)) as heading, length, width from ru)"""


@query("AC1_AC3_rollout", f"with {SAMPLES_SQL}, {ACT_SQL} select sample_id, action, k, t, {r('x')} as x, {r('y')} as y, {r('heading')} as heading from roll")
def ac3(spark, sf):
    agents, _ = sc.samples(spark, sf)
    acts = ac.with_horizon(ac.action_library(spark, "base7"), H)
    return rounded(ac.rollout_actions(ac.ego_rows(agents), acts, DT).select("sample_id", "action", "k", "t", "x", "y", "heading"))


OBS_SQL = f"""obs as (select s.sample_id, s.agent_id, s.k, case when valid then s.x else a.x + a.vx * s.k * {DT} end as x, case when valid then s.y else a.y + a.vy * s.k * {DT} end as y,
  case when valid then s.heading when sqrt(a.vx ** 2 + a.vy ** 2) > 0.2 then atan2(a.vy, a.vx) else a.heading end as heading, s.length, s.width, valid from states s join agents a using (sample_id, agent_id) where not s.is_ego and k >= 1)"""


@query("AC5_obstacle_pose", f"""
with {SAMPLES_SQL}, {OBS_SQL}
select 'cv_fallback' as mode, sample_id, agent_id, k, {r('x')} as x, {r('y')} as y, {r('heading')} as heading from obs
union all select 'oracle_future', sample_id, agent_id, k, {r('x')}, {r('y')}, {r('heading')} from obs where valid
union all select 'cv_current', sample_id, agent_id, k::int, {r(f'x + vx * k * {DT}')}, {r(f'y + vy * k * {DT}')}, {r('case when sqrt(vx ** 2 + vy ** 2) > 0.2 then atan2(vy, vx) else heading end')} from agents, range(1, 7) t(k) where not is_ego""")
def ac5(spark, sf):
    agents, states = sc.samples(spark, sf)
    out = None
    for mode in ("cv_fallback", "oracle_future", "cv_current"):
        part = ac.obstacle_pose(agents, states, mode, 6, DT).select(F.lit(mode).alias("mode"), "sample_id", "agent_id", "k", "x", "y", "heading")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("AC6_impute_last_valid", f"""
with {SAMPLES_SQL}, l as (select *, last_value(case when valid then k end ignore nulls) over w as ak from states window w as (partition by sample_id, agent_id order by k)),
j as (select l.sample_id, l.agent_id, l.k, l.valid, l.x, l.y, l.heading, coalesce(b.k, 0) as ak, coalesce(b.x, a.x) as bx, coalesce(b.y, a.y) as by_, coalesce(b.vx, a.vx) as bvx, coalesce(b.vy, a.vy) as bvy, b.heading as bh
  from l join agents a using (sample_id, agent_id) left join states b on l.sample_id = b.sample_id and l.agent_id = b.agent_id and l.ak = b.k)
select sample_id, agent_id, k, {r(f'case when valid then x else bx + bvx * (k - ak) * {DT} end')} as x, {r(f'case when valid then y else by_ + bvy * (k - ak) * {DT} end')} as y,
  case when valid then 'recorded' when ak > 0 then 'cv_from_last_valid' else 'cv_from_current' end as source from j""")
def ac6(spark, sf):
    agents, states = sc.samples(spark, sf)
    return rounded(ac.impute_future(agents, states, "cv_last_valid", DT).select("sample_id", "agent_id", "k", "x", "y", "source"))


LANE_TEST = f"""lt as (select p.sample_id, p.action, p.k, p.t, sqrt(min({gap2_sql('p')})) as g from roll p left join seg s on p.sample_id = s.sample_id group by all)"""


@query("AC7_on_lane", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {ACT_SQL}, {LANE_TEST}
select sample_id, action, k, t, sample_id not in (select sample_id from seg) or coalesce(g <= 3.0, false) as on_lane from lt""")
def ac7(spark, sf):
    agents, _ = sc.samples(spark, sf)
    roll = ac.rollout_actions(ac.ego_rows(agents), ac.with_horizon(ac.action_library(spark, "base7"), H), DT)
    return ac.on_lane(roll, ["sample_id", "action", "k", "t"], sc.lanes(spark, sf), 3.0)


FAIL_SQL = f"""hit as (select p.sample_id, p.action, min(p.t) as ct from roll p join obs o on p.sample_id = o.sample_id and p.k = o.k and o.valid and {overlap_sql('p', 'o')} group by 1, 2),
off as (select sample_id, action, min(t) as lt from lt where sample_id in (select sample_id from seg) and not coalesce(g <= 3.0, false) group by 1, 2),
fail as (select a.sample_id, a.action, a.cost, a.comfort, least(ct, lt) as ft from (select distinct sample_id, action, cost, comfort from roll) a left join hit using (sample_id, action) left join off using (sample_id, action))"""


@query("AC8_first_failure", f"with {SAMPLES_SQL}, {LANES_SQL}, {ACT_SQL}, {OBS_SQL}, {LANE_TEST}, {FAIL_SQL} select sample_id, action, ft as failure_time_s from fail")
def ac8(spark, sf):
    agents, states, lanes = sc.stored(spark, sf)
    roll = ac.rollout_actions(ac.ego_rows(agents), ac.with_horizon(ac.action_library(spark, "base7"), H), DT)
    obs = ac.obstacle_pose(agents, states, "oracle_future", 6, DT)
    return ac.first_failure(roll, obs, lanes, 3.0, ["sample_id", "action"]).select("sample_id", "action", "failure_time_s")


@query("AC_actionability_labels", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {ACT_SQL}, {OBS_SQL}, {LANE_TEST}, {FAIL_SQL},
z as (select sample_id, sum((ft is null and comfort)::int) / sum(comfort::int) as c, sum((ft is null)::int) / count(*) as e, min(cost) filter (ft is null) as mc, case when bool_or(ft is null) filter (comfort) then 3.0 else max(ft) filter (comfort) end as tc,
  case when bool_or(ft is null) then 3.0 else max(ft) end as te from fail group by 1)
select sample_id, {r('c')} as comfort_feasible_ratio, {r('e')} as emergency_feasible_ratio, mc as min_required_action_cost, tc as time_to_no_comfort_s, te as time_to_no_emergency_s,
  case when e <= 0 then 3 when c <= 0.25 or e <= 0.35 then 2 when c < 0.75 or e < 0.65 then 1 else 0 end as actionability_label_id from z""")
def ac_labels(spark, sf):
    agents, states, lanes = sc.stored(spark, sf)
    out = ac.actionability_labels(agents, states, lanes, H, DT, rule="moderate")
    return rounded(out.select("sample_id", "comfort_feasible_ratio", "emergency_feasible_ratio", "min_required_action_cost", "time_to_no_comfort_s", "time_to_no_emergency_s", "actionability_label_id"))


# The derived scenes record three seconds of future, so the four-second variant is checked at three here.
VARIANTS = [ac.Variant(v.variant_id, v.family, min(v.horizon_s, 3.0), v.lane_buffer_m, v.action_library, v.future_handling) for v in ac.VARIANTS]


def variant_sql(variants) -> str:
    """Rollouts ``rollv`` per (library, horizon) and lane distances ``ltv`` for a list of variants."""
    rows = values_sql([(v.variant_id, v.horizon_s, v.lane_buffer_m, v.action_library, v.future_handling) for v in variants])
    acts = " union all ".join(f"select '{n}' as lib, * from (values {values_sql(lib)}) a(action, family, cost, accel, lat_m, comfort)" for n, lib in ac.LIBRARIES.items())
    return f"""vr as (select * from (values {rows}) v(variant_id, h, b, lib, fh)), acts as ({acts}), combos as (select distinct h, lib from vr),
e0 as (select sample_id, x, y, length, width, sqrt(vx ** 2 + vy ** 2) as v0, case when sqrt(vx ** 2 + vy ** 2) > 0.2 then atan2(vy, vx) else heading end as h0 from agents where is_ego),
rv as (select sample_id, h, c.lib, action, family, cost, comfort, k::int as k, k * {DT}::double as t, x, y, h0, length, width, lat_m, case when accel < 0 then least(k * {DT}::double, v0 / greatest(-accel, 1e-9)) else k * {DT}::double end as tt, v0, accel, least(1, k * {DT}::double / h) as u
  from e0, combos c join acts a on a.lib = c.lib, range(1, 9) g(k) where k * {DT}::double <= h + 1e-9),
rollv as (select sample_id, h, lib, action, family, cost, comfort, k, t, x + cos(h0) * greatest(v0 * tt + 0.5 * accel * tt * tt, 0) - sin(h0) * lat_m * u * u * (3 - 2 * u) as x, y + sin(h0) * greatest(v0 * tt + 0.5 * accel * tt * tt, 0) + cos(h0) * lat_m * u * u * (3 - 2 * u) as y,
  h0 + atan2(lat_m * 6 * u * (1 - u) / h, greatest(greatest(v0 + accel * tt, 0), 0.2)) as heading, length, width from rv),
ltv as (select p.sample_id, p.h, p.lib, p.action, p.k, p.t, sqrt(min({gap2_sql('p')})) as g from rollv p join seg s on p.sample_id = s.sample_id group by all)"""


@query("AC19_label_variants", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {OBS_SQL}, {variant_sql(VARIANTS)},
hv as (select p.sample_id, p.h, p.lib, p.action, f.fh, min(p.t) as ct from rollv p, (values ('skip_invalid'), ('cv_fallback')) f(fh), obs o where p.sample_id = o.sample_id and p.k = o.k and (o.valid or f.fh = 'cv_fallback') and {overlap_sql('p', 'o')} group by all),
ov as (select l.sample_id, l.h, l.lib, l.action, v.variant_id, min(l.t) as lt from ltv l join vr v on l.h = v.h and l.lib = v.lib where not coalesce(l.g <= v.b, false) group by all),
fv as (select a.sample_id, v.variant_id, a.h, a.cost, a.comfort, least(ct, lt) as ft from (select distinct sample_id, h, lib, action, cost, comfort from rollv) a join vr v on a.h = v.h and a.lib = v.lib left join hv on a.sample_id = hv.sample_id and a.h = hv.h and a.lib = hv.lib and a.action = hv.action and hv.fh = v.fh
  left join ov on a.sample_id = ov.sample_id and a.action = ov.action and v.variant_id = ov.variant_id),
z as (select sample_id, variant_id, sum((ft is null and comfort)::int) / sum(comfort::int) as c, sum((ft is null)::int) / count(*) as e, min(cost) filter (ft is null) as mc, case when bool_or(ft is null) then max(h) else max(ft) end as te from fv group by 1, 2)
select sample_id, variant_id, {r('c')} as comfort_feasible_ratio, {r('e')} as emergency_feasible_ratio, mc as min_required_action_cost, te as time_to_no_emergency_s, case when e <= 0 then 3 when c <= 0.25 or e <= 0.35 then 2 when c < 0.75 or e < 0.65 then 1 else 0 end as actionability_label_id from z""")
def ac19(spark, sf):
    agents, states, lanes = sc.stored(spark, sf)
    out = ac.label_variants(agents, states, lanes, DT, VARIANTS)
    return rounded(out.select("sample_id", "variant_id", "comfort_feasible_ratio", "emergency_feasible_ratio", "min_required_action_cost", "time_to_no_emergency_s", "actionability_label_id"))


AUDIT_MODES = values_sql([(n, *spec) for n, spec in ac.AUDIT_SPECS.items()])


@query("AC20_feasibility_audit", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {ACT_SQL}, {LANE_TEST}, md as (select * from (values {AUDIT_MODES}) v(checked_mode, om, use_map, ign)),
om as (select 'oracle_future' as om, sample_id, agent_id, k, x, y, heading, length, width from states where not is_ego and valid union all
  select 'cv_current', sample_id, agent_id, k::int, x + vx * k * {DT}, y + vy * k * {DT}, case when sqrt(vx ** 2 + vy ** 2) > 0.2 then atan2(vy, vx) else heading end, length, width from agents, range(0, 7) t(k) where not is_ego),
ps as (select sample_id, action, k, t, x, y, heading, length, width from roll union all select sample_id, action, 0, 0.0, x, y, heading, length, width from agents, act where is_ego),
hh as (select p.sample_id, p.action, o.om, p.k, p.t, min(o.agent_id) as ag from ps p join om o on p.sample_id = o.sample_id and p.k = o.k and {overlap_sql('p', 'o')} group by all),
hc as (select sample_id, action, om, min(ag) filter (k = 0) as s_ag, min({{'t': t, 'a': ag}}) filter (k > 0) as an, min({{'t': t, 'a': ag}}) filter (k > 0 and t > 0.3) as la from hh group by all),
lb as (select *, sample_id in (select sample_id from seg) and not coalesce(g <= 3.0, false) as bad from lt),
lf as (select sample_id, action, min(t) filter (bad) as o1, min(t) filter (bad and t > 0.3) as o2, avg(bad::int) as sh, avg(bad::int) filter (t > 0.3) as lsh from lb group by 1, 2),
m as (select lf.sample_id, lf.action, md.*, case when use_map then case when ign then o2 else o1 end end as l, case when ign then la else an end as h, case when not ign then s_ag end as s, case when use_map then case when ign then lsh else sh end else 0 end as fr
  from lf cross join md left join hc on lf.sample_id = hc.sample_id and lf.action = hc.action and md.om = hc.om)
select sample_id, action, checked_mode, s is null and l is null and h is null as feasible, case when s is not null then 0.0 when l is not null and (h is null or l <= h.t) then l else h.t end as first_unsafe_time_s,
  case when s is not null then 'initial_overlap' when l is not null and (h is null or l <= h.t) then 'map_violation' when h is not null then om || '_collision' else 'no_failure' end as unsafe_reason_primary,
  case when s is not null then s when l is not null and (h is null or l <= h.t) then null else h.a end as blocking_agent_id, {r('fr')} as map_violation_fraction from m""")
def ac20(spark, sf):
    agents, states, lanes = sc.stored(spark, sf)
    return rounded(ac.feasibility_audit(agents, states, lanes, H, DT).drop("blocking_agent_distance_m"))


LAT_ROWS = [(i * 7 + j, lo[0], la[0], "emergency" if lo[3] or la[4] else "comfort", lo[1], la[1], la[2], lo[2] + la[3])
            for i, lo in enumerate(ac.LATTICE_LON["lattice_base"]) for j, la in enumerate(ac.LATTICE_LAT["lattice_base"])]
P = ac.PlannerParams(horizon_s=3.0, dt=DT, ignore_initial_s=0.6, lane_buffer_m=4.0)
def lattice_sql(rows=LAT_ROWS, n: int = 7, dt: float = DT) -> str:
    return f"""cand as (select * from (values {values_sql(rows)}) c(candidate_id, longitudinal_profile, lateral_profile, action_family, accel, lat_offset, lat_duration, action_cost)),
l0 as (select sample_id, cand.*, k::int as k, k * {dt}::double as t, x as x0, y as y0, heading as h0, length, width, greatest(0, sqrt(vx ** 2 + vy ** 2) + accel * k * {dt}) as v, least(1, k * {dt}::double / lat_duration) as u from agents, cand, range({n}) g(k) where is_ego),
l1 as (select *, coalesce(sum(case when k > 0 then 0.5 * (pv + v) * {dt} else 0 end) over (partition by sample_id, candidate_id order by k), 0) as s, lat_offset * u * u * (3 - 2 * u) as lat
  from (select *, lag(v) over (partition by sample_id, candidate_id order by k) as pv from l0)),
l2 as (select *, x0 + s * cos(h0) - lat * sin(h0) as x, y0 + s * sin(h0) + lat * cos(h0) as y from l1),
l3 as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from l2 window w as (partition by sample_id, candidate_id order by k)),
l4 as (select *, case when sqrt(dx * dx + dy * dy) > 1e-8 then atan2(dy, dx) end as dir, sqrt(dx * dx + dy * dy) / {dt} as sv from l3),
l5 as (select *, case when k = 0 then coalesce(lead(dir) over w, h0) else coalesce(last_value(dir ignore nulls) over w, h0) end as heading, case when k = 0 then lead(sv) over w else sv end as speed from l4 window w as (partition by sample_id, candidate_id order by k)),
l6 as (select *, case when k = 0 then 0 else (speed - lag(speed) over w) / {dt} end as acceleration, case when k = 0 then 0 else {sc.wrap_sql('heading - lag(heading) over w')} / {dt} end as yaw_rate from l5 window w as (partition by sample_id, candidate_id order by k)),
lat as (select *, speed * yaw_rate as lateral_accel from l6)"""


LATTICE_SQL = lattice_sql()


def lattice(spark, sf):
    agents, _ = sc.samples(spark, sf)
    return ac.rollout_lattice(ac.ego_rows(agents), ac.lattice_candidates(spark), P.horizon_s, DT)


@query("AC2_AC4_rollout_lattice", f"""
with {SAMPLES_SQL}, {LATTICE_SQL} select sample_id, candidate_id, action_family, {r('action_cost')} as action_cost, k, {r('x', 5)} as x, {r('y', 5)} as y, {r('heading', 5)} as heading, {r('speed', 5)} as speed,
  {r('acceleration', 5)} as acceleration, {r('yaw_rate', 5)} as yaw_rate from lat""")
def ac4(spark, sf):
    return rounded(lattice(spark, sf).select("sample_id", "candidate_id", "action_family", "action_cost", "k", "x", "y", "heading", "speed", "acceleration", "yaw_rate"), 5).withColumn(
        "action_cost", rcol(F.col("action_cost")))


def kin_sql(p=P) -> str:
    return f"""kin as (select sample_id, candidate_id, longitudinal_profile, lateral_profile, action_family, action_cost, max(t) as last_t, bool_or(accel > {p.max_comfort_accel} + 1e-9 or accel < case when action_family = 'comfort' then {p.max_comfort_decel} else {p.max_emergency_decel} end - 1e-9) as cmd,
  bool_or(abs(yaw_rate) > 1.2 or abs(lateral_accel) > 4.5) as mot, max(abs(acceleration)) as max_abs_accel_mps2, max(abs(yaw_rate)) as max_abs_yaw_rate_rad_s, max(abs(lateral_accel)) as max_lateral_accel_mps2, arg_max(s, k) as progress_m from lat group by all)"""


KIN_SQL = kin_sql()


@query("AC12_kinematic_violation", f"""
with {SAMPLES_SQL}, {LATTICE_SQL}, {KIN_SQL} select sample_id, candidate_id, cmd as command_violation, mot as motion_violation, cmd or mot as kinematic_flag, {r('max_abs_accel_mps2', 5)} as max_abs_accel_mps2,
  {r('max_abs_yaw_rate_rad_s', 5)} as max_abs_yaw_rate_rad_s, {r('max_lateral_accel_mps2', 5)} as max_lateral_accel_mps2, {r('progress_m', 5)} as progress_m from kin""")
def ac12(spark, sf):
    return rounded(ac.kinematic_violation(lattice(spark, sf), P).drop("kinematic_t"), 5)


def eval_sql(p=P, obstacles: str = "select * from obs where valid union all select sample_id, agent_id, 0, x, y, heading, length, width, true from agents where not is_ego") -> str:
    return f"""ohit as (select p.sample_id, p.candidate_id, p.k, p.t, min(o.agent_id) as agent from lat p join ({obstacles}) o
  on p.sample_id = o.sample_id and p.k = o.k and {overlap_sql('p', 'o', P.safety_buffer_m)} group by 1, 2, 3, 4),
oc as (select sample_id, candidate_id, min({{'t': t, 'a': agent}}) filter (t >= {p.ignore_initial_s}) as h, count(distinct agent) filter (t < {p.ignore_initial_s}) as init from ohit group by 1, 2),
ll as (select p.sample_id, p.candidate_id, p.t, sqrt(min({gap2_sql('p')})) as g from lat p join seg s on p.sample_id = s.sample_id group by 1, 2, 3),
lo as (select sample_id, candidate_id, min(t) as lt from ll where not coalesce(g <= {p.lane_buffer_m}, false) group by 1, 2),
ev as (select kin.*, h.t as ct, h.a as agent, coalesce(init, 0) as init, lt, progress_m < {p.min_progress_m} and longitudinal_profile != 'hard_brake' as slow, cmd or mot as kf from kin left join oc using (sample_id, candidate_id) left join lo using (sample_id, candidate_id)),
cd as (select sample_id, candidate_id, longitudinal_profile, lateral_profile, action_cost, ct is null and lt is null and not slow and not kf as feasible, least(ct, lt, case when cmd then 0 end, case when slow then last_t end) as first_failure_time_s,
  case when ct is not null then 'collision' when lt is not null then 'lane_buffer' when slow then 'progress' when kf then 'kinematic' else 'no_failure' end as failure_reason, ct is not null as collision_flag, lt is not null as lane_buffer_flag, slow as progress_flag, kf as kinematic_flag,
  agent as blocking_agent_id, init as initial_overlap_count from ev)"""


EVAL_SQL = eval_sql()


def candidates(spark, sf, scenes=None):
    agents, states, lanes = scenes or sc.stored(spark, sf)
    obs = ac.obstacle_pose(agents, states, "oracle_future", 6, DT, start=0)
    return checked.evaluate_lattice(agents, lanes, "lattice_base", P, obs)


@query("AC13_evaluate_candidates", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {OBS_SQL}, {LATTICE_SQL}, {KIN_SQL}, {EVAL_SQL} select sample_id, candidate_id, feasible, first_failure_time_s::double as first_failure_time_s, failure_reason, collision_flag, lane_buffer_flag, progress_flag, kinematic_flag, blocking_agent_id, initial_overlap_count from cd""")
def ac13(spark, sf):
    return candidates(spark, sf).select("sample_id", "candidate_id", "feasible", "first_failure_time_s", "failure_reason", "collision_flag", "lane_buffer_flag", "progress_flag", "kinematic_flag",
                                        "blocking_agent_id", "initial_overlap_count")


# The published setting: 130 candidates, 31 steps of 0.1 s, obstacles at constant velocity.
FULL = ac.PlannerParams(horizon_s=3.0, dt=0.1, lane_buffer_m=4.0)
FULL_ROWS = [(i * 13 + j, lo[0], la[0], "emergency" if lo[3] or la[4] else "comfort", lo[1], la[1], la[2], lo[2] + la[3])
             for i, lo in enumerate(ac.LATTICE_LON["lattice_extended"]) for j, la in enumerate(ac.LATTICE_LAT["lattice_extended"])]
CV_SQL = f"""select sample_id, agent_id, k::int as k, x + vx * k * {FULL.dt}::double as x, y + vy * k * {FULL.dt}::double as y,
  case when sqrt(vx ** 2 + vy ** 2) > 0.2 then atan2(vy, vx) else heading end as heading, length, width from agents, range(31) t(k) where not is_ego"""


@query("AC13_full_lattice", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {lattice_sql(FULL_ROWS, 31, FULL.dt)}, {kin_sql(FULL)}, {eval_sql(FULL, CV_SQL)} select sample_id, candidate_id, feasible, {r('first_failure_time_s::double', 3)} as first_failure_time_s, failure_reason,
  collision_flag, lane_buffer_flag, progress_flag, kinematic_flag, blocking_agent_id, initial_overlap_count from cd""")
def full_lattice(spark, sf):
    agents, _, lanes = sc.stored(spark, sf, future=False)
    return checked.evaluate_lattice(agents, lanes, "lattice_extended", FULL).select(
        "sample_id", "candidate_id", "feasible", rcol(F.col("first_failure_time_s"), 3).alias("first_failure_time_s"), "failure_reason", "collision_flag", "lane_buffer_flag", "progress_flag",
        "kinematic_flag", "blocking_agent_id", "initial_overlap_count")


@query("AC_planner_chain", f"""
with {SAMPLES_SQL}, {LANES_SQL}, {OBS_SQL}, {LATTICE_SQL}, {KIN_SQL}, {EVAL_SQL},
f as (select sample_id, count(*) as n, sum(feasible::int)::bigint as ok, bool_or(collision_flag) as c, bool_or(lane_buffer_flag) as l, bool_or(kinematic_flag) as k, min({{'cost': action_cost, 'id': candidate_id, 'n': longitudinal_profile || '+' || lateral_profile}}) filter (feasible) as b from cd group by 1)
select sample_id, (ok > 0)::int as planner_success, ok as feasible_candidate_count, coalesce(b.n, '') as best_action_family, case when ok > 0 then 'no_failure' when c or l or k then 'known_failure' else 'unknown_failure' end as failure_taxonomy,
  case when ok > 0 then 'no_failure:feasible_trajectory_exists' when c and l and k then 'known_failure:collision_road_boundary_and_kinematic' when c and l then 'known_failure:collision_and_road_boundary' when c and k then 'known_failure:collision_and_kinematic'
    when l and k then 'known_failure:road_boundary_and_kinematic' when c then 'known_failure:collision_only' when l then 'known_failure:road_boundary_only' when k then 'known_failure:kinematic_only' else 'unknown_failure:all_invalid_unattributed' end as failure_subtype from f""")
def chain(spark, sf):
    scenes = sc.stored(spark, sf)
    cand = checkpointed(candidates(spark, sf, scenes))
    every = scenes[0].filter("is_ego").select("sample_id")
    lab = lb.planner_labels(cand, samples=every).drop("initial_overlap_count").join(lb.candidate_flags(cand, samples=every), "sample_id")
    return lb.failure_taxonomy(lab).select("sample_id", "planner_success", "feasible_candidate_count", "best_action_family", "failure_taxonomy", "failure_subtype")
