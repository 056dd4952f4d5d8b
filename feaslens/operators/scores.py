"""Baseline and composite scores. Percentile ranges of all terms of a family come from one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.functions.columns import clip, mean_of, num_filled, num_or, with_scenario_id
from feaslens.functions.frames import Norm, normalize
from feaslens.operators import ordered

# Response time, accelerations and decelerations of the safe-distance model.
RESPONSE_S, ACCEL_MAX, BRAKE_MIN, BRAKE_MAX, EMERGENCY_DECEL = 1.0, 2.0, 4.0, 8.0, 7.0
ACCESS_FLAGS = ("recorded_future_access", "candidate_action_survival_access", "endpoint_intermediate_access")
SOLVER_REASON = "maneuver solver not available; recorded future and planner survival are forbidden"


def _ids(df: DataFrame) -> list[str]:
    return [c for c in ("sample_id", "scenario_id", "commonroad_scenario_id") if c in df.columns]


def _floor0(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def _inputs(df: DataFrame) -> dict[str, Column]:
    g = lambda c, d=None: num_or(df, c, d)
    speed = g("ego_speed_mps") if "ego_speed_mps" in df.columns else g("ego_speed_kph") / 3.6
    valid = lambda x: F.when(x >= 0, x)
    return {
        "distance": F.coalesce(g("headway_m"), g("current_min_distance_m")),
        "speed": _floor0(F.coalesce(speed, g("ego_speed_mps_current"))),
        "closing": _floor0(g("nearest_agent_closing_speed_mps")),
        "ttc": F.coalesce(valid(g("current_ttc_s")), valid(g("cv_min_collision_time_3s_s"))),
        "ttc_forecast": F.coalesce(valid(g("cv_min_collision_time_3s_s")), valid(g("current_ttc_s"))),
        "lateral_speed": F.abs(g("nearest_agent_lateral_speed_mps", 0.0)),
        "clearance": g("current_lateral_clearance_m"),
    }


def _no_access(family: str) -> dict[str, Column]:
    return {"baseline_family": F.lit(family), **{f: F.lit(False) for f in ACCESS_FLAGS}}


def _at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def _risk(df: DataFrame, out: str, terms: Sequence[tuple[str | Column, bool]]) -> DataFrame:
    """Mean of normalised terms (null terms are skipped)."""
    names, staged = [], df
    for i, (term, _) in enumerate(terms):
        names.append(f"_term{i}")
        staged = staged.withColumn(names[-1], F.col(term) if isinstance(term, str) else term)
    specs = [Norm(n, f"{n}_n", invert=inv, keep_null=True) for n, (_, inv) in zip(names, terms)]
    normed = normalize(staged, specs)
    return normed.withColumn(out, mean_of([s.out for s in specs])).drop(*names, *[s.out for s in specs])


def criticality_scores(df: DataFrame) -> DataFrame:
    """Headway, time headway, time to collision, required accelerations and their mean risk."""
    x = _inputs(df)
    null = F.lit(None).cast("double")
    cols: dict[str, Column] = {"HW_m": x["distance"], "THW_s": x["distance"] / F.nullif(x["speed"], F.lit(0.0)), "TTC_s": x["ttc"]}
    cols |= {"ALongReq_mps2": x["closing"] * x["closing"] / (2.0 * _at_least(x["distance"], 0.1)),
             "ALatReq_mps2": x["lateral_speed"] * x["lateral_speed"] / (2.0 * _at_least(x["clearance"], 0.1))}
    out = with_scenario_id(df).withColumns(cols)
    more = {"HW": F.col("HW_m"), "THW": F.col("THW_s"), "TTC": F.col("TTC_s"), "HW_inverse": -F.col("HW_m"), "THW_inverse": -F.col("THW_s"),
            "TTC_inverse_crime": -F.col("TTC_s"), "ALongReq": F.col("ALongReq_mps2"), "ALatReq": F.col("ALatReq_mps2")}
    for m in ("TTR", "TTB", "TTS"):
        more |= {f"{m}_s": null, m: null, f"{m}_available": F.lit(False), f"{m}_unavailable_reason": F.lit(SOLVER_REASON)}
    out = out.withColumns({**more, **_no_access("commonroad_crime_style")})
    out = _risk(out, "commonroad_crime_risk_score", [("HW_m", True), ("THW_s", True), ("TTC_s", True), ("ALongReq_mps2", False), ("ALatReq_mps2", False)])
    return out.select(*_ids(out), *cols, *more, "commonroad_crime_risk_score", "baseline_family", *ACCESS_FLAGS)


def rss_scores(df: DataFrame) -> DataFrame:
    """Longitudinal and lateral safe distances, margins and danger."""
    x = _inputs(df)
    closing = F.coalesce(x["closing"], F.lit(0.0))
    lead = _floor0(x["speed"] - closing)
    reach = x["speed"] + RESPONSE_S * ACCEL_MAX
    safe = _floor0(x["speed"] * RESPONSE_S + 0.5 * ACCEL_MAX * RESPONSE_S**2 + reach * reach / (2.0 * BRAKE_MIN) - lead * lead / (2.0 * BRAKE_MAX))
    clearance = num_or(df, "current_lateral_clearance_m", 3.5) if "current_lateral_clearance_m" not in df.columns else x["clearance"]
    side = 1.0 + 0.5 * x["lateral_speed"]
    cols = {"rss_longitudinal_safe_distance_m": safe, "rss_longitudinal_margin_m": x["distance"] - safe,
            "rss_lateral_safe_distance_m": side, "rss_lateral_margin_m": clearance - side}
    out = with_scenario_id(df).withColumns(cols)
    lon, lat = F.col("rss_longitudinal_margin_m"), F.col("rss_lateral_margin_m")
    more = {"rss_longitudinal_margin": lon, "rss_lateral_margin": lat, "rss_longitudinal_margin_inverse": -lon, "rss_lateral_margin_inverse": -lat,
            "not_full_rss_stack": F.lit(True)}
    out = out.withColumns({**more, **_no_access("rss_style_margin")})
    out = _risk(out, "rss_danger_score", [("rss_longitudinal_margin_inverse", False), ("rss_lateral_margin_inverse", False)])
    return out.select(*_ids(out), *cols, *more, "rss_danger_score", "baseline_family", *ACCESS_FLAGS)


def drivability_scores(df: DataFrame) -> DataFrame:
    """Emergency brake margin, keep-lane feasibility and their risk."""
    x = _inputs(df)
    margin = x["distance"] - x["speed"] * x["speed"] / (2.0 * EMERGENCY_DECEL)
    road, ttc = num_or(df, "road_margin_m"), x["ttc_forecast"]
    brake_ok = F.coalesce(margin >= 0, F.lit(False))
    lane_ok = (ttc.isNull() | (ttc > 3.0)) & (F.coalesce(road, F.lit(0.0)) > -0.25)
    reason = F.col("road_margin_unavailable_reason") if "road_margin_unavailable_reason" in df.columns else F.lit("")
    cols = {"emergency_brake_margin_m": margin, "emergency_brake_feasible": brake_ok, "emergency_brake_infeasible_score": (~brake_ok).cast("double"),
            "min_road_margin_keep_lane": road, "min_road_margin_keep_lane_unavailable_reason": reason, "min_collision_time_keep_lane": ttc,
            "keep_lane_cv_feasible": lane_ok, "keep_lane_cv_infeasible_score": (~lane_ok).cast("double"),
            "min_collision_time_keep_lane_inverse": -ttc, "min_road_margin_keep_lane_inverse": -road,
            "full_planner_feasibility_count_secondary": num_or(df, "feasible_candidate_count")}
    out = with_scenario_id(df).withColumns({**cols, "primary_uses_full_planner_count": F.lit(False), **_no_access("drivability_current_state")})
    out = _risk(out, "drivability_risk_score", [
        (-F.col("emergency_brake_margin_m"), False), ("min_road_margin_keep_lane_inverse", False), ("min_collision_time_keep_lane", True),
        ("keep_lane_cv_infeasible_score", False)])
    return out.select(*_ids(out), *cols, "primary_uses_full_planner_count", "drivability_risk_score", "baseline_family", *ACCESS_FLAGS)


def forecast_scores(df: DataFrame) -> DataFrame:
    """Constant-velocity forecast: separation, overlap and their risk.

    The scaled neighbour density stands in for the overlap only when no row has one. Scaling a scaled column changes nothing, so all
    terms need one pass.
    """
    x = _inputs(df)
    sep = F.coalesce(num_or(df, "cv_min_predicted_separation_3s_m"), x["distance"] - F.coalesce(x["closing"], F.lit(0.0)) * 3.0)
    overlap = num_or(df, "cv_occupancy_overlap_integral_3s")
    some = df.agg(F.count(overlap).alias("n")).select("n")
    out = with_scenario_id(df).withColumns({"minimum_predicted_separation_3s_m": sep, "_overlap": overlap, "_near": num_or(df, "nearby_agent_count_10m", 0.0)})
    s = F.col("minimum_predicted_separation_3s_m")
    more = {"minimum_predicted_separation_over_3s_m": s, "minimum_predicted_separation_3s": s, "minimum_predicted_separation_3s_inverse": -s,
            "ca_forecast_collision_risk": F.lit(None).cast("double"), "ca_forecast_available": F.lit(False),
            "ca_forecast_unavailable_reason": F.lit("current acceleration unavailable; recorded future trajectory is forbidden")}
    out = out.withColumns({**more, **_no_access("current_state_cv_forecast")})
    out = normalize(out, [Norm("minimum_predicted_separation_3s_inverse", "cv_forecast_collision_risk", keep_null=True), Norm("_overlap", "_overlap_n", keep_null=True),
                          Norm("minimum_predicted_separation_3s_m", "_sep_n", invert=True, keep_null=True), Norm("_near", "_near_n")])
    pick = lambda a, b: F.when(F.col("_some") > 0, F.col(a)).otherwise(F.col(b))
    out = out.withColumn("_some", some.scalar()).withColumns({"occupancy_overlap_integral_3s": pick("_overlap", "_near_n"), "_term": pick("_overlap_n", "_near_n")})
    out = out.withColumn("forecast_risk_score", mean_of(["cv_forecast_collision_risk", "_term", "_sep_n"]))
    return out.select(*_ids(out), "cv_forecast_collision_risk", "occupancy_overlap_integral_3s", "minimum_predicted_separation_3s_m", *more,
                      "forecast_risk_score", "baseline_family", *ACCESS_FLAGS)


BASELINES: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "criticality": criticality_scores, "rss": rss_scores, "drivability": drivability_scores, "forecast": forecast_scores}


def baseline_scores(df: DataFrame) -> DataFrame:
    """All baseline columns, one row per sample."""
    out = None
    for fn in BASELINES.values():
        part = fn(df).drop("baseline_family", *ACCESS_FLAGS)
        if out is None:
            out = part
        else:
            out = out.join(part.select("sample_id", *[c for c in part.columns if c not in out.columns]), "sample_id")
    return out


# Score name -> (column, transform, invert). Fixed values of the score catalogue.
CATALOG = (
    ("REDI_actionability", "redi_actionability", "", False), ("REDI_full", "redi_full", "", False), ("REDI_delta", "redi_actionability_delta", "", False),
    ("RCR", "rcr", "", False), ("ASR_cum_inverse", "asr_cum_final", "loss", False), ("ASR_cum_min_inverse", "asr_cum_min", "loss", False),
    ("ASR_slice_min_inverse", "asr_slice_min", "loss", False), ("comfort_ASR_inverse", "comfort_asr", "loss", False),
    ("emergency_ASR_inverse", "emergency_asr", "loss", False), ("TTAD_inverse", "ttad_s", "", True),
    ("time_to_first_conflict_inverse", "time_to_first_conflict_s", "", True), ("collapse_rate", "collapse_rate_per_s", "", False),
    ("collapse_rate_max", "collapse_rate_max_per_s", "", False), ("early_blocking", "early_blocking_ratio", "", False),
    ("distance_inverse", "current_min_distance_m", "", True), ("TTC_inverse", "current_ttc_s", "valid", True),
)
COMPOSITE_PARTS = ("REDI_actionability", "ASR_cum_min_inverse", "comfort_ASR_inverse", "TTAD_inverse", "collapse_rate_max", "early_blocking")


def score_catalog(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every catalogue score whose column exists, scaled to [0, 1], plus the mean composite."""
    have = [row for row in CATALOG if row[1] in df.columns]
    staged = df
    for name, col, kind, _ in have:
        x = num_or(df, col)
        staged = staged.withColumn(f"_c_{name}", 1.0 - x if kind == "loss" else F.when(x >= 0, x) if kind == "valid" else x)
    out = normalize(staged, [Norm(f"_c_{name}", name, invert=inv) for name, _, _, inv in have])
    names = [row[0] for row in have]
    parts = [n for n in COMPOSITE_PARTS if n in names]
    if parts:
        out = out.withColumn("ROF_v2_composite", mean_of(parts))
        names.append("ROF_v2_composite")
    return out.select(*keep, *names)


def composite_scores(df: DataFrame) -> DataFrame:
    """Raw inverse scores and the three composites; missing times count as safe (maximum plus a margin)."""
    g = lambda c: num_or(df, c)
    ttc, ttad, first = g("current_ttc_s"), g("ttad_s"), g("time_to_first_conflict_s")
    caps = df.agg(F.coalesce(F.max(F.when(ttc >= 0, ttc)) + 10.0, F.lit(999.0)).alias("ttc"),
                  F.coalesce(F.max(ttad) + 1.0, F.lit(999.0)).alias("ttad"), F.coalesce(F.max(first) + 1.0, F.lit(999.0)).alias("first"))
    work = df.withColumn("_cap", caps.select(F.struct("*").alias("c")).scalar())
    work = work.withColumns({
        "distance_inverse": -g("current_min_distance_m"), "TTC_inverse": -F.coalesce(F.when(ttc >= 0, ttc), F.col("_cap.ttc")),
        "ASR_cum_inverse": 1.0 - F.coalesce(g("asr_cum_final"), g("msr")), "ASR_slice_inverse": 1.0 - g("asr_slice_final"),
        "TTAD_inverse": -F.coalesce(ttad, F.col("_cap.ttad")), "collapse_rate": g("collapse_rate_max_per_s"),
        "_redi": g("redi_actionability"), "_first": -F.coalesce(first, F.col("_cap.first")), "_early": g("early_blocking_ratio")})
    norm = lambda c: Norm(c, f"{c}__n", keep_null=True)
    names = ["_redi", "ASR_cum_inverse", "TTAD_inverse", "collapse_rate"]
    temporal = ["TTAD_inverse", "collapse_rate"]
    if "time_to_first_conflict_s" in df.columns:
        temporal.append("_first")
    if "early_blocking_ratio" in df.columns:
        temporal.append("_early")
    normed = normalize(work, [norm(c) for c in dict.fromkeys([*names, *temporal])])
    mean = lambda cols: mean_of([f"{c}__n" for c in cols])
    out = normed.withColumns({"ROF_v2_composite": mean(names), "ROF_v2_no_asr_composite": mean(["_redi", "TTAD_inverse", "collapse_rate"]),
                              "temporal_composite": mean(temporal)})
    keep = list(dict.fromkeys([*df.columns, "distance_inverse", "TTC_inverse", "ASR_cum_inverse", "ASR_slice_inverse", "TTAD_inverse", "collapse_rate",
                               "ROF_v2_composite", "ROF_v2_no_asr_composite", "temporal_composite"]))
    return out.select(*keep)


def cv_composite(df: DataFrame) -> Column:
    g = lambda c: num_filled(df, c)
    return 0.5 * g("cv_rcr") + 0.3 * g("cv_c_time") + 0.2 * g("cv_c_density")


def density_term(gtoa_norm_union: Column, oce_norm: Column, gtoa_weight: float = 0.7, oce_weight: float = 0.3) -> Column:
    return clip(gtoa_weight * gtoa_norm_union + oce_weight * oce_norm, 0.0, 1.0)


def redi(df: DataFrame, use_maneuver: bool, weights: Mapping[str, float] | None = None, prefix: str = "") -> Column:
    """Composite of space, time and density terms, with the manoeuvre term where it is known."""
    w = {"space": 0.4, "time": 0.2, "maneuver": 0.3, "density": 0.1, **(weights or {})}
    space = F.coalesce(num_or(df, f"{prefix}c_space_drv"), num_filled(df, f"{prefix}c_space"))
    time, dens = num_filled(df, f"{prefix}c_time"), num_filled(df, f"{prefix}c_density")
    plain = clip((w["space"] * space + w["time"] * time + w["density"] * dens) / max(w["space"] + w["time"] + w["density"], 1e-9), 0.0, 1.0)
    man = num_or(df, "c_maneuver")
    full = clip(w["space"] * space + w["time"] * time + w["maneuver"] * man + w["density"] * dens, 0.0, 1.0)
    return F.when(man.isNotNull(), full).otherwise(plain) if use_maneuver else plain


def redi_actionability(df: DataFrame, weights: Mapping[str, float] | None = None, horizon: float = 3.0, dt: float = 0.1, collapse_scale: float = 1.0) -> Column:
    """Action-aware composite: action loss, comfort loss and collapse next to space, time and density."""
    w = {"space": 0.20, "time": 0.15, "cum_action_loss": 0.25, "comfort_loss": 0.15, "collapse": 0.15, "density": 0.10, **(weights or {})}
    g = lambda c, d=0.0: num_filled(df, c, d)
    space = F.coalesce(num_or(df, "c_space_drv"), g("c_space"))
    cum = clip(1.0 - F.coalesce(num_or(df, "asr_cum_final"), g("asr", 1.0)), 0.0, 1.0)
    comfort = num_or(df, "comfort_asr")
    comfort_loss = F.when(comfort >= 0, clip(1.0 - comfort, 0.0, 1.0)).otherwise(cum)
    collapse = clip(F.coalesce(num_or(df, "collapse_rate_max_per_s"), g("collapse_rate_per_s")) / max(collapse_scale, 1e-6), 0.0, 1.0)
    late = clip(1.0 - g("ttad_s", horizon + dt) / max(horizon + dt, 1e-6), 0.0, 1.0)
    action = clip(0.5 * cum + 0.5 * F.greatest(cum, late), 0.0, 1.0)
    total = (w["space"] * space + w["time"] * g("c_time") + w["cum_action_loss"] * action + w["comfort_loss"] * comfort_loss
             + w["collapse"] * collapse + w["density"] * g("c_density"))
    return clip(total / max(sum(w.values()), 1e-9), 0.0, 1.0)


def with_redi(df: DataFrame) -> DataFrame:
    out = df.withColumns({"redi_no_msr": redi(df, False), "redi_full": redi(df, True), "redi_actionability": redi_actionability(df)})
    return out.withColumn("redi_actionability_delta", F.col("redi_actionability") - F.col("redi_full"))


def availability(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: rows with a value, share available, most common reason for absence.

    Uses ``<m>_available`` and ``<m>_unavailable_reason`` where present, else non-null values.
    """
    def entry(m: str) -> Column:
        value = num_or(df, m)
        ok = F.coalesce(F.col(f"{m}_available"), F.lit(False)) if f"{m}_available" in df.columns else value.isNotNull()
        reason = F.coalesce(F.col(f"{m}_unavailable_reason"), F.lit("")) if f"{m}_unavailable_reason" in df.columns else F.lit("")
        return F.struct(F.lit(m).alias("metric"), ok.alias("ok"), F.when(~ok, reason).otherwise("").alias("reason"))
    long = df.select(F.explode(F.array(*[entry(m) for m in metrics])).alias("_e")).select("_e.*")
    counts = long.groupBy("metric", "reason").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("bigint")).alias("ok"))
    return counts.groupBy("metric").agg(
        F.sum("n").alias("n_rows"), F.sum("ok").alias("n_available"), (F.sum("ok") / F.sum("n")).alias("available_fraction"),
        F.coalesce(F.max(F.when(F.col("reason") != "", F.struct("n", "reason")))["reason"], F.lit("")).alias("unavailable_reason"))


def best_by_family(metrics: DataFrame, families: DataFrame, value: str = "auprc", score: str = "score_name") -> DataFrame:
    """Best score per family by AUPRC; ties go to the smaller name, and a family without a value has a null best. ``families`` maps score to family.

    The metrics are read once: floating sums made a second time may differ in the last bit, and a best value compared with them would not be found.
    """
    joined = metrics.join(families, score)
    own = Window.partitionBy("family")  # the scores of a family, a handful
    placed = joined.withColumns({"_r": F.row_number().over(own.orderBy(F.col(value).desc_nulls_last(), score)), "n_scores": F.count("*").over(own)})
    return placed.filter("_r = 1").select("family", F.when(F.col(value).isNotNull(), F.col(score)).alias("best_score"), value, "n_scores")
