"""Label rules, per-sample aggregates of candidate rows and the failure taxonomy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions.columns import as_col, count_string, num, round6
from feaslens.operators import ordered

# Label names and the thresholds of the label rules.
ACTIONABILITY_NAMES = {0: "high_actionability", 1: "reduced_actionability", 2: "critical_actionability", 3: "infeasible_or_unavoidable"}
PROXIMITY_NAMES = {0: "safe", 1: "caution", 2: "warning", 3: "emergency"}
TAXONOMY_VERSION = "fixed_taxonomy_v1"
FLAG_COLUMNS = (
    "collision_flag", "road_boundary_flag", "lane_buffer_flag", "kinematic_flag", "no_candidate_flag", "no_route_flag",
    "initial_invalid_flag", "parser_error_flag", "candidate_any_feasible", "candidate_all_invalid",
)
LABEL_COLUMNS = (
    "sample_id", "scenario_id", "commonroad_scenario_id", "ego_obstacle_id", "time_step", "known_failure", "unknown_failure",
    "no_failure", "failure_taxonomy", "failure_subtype", "taxonomy_rule_id", "taxonomy_version", "planner_family", "horizon_s",
    "lane_buffer_m", *FLAG_COLUMNS, "candidate_count", "feasible_candidate_count", "candidate_failure_reasons",
)


def _rule(critical: Callable, reduced: Callable, none: Callable = lambda c, e: e <= 0.0) -> Callable[[Column, Column], Column]:
    return lambda c, e: F.when(none(c, e), 3).when(critical(c, e), 2).when(reduced(c, e), 1).otherwise(0)


# Extension point: every rule maps (comfort ratio, emergency ratio) to a level column.
LABEL_RULES: dict[str, Callable[[Column, Column], Column]] = {
    "original": _rule(lambda c, e: (c == 0) & (e > 0), lambda c, e: c < 0.25, lambda c, e: e == 0),
    "moderate": _rule(lambda c, e: (c <= 0.25) | (e <= 0.35), lambda c, e: (c < 0.75) | (e < 0.65)),
    "strict": _rule(lambda c, e: (c <= 0.50) | (e <= 0.50), lambda c, e: (c < 1.00) | (e < 0.85)),
    "emergency_sensitive": _rule(lambda c, e: e <= 0.25, lambda c, e: (e <= 0.60) | (c <= 0.50)),
    "comfort_sensitive": _rule(lambda c, e: c <= 0.25, lambda c, e: c <= 0.75),
    "quantile_like": _rule(lambda c, e: (c <= 0.50) | (e <= 0.4286), lambda c, e: (c <= 0.75) | (e <= 0.7143)),
}


def actionability_label(comfort: Column | str, emergency: Column | str, rule: str) -> Column:
    return LABEL_RULES[rule](num(comfort, 0.0), num(emergency, 0.0)).cast("int")


def name_of(label: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def with_actionability(df: DataFrame, rule: str, comfort: str = "comfort_feasible_ratio", emergency: str = "emergency_feasible_ratio") -> DataFrame:
    lab = actionability_label(comfort, emergency, rule)
    return df.withColumn("actionability_label_id", lab).withColumns({
        "actionability_label_name": name_of(F.col("actionability_label_id"), ACTIONABILITY_NAMES), "rule": F.lit(rule),
        "actionability_binary_degraded": (F.col("actionability_label_id") >= 1).cast("int"),
        "actionability_binary_critical": (F.col("actionability_label_id") >= 2).cast("int"),
        "actionability_binary_infeasible": (F.col("actionability_label_id") == 3).cast("int")})


def proximity_label(df: DataFrame, emergency_m: float = 0.5, warning_m: float = 2.0, caution_m: float = 5.0, warning_s: float = 1.0) -> DataFrame:
    """Level, name and risk from ``d_min``, ``t_at_dmin`` and ``collision_any``; sentinels 9999 and -1 stand for no contact."""
    d, t, hit = F.coalesce(F.col("d_min"), F.lit(9999.0)), F.coalesce(F.col("t_at_dmin"), F.lit(-1.0)), F.coalesce(F.col("collision_any"), F.lit(False))
    level = F.when(hit | (d <= emergency_m), 3).when((d <= warning_m) | ((t > 0) & (t <= warning_s) & (d <= caution_m)), 2).when(
        d <= caution_m, 1).otherwise(0)
    risk = F.least(F.lit(1.0), 0.5 * F.exp(-F.greatest(d, F.lit(0.0)) / 2.0) + 0.25 * F.when(t >= 0, F.exp(-t)).otherwise(0.0)
                   + 0.5 * hit.cast("double"))
    return df.withColumns({
        "dmin_future_m": F.bround(d, 4), "t_at_dmin_s": F.bround(t, 4), "collision_any": hit, "label_id": level.cast("int"),
        "label_name": name_of(level, PROXIMITY_NAMES), "risk_score": round6(risk)})


def feasibility_summary(results: DataFrame, keys: Sequence[str], horizon: Column | float, comfort: str = "comfort",
                        failure_time: str = "failure_time_s", cost: str = "cost") -> DataFrame:
    """Comfort and overall feasible ratios, cheapest feasible action and time until no action is left.

    One row per (keys, action) in; a null failure time means the action stays feasible.
    """
    h = F.lit(float(horizon)) if isinstance(horizon, (int, float)) else horizon
    ok, easy = F.col(failure_time).isNull(), F.col(comfort)
    tally = lambda c: F.sum(c.cast("bigint"))
    until = lambda group: F.when(F.max(F.when(group, ok)), F.max(h)).otherwise(F.max(F.when(group, F.col(failure_time))))
    return results.groupBy(*keys).agg(
        tally(ok & easy).alias("comfort_feasible_count"), tally(easy).alias("comfort_total_count"),
        (tally(ok & easy) / F.nullif(tally(easy), F.lit(0))).alias("comfort_feasible_ratio"),
        tally(ok).alias("emergency_feasible_count"), F.count("*").alias("emergency_total_count"),
        (tally(ok) / F.count("*")).alias("emergency_feasible_ratio"),
        F.min(F.when(ok, F.col(cost))).alias("min_required_action_cost"),
        until(easy).alias("time_to_no_comfort_s"), until(F.lit(True)).alias("time_to_no_emergency_s"))


def planner_labels(candidates: DataFrame, keys: Sequence[str] = ("sample_id",), samples: DataFrame | None = None) -> DataFrame:
    """One planner label per sample from its candidate rows; the cheapest feasible candidate wins, then the lower id.

    With ``samples`` (the keys of all samples) one without candidates fails for the reason ``no_candidate_generated``.
    """
    any_ = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    ok = F.col("feasible")
    best = F.min(F.when(ok, F.struct(F.col("action_cost"), F.col("candidate_id"), F.col("longitudinal_profile"), F.col("lateral_profile"))))
    agg = candidates.groupBy(*keys).agg(
        F.count("*").alias("candidate_count"), F.sum(ok.cast("bigint")).alias("feasible_candidate_count"), best.alias("_best"),
        any_("collision_flag").alias("_c"), any_("lane_buffer_flag").alias("_l"), any_("progress_flag").alias("_p"), any_("kinematic_flag").alias("_k"),
        F.min("first_failure_time_s").alias("first_failure_time_s_min"), F.sum("initial_overlap_count").alias("initial_overlap_count"))
    if samples is not None:
        agg = ordered.match(samples.select(*keys).distinct(), agg, keys, "left").fillna(0, ["candidate_count", "feasible_candidate_count", "initial_overlap_count"])
    c, l, p, k = (F.col(x) for x in ("_c", "_l", "_p", "_k"))
    reason = F.when(F.col("feasible_candidate_count") > 0, "no_failure").when(F.col("candidate_count") == 0, "no_candidate_generated").when(c & l, "collision_and_lane").when(
        c & ~p & ~k, "collision_only").when(l & ~c & ~p & ~k, "lane_buffer_only").when(p & ~c & ~l & ~k, "progress_only").when(
        k & ~c & ~l & ~p, "kinematic_only").otherwise("unknown")
    success = (F.col("feasible_candidate_count") > 0).cast("int")
    return agg.select(
        *keys, success.alias("planner_success"), (1 - success).alias("planner_failure"), "feasible_candidate_count", "candidate_count",
        (F.col("feasible_candidate_count") / F.greatest("candidate_count", F.lit(1))).alias("feasible_candidate_ratio"),
        F.col("_best.action_cost").alias("best_candidate_cost"),
        F.concat_ws("+", "_best.longitudinal_profile", "_best.lateral_profile").alias("best_action_family"),
        reason.alias("planner_failure_reason"), "first_failure_time_s_min", "initial_overlap_count")


def candidate_flags(candidates: DataFrame, key: str = "sample_id", samples: DataFrame | None = None) -> DataFrame:
    """Flags per sample from candidate rows, with the counted failure reasons.

    With ``samples`` (the keys of all samples) one without candidates has ``no_candidate_flag`` 1 and all other flags 0.
    """
    any_ = lambda cond: F.max(F.coalesce(cond, F.lit(False)).cast("int"))
    reason = F.lower(F.coalesce(F.col("failure_reason"), F.lit("")))
    work = candidates.withColumn("_reason", reason)
    n, ok = F.count("*"), F.sum(F.col("feasible").cast("bigint"))
    flags = work.groupBy(key).agg(
        n.alias("candidate_rows"), ok.alias("candidate_feasible_count"), (ok == 0).cast("int").alias("candidate_all_invalid"),
        (ok > 0).cast("int").alias("candidate_any_feasible"), any_(F.col("collision_flag")).alias("collision_flag"),
        any_(F.col("lane_buffer_flag")).alias("road_boundary_flag"), any_(F.col("lane_buffer_flag")).alias("lane_buffer_flag"),
        any_(F.col("progress_flag")).alias("progress_flag"), any_(F.col("kinematic_flag")).alias("kinematic_flag"),
        any_(F.col("_reason").contains("no_route")).alias("no_route_flag"),
        any_(F.col("_reason").contains("initial_invalid")).alias("initial_invalid_flag"),
        any_(F.col("_reason").rlike("parser_error|parse_error")).alias("parser_error_flag"))
    reasons = count_string(work.filter("_reason != ''"), [key], "_reason", "candidate_failure_reasons")
    out = ordered.match(flags, reasons, [key], "left")
    if samples is not None:
        out = ordered.match(samples.select(key).distinct(), out, [key], "left")
    out = out.withColumn("no_candidate_flag", F.col("candidate_rows").isNull().cast("int"))
    return out.fillna(0, [c for c in out.columns if c not in (key, "candidate_failure_reasons")]).fillna("", ["candidate_failure_reasons"])


def derived_reason(df: DataFrame) -> DataFrame:
    """Puts the subtype's own reason in ``planner_failure_reason`` and keeps the planner's in ``raw_planner_failure_reason``."""
    kind, own = F.substring_index("failure_subtype", ":", 1), F.expr("substring(failure_subtype, locate(':', failure_subtype) + 1)")
    reason = F.when(kind.isin("known_failure", "unknown_failure") & F.col("failure_subtype").contains(":"), own).when(
        kind == "no_failure", "no_failure").otherwise(F.col("planner_failure_reason"))
    return df.withColumns({"raw_planner_failure_reason": F.col("planner_failure_reason"), "planner_failure_reason": reason})


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(num(name), F.lit(0.0)) > 0 if name in df.columns else F.lit(False)


def concrete_subtype(collision: Column, road: Column, kinematic: Column) -> Column:
    """``collision``, ``road_boundary`` and ``kinematic`` joined; a single one gets ``_only``."""
    three = collision & road & kinematic
    parts = F.array_compact(F.array(F.when(collision, F.lit("collision")), F.when(road, F.lit("road_boundary")), F.when(kinematic, F.lit("kinematic"))))
    return F.when(three, F.lit("collision_road_boundary_and_kinematic")).when(
        F.size(parts) == 1, F.concat(parts[0], F.lit("_only"))).otherwise(F.array_join(parts, "_and_"))


def failure_taxonomy(df: DataFrame, version: str = TAXONOMY_VERSION) -> DataFrame:
    """Adds taxonomy, subtype, rule id, version and the secondary-sensitivity mark.

    A feasible candidate wins over everything; input problems stay unknown; then a missing candidate set and concrete
    validator flags are known failures; what is left is unattributed.
    """
    flag = lambda n: _flag(df, n)
    feasible = flag("candidate_any_feasible") | flag("planner_success") | flag("feasible_candidate_count")
    parser, route, initial, none = (flag(n) for n in ("parser_error_flag", "no_route_flag", "initial_invalid_flag", "no_candidate_flag"))
    collision, road, kin = flag("collision_flag"), flag("road_boundary_flag") | flag("lane_buffer_flag"), flag("kinematic_flag")
    concrete = collision | road | kin
    known, unknown = "known_failure", "unknown_failure"
    row = lambda tax, sub, rule: F.struct(F.lit(tax).alias("t"), (F.lit(sub) if isinstance(sub, str) else sub).alias("s"), F.lit(rule).alias("r"))
    pick = F.when(feasible, row("no_failure", "no_failure:feasible_trajectory_exists", "E_feasible_trajectory_exists")).when(
        parser, row(unknown, "unknown_failure:parser_error", "C_parser_error")).when(
        route, row(unknown, "unknown_failure:no_route", "C_no_route")).when(
        initial, row(unknown, "unknown_failure:initial_invalid", "C_initial_invalid")).when(
        none, row(known, "known_failure:no_valid_trajectory", "A_no_candidate")).when(
        concrete, row(known, F.concat(F.lit("known_failure:"), concrete_subtype(collision, road, kin)), "D_all_invalid_concrete_validator_flag")).otherwise(
        row(unknown, "unknown_failure:all_invalid_unattributed", "F_all_invalid_unattributed"))
    out = df.withColumn("_x", pick).withColumns({
        "failure_taxonomy": F.col("_x.t"), "failure_subtype": F.col("_x.s"), "taxonomy_rule_id": F.col("_x.r"),
        "taxonomy_version": F.lit(version),
        "taxonomy_secondary_sensitivity": (F.col("_x.s") == "known_failure:kinematic_only").cast("int")})
    return out.drop("_x")


def legacy_taxonomy(failure: Column | str, reason: Column | str) -> Column:
    text = F.lower(F.coalesce(as_col(reason).cast("string"), F.lit("")))
    vague = text.isin("", "unknown", "nan", "missing") | text.rlike(
        "unknown|parser|parse_error|runtime|software|numerical|missing|validator|timeout_without")
    failed = F.coalesce(num(failure), F.lit(0.0)).cast("int") == 1
    return F.when(failed & vague, "unknown_failure").when(failed, "known_failure").otherwise("no_failure")


def finalize_labels(labels: DataFrame, manifest: DataFrame | None = None, horizon_s: float = 3.0, lane_buffer_m: float = 4.0,
                    family: str = "lattice_base") -> DataFrame:
    """Outcome one-hots, defaults for absent columns and the fixed column order first."""
    out = labels
    if manifest is not None:
        extra = [c for c in ("ego_obstacle_id", "current_time_step") if c in manifest.columns and c not in labels.columns]
        if extra:
            out = out.join(manifest.select("sample_id", *extra), "sample_id", "left")
    if "time_step" not in out.columns:
        out = out.withColumn("time_step", F.col("current_time_step").cast("string") if "current_time_step" in out.columns else F.lit(""))
    one = lambda v: (F.coalesce(F.col("failure_taxonomy"), F.lit("")) == v).cast("int")
    out = out.withColumns({v: one(v) for v in ("known_failure", "unknown_failure", "no_failure")})
    defaults = {"horizon_s": F.lit(horizon_s), "lane_buffer_m": F.lit(lane_buffer_m), "candidate_failure_reasons": F.lit(""), "planner_family": F.lit(family)}
    defaults |= {c: F.lit(0) for c in FLAG_COLUMNS}
    out = out.withColumns({k: v for k, v in defaults.items() if k not in out.columns})
    out = out.withColumn("planner_family", F.coalesce(F.nullif(F.col("planner_family"), F.lit("")), F.lit(family)))
    first = [c for c in LABEL_COLUMNS if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def merge_scores_labels(scores: DataFrame, labels: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Score rows with their labels (inner) and manifest facts (left); taxonomy is derived where labels lack it."""
    from feaslens.functions.columns import with_scenario_id
    lab = labels if "failure_taxonomy" in labels.columns else failure_taxonomy(labels)
    own = [c for c in lab.columns if c == "sample_id" or c not in scores.columns]
    out = scores.join(lab.select(*own), "sample_id")
    if manifest is not None:
        more = [c for c in manifest.columns if c == "sample_id" or c not in out.columns]
        out = out.join(manifest.select(*more), "sample_id", "left")
    return with_scenario_id(out).withColumn("known_failure", (F.col("failure_taxonomy") == "known_failure").cast("int"))


def self_leakage(agents: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Does the ego id also appear among the obstacles?"""
    ego = F.max(F.when(F.col("is_ego"), F.col("agent_id")))
    ids = agents.filter("is_ego").groupBy(*keys).agg(F.max("agent_id").alias("_ego"))
    rows = agents.join(ids, list(keys), "left")
    hit = (~F.col("is_ego") & (F.col("agent_id") == F.col("_ego"))).cast("bigint")
    return rows.groupBy(*keys).agg(ego.alias("ego_id"), F.coalesce(F.sum(hit), F.lit(0)).alias("leaked_rows")).withColumn(
        "self_leakage", F.col("leaked_rows") > 0)


AUDIT_MODES = ("original_oracle_map", "oracle_map_ignore_initial", "oracle_no_map", "cv_current_map", "cv_current_no_map")


def audit_summary(actions: DataFrame, cases: DataFrame, label: str = "actionability_label_id", key: str = "sample_id") -> DataFrame:
    """Feasible actions per audit mode and the sensitivity flags of a case.

    ``actions`` has ``checked_mode``, ``feasible`` and ``unsafe_reason_primary``, one row per action and mode. The most common reason of
    the original mode is reported; equal counts go to the first reason by name.
    """
    n = lambda m: F.coalesce(F.sum(F.when((F.col("checked_mode") == m) & F.col("feasible"), 1)), F.lit(0)).cast("bigint")
    counts = actions.groupBy(key).agg(*[n(m).alias(f"feasible_actions_{m}") for m in AUDIT_MODES])
    bad = actions.filter((F.col("checked_mode") == AUDIT_MODES[0]) & (F.col("unsafe_reason_primary") != "no_failure"))
    top = bad.groupBy(key, "unsafe_reason_primary").agg(F.count("*").alias("n")).groupBy(key).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("unsafe_reason_primary").alias("reason"))).alias("_t"))
    out = cases.join(counts, key, "left").fillna(0, [f"feasible_actions_{m}" for m in AUDIT_MODES]).join(top, key, "left")
    orig, ignore, nomap, cv, _ = (F.col(f"feasible_actions_{m}") for m in AUDIT_MODES)
    return out.withColumns({
        "dominant_unsafe_reason_original": F.coalesce(F.col("_t.reason"), F.lit("no_failure")),
        "map_sensitive_flag": (orig == 0) & (nomap > 0), "initial_time_sensitive_flag": (orig == 0) & (ignore > 0),
        "obstacle_prediction_sensitive_flag": (orig == 0) & (cv > 0),
        "suspicious_label_flag": (F.coalesce(num(label), F.lit(-1.0)) >= 2) & (orig == 0) & (F.greatest(ignore, nomap, cv) >= 3),
    }).drop("_t")


def audit_fractions(summary: DataFrame, category: str, reasons: Sequence[str]) -> DataFrame:
    """Flag shares and reason counts per case category."""
    flags = ("map_sensitive", "initial_time_sensitive", "obstacle_prediction_sensitive", "suspicious_label")
    reason = F.col("dominant_unsafe_reason_original")
    return summary.groupBy(category).agg(
        F.count("*").alias("n_samples"), *[F.avg(F.col(f"{f}_flag").cast("double")).alias(f"fraction_{f}") for f in flags],
        *[F.sum((reason == r).cast("bigint")).alias(f"dominant_reason_{r}_count") for r in reasons])
