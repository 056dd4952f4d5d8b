"""Audits over tables: joins, future validity, label shifts, taxonomy recodes, strata, gates.

Reports are grouped aggregates of contingency tables; a hot label, reason or scenario is combined map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.functions.columns import bucket, count_string, non_negative_or_null, num, num_filled, num_or, ttc_capped, ttc_sentinel, with_scenario_id
from feaslens.operators import bootstrap, labels, metrics, ordered

# Reason tokens whose bursts are checked, and gate levels.
BURST_TOKENS = ("parser_error", "no_route", "initial_invalid")
MIN_POSITIVES, MIN_POSITIVE_SCENARIOS, MAX_PER_SCENARIO, CLEAR_LOSS = 150, 75, 10, -0.02


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_checked(left: DataFrame, right: DataFrame, key: str, validate: str = "one_to_one", suffix: str = "_right") -> DataFrame:
    """Inner join that refuses duplicate keys on the sides named by ``validate``; shared columns of the right side get a suffix."""
    for side, frame, must in (("left", left, validate.startswith("one")), ("right", right, validate.endswith("one"))):
        if must and not frame.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"{side} side has duplicate {key}")
    shared = [c for c in right.columns if c != key and c in left.columns]
    return left.join(right.withColumnsRenamed({c: f"{c}{suffix}" for c in shared}), key)


def cardinality_audit(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows, distinct keys and duplicates per table, and the size of every inner join, from key counts (no join is materialised).

    Sizes over 2^63 - 1 rows are null.
    """
    counts = {n: t.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")) for n, t in tables.items()}
    parts = [c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).select(
        F.lit(n).alias("table"), F.lit("").alias("other"), "n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_duplicates")) for n, c in counts.items()]
    names = list(counts)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            j = counts[a].withColumnRenamed("n", "a").join(counts[b].withColumnRenamed("n", "b"), "k")
            parts.append(j.agg(F.coalesce(F.sum(F.col("a").cast("decimal(19,0)") * F.col("b").cast("decimal(19,0)")), F.lit(0)).try_cast("bigint").alias("n_rows"), F.count("*").alias("n_keys")).select(
                F.lit(a).alias("table"), F.lit(b).alias("other"), "n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_duplicates")))
    return _union(parts)


def future_validity(states: DataFrame, grains: Sequence[str], low: float = 0.75) -> DataFrame:
    """Slots and valid slots of non-ego states at several grains in one pass (grouping sets)."""
    rows = states.filter("not is_ego").select(*grains, F.col("valid"))
    sets = rows.groupingSets([[g] for g in grains], *grains).agg(
        F.count("*").alias("total_slots"), F.sum(F.col("valid").cast("bigint")).alias("valid_slots"), F.grouping_id(*grains).alias("_g"))
    n = len(grains)
    # The grouping id has a 1 for every column that is folded away.
    code = {((1 << n) - 1) ^ (1 << (n - 1 - i)): g for i, g in enumerate(grains)}
    grain, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, g in code.items():
        grain, value = F.when(F.col("_g") == k, F.lit(g)).otherwise(grain), F.when(F.col("_g") == k, F.col(g).cast("string")).otherwise(value)
    rate = F.col("valid_slots") / F.col("total_slots")
    return sets.select(grain.alias("grain"), value.alias("value"), "total_slots", "valid_slots", rate.alias("future_valid_rate"), (rate < low).alias("low_validity"))


def imputation_stats(imputed: DataFrame, labels_df: DataFrame, label: str = "actionability_label_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per sample, per label, and the list at or above the 95% quantile of the imputed share.

    ``imputed`` comes from ``impute_future``: column ``source`` tells recorded from extrapolated states.
    """
    slots = imputed.filter(~F.col("is_ego") & (F.col("k") >= 1))
    bad = F.col("source") != "recorded"
    tally = lambda c: F.sum(c.cast("bigint"))
    per = slots.groupBy("sample_id").agg(
        F.count("*").alias("total_future_slots"), tally(bad).alias("invalid_future_slots"), tally(F.col("source").startswith("cv")).alias("imputed_future_slots"),
        F.countDistinct(F.when(bad, F.col("agent_id"))).alias("actors_with_invalid_future"))
    per = per.withColumn("imputed_fraction", F.col("imputed_future_slots") / F.col("total_future_slots"))
    joined = per.join(labels_df.select("sample_id", F.col(label).alias("label_id")), "sample_id")
    by = joined.groupBy("label_id").agg(F.count("*").alias("n_samples"), *[F.sum(c).alias(c) for c in ("total_future_slots", "invalid_future_slots", "imputed_future_slots")],
                                        F.avg("imputed_fraction").alias("mean_sample_imputed_fraction"))
    by = ordered.match(by, ordered.quantiles(joined, "imputed_fraction", [0.5], ["label_id"], names=["median_sample_imputed_fraction"]), ["label_id"])
    top = per.withColumn("_p95", ordered.quantile_row(per, ["imputed_fraction"], [0.95]).select("imputed_fraction__q0").scalar())
    return per, by, top.filter(F.col("imputed_fraction") >= F.col("_p95")).drop("_p95")


def label_shift(df: DataFrame, a: str, b: str, original: str | None = None) -> DataFrame:
    """Changed share and directional shifts, each with its own denominator."""
    x, y = num(a), num(b)
    crit, eased = x >= 2, y <= 1
    specs = [("fraction_changed", x != y, F.lit(True)), ("fraction_map_critical_infeasible_to_nomap_high_reduced", crit & eased, crit),
             ("fraction_map_infeasible_to_nomap_non_infeasible", (x == 3) & (y != 3), x == 3)]
    if original is not None:
        safe = num(original).isin(0, 1)
        specs.append(("fraction_original_safe_map_critical_infeasible_to_nomap_high_reduced", safe & crit & eased, safe & crit))
    tally = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
    wide = df.agg(*[tally(n).alias(f"n{i}") for i, (_, n, _) in enumerate(specs)], *[tally(d).alias(f"d{i}") for i, (_, _, d) in enumerate(specs)])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n{i}").alias("count"), F.col(f"d{i}").alias("denominator")) for i, (m, _, _) in enumerate(specs)])).alias("r")
    return wide.select(rows).select("r.*").withColumn("fraction", F.col("count") / F.nullif(F.col("denominator"), F.lit(0)))


def rule_sweep(df: DataFrame, comfort: str, emergency: str, distance: str, original: str, rules: Sequence[str] = tuple(labels.LABEL_RULES), buckets=None) -> DataFrame:
    """Distribution, rank correlation with distance and the non-degeneracy checks of every label rule."""
    lab = F.explode(F.array(*[F.struct(F.lit(r).alias("rule_name"), labels.actionability_label(comfort, emergency, r).alias("label")) for r in rules])).alias("_r")
    long = df.select(num(distance).alias("distance"), num(original).cast("int").alias("original_label_id"), lab).select("distance", "original_label_id", "_r.*")
    n = F.count("*")
    share = lambda k: F.sum((F.col("label") == k).cast("bigint")) / n
    dist = long.groupBy("rule_name").agg(n.alias("n"), share(0).alias("high_fraction"), share(1).alias("reduced_fraction"), share(2).alias("critical_fraction"),
                                         share(3).alias("infeasible_fraction"))
    # The distance ranks are shared by all rules: rank the distinct distances once.
    work = df.select(num(distance).alias("x")).filter("x is not null")
    ranks = ordered.average_rank(work, (), "x", buckets).select(F.col("x").alias("distance"), F.col("rank").alias("rx"))
    per_label = long.filter("distance is not null").groupBy("rule_name", "label").agg(F.count("*").alias("c"))
    w = Window.partitionBy("rule_name").orderBy("label")
    lab_rank = per_label.select("rule_name", "label", (F.sum("c").over(w) - F.col("c") + (F.col("c") + 1) / 2.0).alias("ry"))
    cells = long.filter("distance is not null").groupBy("rule_name", "label", "distance").agg(F.count("*").alias("c"))
    moments = cells.join(ranks, "distance").join(lab_rank, ["rule_name", "label"]).groupBy("rule_name").agg(*metrics.weighted_moments("rx", "ry", "c", "s"))
    rho = moments.select("rule_name", metrics.weighted_corr("s").alias("spearman_current_min_distance_m"))
    h, rd, c, i, s = (F.col(x) for x in ("high_fraction", "reduced_fraction", "critical_fraction", "infeasible_fraction", "spearman_current_min_distance_m"))
    ok = h.between(0.30, 0.80) & (rd >= 0.05) & (c >= 0.02) & i.between(0.002, 0.15) & F.coalesce(F.abs(s) < 0.6, F.lit(True))
    return dist.join(rho, "rule_name", "left").withColumn("non_degenerate", ok)


def rule_tables(df: DataFrame, comfort: str, emergency: str, original: str, rules: Sequence[str] = tuple(labels.LABEL_RULES)) -> DataFrame:
    """Cross table of original and new label, and mean ratios, per rule: long rows (rule, original, new, count, means)."""
    lab = F.explode(F.array(*[F.struct(F.lit(r).alias("rule_name"), labels.actionability_label(comfort, emergency, r).alias("new_label_id")) for r in rules])).alias("_r")
    return df.select(num(original).cast("int").alias("original_label_id"), num(comfort).alias("c"), num(emergency).alias("e"), lab).groupBy(
        "_r.rule_name", "original_label_id", "_r.new_label_id").agg(F.count("*").alias("count"), F.avg("c").alias("comfort_mean"), F.avg("e").alias("emergency_mean"))


TTC_VIEWS = {"valid_ttc_only": non_negative_or_null, "no_ttc_as_category": ttc_sentinel, "capped_ttc_prespecified_10s": lambda c: ttc_capped(c, 10.0),
             "inverse_ttc_prespecified": lambda c: 1.0 / F.greatest(F.coalesce(non_negative_or_null(c), F.lit(10.0)), F.lit(0.1)), "legacy_sentinel": num}


def ttc_missingness(df: DataFrame, ttc: str) -> DataFrame:
    t = num(ttc)
    cats = F.array(F.struct(F.lit("valid_ttc").alias("category"), (t >= 0).alias("hit")), F.struct(F.lit("invalid_or_no_closing_ttc").alias("category"), (t < 0).alias("hit")),
                   F.struct(F.lit("non_finite_ttc").alias("category"), t.isNull().alias("hit")))
    rows = df.select(F.explode(cats).alias("c")).select("c.*")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return rows.groupBy("category").agg(F.sum(hit.cast("bigint")).alias("count"), F.avg(hit.cast("double")).alias("rate"))


def ttc_sensitivity(df: DataFrame, ttc: str, label: str, distance: str, group: str, n_boot: int, seed: int = 42, buckets=None) -> DataFrame:
    """Bootstrap rank correlation of the label with distance and with every representation of the time to collision, in one pass."""
    views = [F.struct(F.lit("current_min_distance_m").alias("variable"), num(distance).alias("x"))]
    views += [F.struct(F.lit(n).alias("variable"), f(ttc).alias("x")) for n, f in TTC_VIEWS.items()]
    long = df.select(F.col(group).alias("g"), num(label).alias("y"), F.explode(F.array(*views)).alias("v")).select("g", "y", "v.*")
    return bootstrap.spearman_ci(long, "x", "y", "g", n_boot, seed, ["variable"], buckets)


def ttc_strata(df: DataFrame, ttc: str, distance: str, label: str) -> DataFrame:
    """Label counts per distance and time stratum."""
    d = bucket(distance, [2, 5, 10], ["lt2m", "2to5m", "5to10m", "ge10m"], "missing")
    t = bucket(ttc_capped(ttc, 10.0), [1, 3, 10], ["lt1s", "1to3s", "3to10s", "no_or_ge10s"], "missing")
    rows = df.select(num(label).cast("int").alias("l"), F.explode(F.array(
        F.struct(F.lit("distance_stratum").alias("stratum_type"), d.alias("stratum")), F.struct(F.lit("ttc_stratum").alias("stratum_type"), t.alias("stratum")))).alias("s")).select("l", "s.*")
    return rows.groupBy("stratum_type", "stratum").agg(F.count("*").alias("n"), *[F.sum((F.col("l") == k).cast("bigint")).alias(f"label_{k}_count") for k in range(4)])


def taxonomy_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and rates of agreement between a base and an extended taxonomy (long rows)."""
    x, y = F.col(a) == "known_failure", F.col(b) == "known_failure"
    tally = lambda c: F.sum(c.cast("bigint")).cast("double")
    n = F.count("*").cast("double")
    same = F.col(a) == F.col(b)
    cols = {"matched_samples": n, "taxonomy_agreement_count": tally(same), "taxonomy_agreement_rate": tally(same) / n, "known_failure_agreement_count": tally(x == y),
            "known_failure_agreement_rate": tally(x == y) / n, "base_known_failure_count": tally(x), "extended_known_failure_count": tally(y),
            "base_only_positives": tally(x & ~y), "extended_only_positives": tally(~x & y), "both_positive": tally(x & y), "both_not_positive": tally(~x & ~y)}
    wide = df.agg(*[v.alias(k) for k, v in cols.items()])
    return ordered.melt(wide, [], list(cols), "metric", "value")


def _top_value(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most common value per key, smallest on ties, by two-level counting."""
    counts = df.groupBy(*keys, F.coalesce(F.col(value), F.lit("")).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("_t")).select(*keys, F.col("_t.v").alias(out))


def taxonomy_disagreement(df: DataFrame, a: str, b: str, a_sub: str, b_sub: str, scenario: str, top: int = 20) -> DataFrame:
    """Transitions with their most common subtypes, and the scenarios that disagree most."""
    x, y = F.col(a) == "known_failure", F.col(b) == "known_failure"
    kind = F.when(x & ~y, "base_only_positive").when(~x & y, "extended_only_positive").when(x & y, "positive_agreement").otherwise("negative_or_unknown_agreement")
    sections = F.explode(F.array(F.struct(F.lit("taxonomy_transition").alias("section"), F.concat_ws(" -> ", a, b).alias("transition")),
                                 F.struct(F.lit("positive_transition").alias("section"), kind.alias("transition")))).alias("_s")
    long = df.select(a_sub, b_sub, sections).select(a_sub, b_sub, "_s.*")
    keys = ["section", "transition"]
    base = long.groupBy(*keys).agg(F.count("*").alias("count"))
    out = base.join(_top_value(long, keys, a_sub, "base_failure_subtype_top"), keys).join(_top_value(long, keys, b_sub, "extended_failure_subtype_top"), keys)
    worst = df.filter(F.col(a) != F.col(b)).groupBy(F.col(scenario).cast("string").alias("transition")).agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), "transition").limit(top).select(F.lit("top_disagreement_scenario").alias("section"), "transition", "count")
    return _union([out, worst])


def recode_audit(old: DataFrame, fixed: DataFrame) -> DataFrame:
    """Old taxonomy (from failure flag and reason) next to the fixed one, per sample."""
    reason = "raw_planner_failure_reason" if "raw_planner_failure_reason" in old.columns else "planner_failure_reason"
    a = with_scenario_id(old).select("sample_id", "scenario_id", labels.legacy_taxonomy("planner_failure", reason).alias("old_failure_taxonomy"),
                                     F.col("planner_failure_reason").alias("old_planner_failure_reason"))
    b = fixed.select("sample_id", F.col("failure_taxonomy").alias("fixed_failure_taxonomy"), F.col("failure_subtype").alias("fixed_failure_subtype"),
                     F.col("taxonomy_rule_id").alias("fixed_taxonomy_rule_id"))
    j = a.join(b, "sample_id")
    return j.withColumns({"recode": F.concat_ws("_to_", "old_failure_taxonomy", "fixed_failure_taxonomy"),
                          "recode_changed": F.col("old_failure_taxonomy") != F.col("fixed_failure_taxonomy")})


def burst_check(df: DataFrame, reason: str = "planner_failure_reason", scenario: str = "scenario_id", tokens: Sequence[str] = BURST_TOKENS) -> DataFrame:
    """Per token: rows, scenarios, largest share of one scenario, concentrated or not."""
    text = F.lower(F.coalesce(F.col(reason), F.lit("")))
    hits = F.explode(F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in tokens]))).alias("reason_token")
    per = df.select(F.col(scenario).alias("s"), hits).groupBy("reason_token", "s").agg(F.count("*").alias("n"))
    agg = per.groupBy("reason_token").agg(F.sum("n").alias("count"), F.count("*").alias("scenario_count"), F.max("n").alias("max_count_in_one_scenario"))
    every = df.sparkSession.createDataFrame([(t,) for t in tokens], "reason_token string")
    out = every.join(agg, "reason_token", "left").fillna(0, ["count", "scenario_count", "max_count_in_one_scenario"])
    share = F.col("max_count_in_one_scenario") / F.greatest(F.col("count"), F.lit(1))
    return out.withColumns({"max_scenario_fraction": share, "concentrated": (share >= 0.5) & (F.col("count") >= 5)})


def unknown_distributions(df: DataFrame, dimensions: Sequence[str], taxonomy: str = "failure_taxonomy") -> DataFrame:
    """Values of every dimension among unknown failures, with their share."""
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("missing")).alias("value")) for d in dimensions])).alias("d")
    counts = df.filter(F.col(taxonomy) == "unknown_failure").select(rows).select("d.*").groupBy("dimension", "value").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("dimension"))
    return counts.withColumn("fraction_of_unknown", F.col("count") / total)


def unknown_by_stratum(df: DataFrame, strata: Sequence[str], taxonomy: str = "failure_taxonomy") -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("stratum_column"), F.coalesce(F.col(d).cast("string"), F.lit("missing")).alias("stratum")) for d in strata])).alias("d")
    counts = df.select(rows, (F.col(taxonomy) == "unknown_failure").cast("bigint").alias("u")).select("d.*", "u").groupBy("stratum_column", "stratum").agg(
        F.sum("u").alias("unknown_count"), F.count("*").alias("total_count"))
    total = F.sum("unknown_count").over(Window.partitionBy("stratum_column"))
    return counts.withColumns({"unknown_rate": F.col("unknown_count") / F.col("total_count"), "fraction_of_unknown": F.col("unknown_count") / F.greatest(total, F.lit(1))}).filter("unknown_count > 0")


def unknown_by_scenario(df: DataFrame, scenario: str = "scenario_id", taxonomy: str = "failure_taxonomy", reason: str = "planner_failure_reason") -> DataFrame:
    u = F.col(taxonomy) == "unknown_failure"
    counts = df.groupBy(scenario).agg(F.sum(u.cast("bigint")).alias("unknown_count"), F.count("*").alias("total_count")).filter("unknown_count > 0")
    reasons = count_string(df.filter(u).withColumn(reason, F.coalesce(F.col(reason), F.lit(""))), [scenario], reason, "failure_reasons")
    return counts.join(reasons, scenario, "left").withColumn("unknown_rate", F.col("unknown_count") / F.col("total_count"))


def suggest_recode(df: DataFrame, taxonomy: str = "failure_taxonomy", keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Recode proposal for unknown failures from their flags, with rationale and confidence."""
    flag = lambda n: num_filled(df, n) == 1
    reason = F.lower(F.coalesce(F.col("planner_failure_reason"), F.lit(""))) if "planner_failure_reason" in df.columns else F.lit("")
    blocked = flag("parser_error_flag") | flag("no_route_flag") | flag("initial_invalid_flag")
    c, rd, k = flag("collision_flag"), flag("road_boundary_flag"), flag("kinematic_flag")
    row = lambda a, b, d, e: F.struct(F.lit(a).alias("suggested_recode"), (F.lit(b) if isinstance(b, str) else b).alias("suggested_subtype"), F.lit(d).alias("rationale"), F.lit(e).alias("confidence"))
    parts = F.array_join(F.array_compact(F.array(F.when(c, F.lit("collision")), F.when(rd, F.lit("road_boundary")), F.when(k, F.lit("kinematic")))), "_and_")
    pick = F.when(flag("no_candidate_flag") & ~blocked, row("known_failure", "known_failure:no_valid_trajectory", "A: no candidate was generated and the input was fine", "high")).when(
        reason.contains("timeout") & flag("candidate_all_invalid"), row("possible_known_failure", "possible_known_failure_timeout_all_invalid", "B: timeout while every candidate was invalid", "medium")).when(
        c | rd | k, row("known_failure", F.concat(F.lit("known_failure:"), parts), "D: a validator flag is set despite the unknown taxonomy", "high")).when(
        flag("candidate_any_feasible"), row("no_failure", "no_failure:feasible_trajectory_exists", "E: no failure flag and a feasible trajectory", "high")).otherwise(
        row("keep_unknown", "missing_validator_output_or_incomplete_rollout", "no recode rule applies", "low"))
    return df.filter(F.col(taxonomy) == "unknown_failure").select(*keep, F.col(taxonomy).alias("old_failure_taxonomy"), pick.alias("_p")).select(*keep, "old_failure_taxonomy", "_p.*")


def negative_delta_audit(df: DataFrame, comparisons: Sequence[tuple[str, str]], strata: Sequence[str], min_pos: int = 10, taxonomy: str = "failure_taxonomy",
                         subtype: str = "failure_subtype", scenario: str = "scenario_id", buckets=None) -> DataFrame:
    """Strata with enough positives: score gain per (enhanced, baseline) with composition shares and top subtypes."""
    known = (F.col(taxonomy) == "known_failure").cast("int")
    scores = list(dict.fromkeys(s for pair in comparisons for s in pair))
    work = df.withColumn("_y", known)
    keys = ["stratum_column", "stratum"]
    long = metrics.stratum_long(work, "_y", strata, scores)
    table = metrics.curve(long, "y", "score", [*keys, "score_name"], buckets).groupBy(*keys, "score_name").agg(
        metrics.auprc_expr().alias("auprc"), F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positive_count"))
    wide = table.groupBy(*keys).agg(*[F.max(F.when(F.col("score_name") == s, F.col("auprc"))).alias(f"_a_{s}") for s in scores],
                                    F.max("n").alias("n"), F.max("positive_count").alias("positive_count"))
    pairs = F.explode(F.array(*[F.struct(F.lit(e).alias("enhanced_score"), F.lit(b).alias("baseline_score"), F.col(f"_a_{e}").alias("enhanced_AUPRC"),
                                         F.col(f"_a_{b}").alias("baseline_AUPRC")) for e, b in comparisons])).alias("_p")
    deltas = wide.filter(F.col("positive_count") >= min_pos).select(*keys, "n", "positive_count", pairs).select(*keys, "n", "positive_count", "_p.*")
    flags = {"low_speed_fraction": num_or(df, "ego_speed_mps") < 5.0, "near_overlap_fraction": num_or(df, "current_min_distance_m") < 1.0,
             "initial_overlap_fraction": num_filled(df, "initial_overlap_count") > 0}
    pos_flags = {f"{n}_positive_fraction": num_filled(df, f"{n}_flag") > 0 for n in ("collision", "road_boundary", "kinematic")}
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("stratum_column"), F.col(c).cast("string").alias("stratum")) for c in strata])).alias("_s")
    facts = work.select("_y", F.col(scenario).alias("_sc"), F.coalesce(F.col(subtype), F.lit("")).alias("_sub"), *[F.coalesce(v, F.lit(False)).cast("double").alias(k) for k, v in {**flags, **pos_flags}.items()], s
                        ).select("*", "_s.*")
    comp = facts.groupBy(*keys).agg(*[F.avg(k).alias(k) for k in flags], *[F.avg(F.when(F.col("_y") == 1, F.col(k))).alias(k) for k in pos_flags],
                                    F.countDistinct(F.when(F.col("_y") == 1, F.col("_sc"))).alias("positive_scenario_count"))
    subs = facts.filter("_y = 1").groupBy(*keys, "_sub").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "_sub"))
    top = subs.withColumn("_r", rank).filter("_r <= 5").groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_sub", "c"))), lambda v: F.concat_ws(":", v["_sub"], v["c"].cast("string"))), ";").alias("top_failure_subtypes"))
    delta = F.col("enhanced_AUPRC") - F.col("baseline_AUPRC")
    out = ordered.match(ordered.match(deltas.withColumn("AUPRC_delta", delta), comp, keys), top, keys, "left")
    return out.withColumns({"negative_delta": F.coalesce(F.col("AUPRC_delta") < 0, F.lit(False)), "clearly_negative_delta": F.coalesce(F.col("AUPRC_delta") < CLEAR_LOSS, F.lit(False))})


def subtype_summary(df: DataFrame, keep: Column, scenario: str = "scenario_id", by: Sequence[str] = ("failure_subtype", "planner_failure_reason"), taxonomy: str = "failure_taxonomy") -> DataFrame:
    """Subtypes of known failures inside a stratum, with flag counts."""
    rows = df.filter(keep & (F.col(taxonomy) == "known_failure"))
    on = lambda n: F.sum((num_filled(df, n) > 0).cast("bigint")).alias(f"{n}_rows")
    return rows.groupBy(*by).agg(F.count("*").alias("count"), F.countDistinct(scenario).alias("scenario_count"),
                                 *[on(n) for n in ("collision_flag", "road_boundary_flag", "kinematic_flag", "initial_overlap_count")])


def mismatch_matrix(labels_df: DataFrame, preds: DataFrame, base: str = "baseline", enhanced: str = "enhanced", buckets=None) -> DataFrame:
    """Gain of the enhanced over the baseline feature set for every (label variant, feature variant).

    ``labels_df(sample_id, label_variant, y)`` and ``preds(sample_id, feature_variant, feature_set, score)`` join on the sample; all cells share one plan.
    Neither side is small, whatever the estimate of an exploded one says, so the join is told not to broadcast.
    """
    rows = labels_df.select("sample_id", "label_variant", "y").join(preds.select("sample_id", "feature_variant", "feature_set", "score").hint("merge"), "sample_id")
    keys = ["label_variant", "feature_variant", "feature_set"]
    table = metrics.curve(rows, "y", "score", keys, buckets).groupBy(*keys).agg(
        metrics.auprc_expr().alias("auprc"), metrics.strict_exprs(0.05)[0].alias("recall"), F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("p"))
    pick = lambda s, c: F.max(F.when(F.col("feature_set") == s, F.col(c)))
    out = table.groupBy("label_variant", "feature_variant").agg(
        pick(base, "n").alias("n"), pick(base, "p").alias("positive_count"), pick(base, "auprc").alias("baseline_AUPRC"), pick(enhanced, "auprc").alias("enhanced_AUPRC"),
        (pick(enhanced, "auprc") - pick(base, "auprc")).alias("delta_AUPRC"), (pick(enhanced, "recall") - pick(base, "recall")).alias("delta_recall_5pct_fpr_strict"))
    return out.withColumn("diagonal", F.col("label_variant") == F.col("feature_variant"))


def mismatch_summary(matrix: DataFrame) -> DataFrame:
    """Median gains on and off the diagonal, share of positive cells, retention. The matrix has a few dozen cells."""
    d, off = F.col("delta_AUPRC"), ~F.col("diagonal")
    med_off, med_on = F.percentile(F.when(off, d), 0.5), F.percentile(F.when(~off, d), 0.5)
    return matrix.agg(med_off.alias("median_offdiagonal_delta_AUPRC"), (F.avg(F.when(off, (d > 0).cast("double"))) * 100.0).alias("percent_offdiagonal_positive"),
                      med_on.alias("median_diagonal_delta_AUPRC"), (med_off / F.nullif(med_on, F.lit(0.0))).alias("offdiagonal_gain_retention_vs_diagonal"))


def mismatch_wide(matrix: DataFrame, feature_variants: Sequence[str]) -> DataFrame:
    return matrix.groupBy("label_variant").pivot("feature_variant", list(feature_variants)).agg(F.max("delta_AUPRC"))


def stability(metrics_df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean and range over seeds or folds."""
    aggs = []
    for v in values:
        aggs += [F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.avg(v).alias(f"{v}_mean"), (F.max(v) - F.min(v)).alias(f"{v}_range")]
    return metrics_df.groupBy(*keys).agg(F.count("*").alias("n_runs"), *aggs)


def funnel(stages: Sequence[tuple[str, DataFrame]], key: str, scenario: str) -> DataFrame:
    parts = [d.groupBy(scenario).agg(F.count("*").alias("n"), F.countDistinct(key).alias("k")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_keys"), F.count("*").alias("n_scenarios")).select(
        F.lit(i).alias("stage_ix"), F.lit(name).alias("stage"), "n_rows", "n_keys", "n_scenarios") for i, (name, d) in enumerate(stages)]
    return _union(parts)


def gates(labels_df: DataFrame, deltas: DataFrame | None = None, reason: str = "planner_failure_reason", scenario: str = "scenario_id", min_positives: int = MIN_POSITIVES,
          min_scenarios: int = MIN_POSITIVE_SCENARIOS, max_per_scenario: int = MAX_PER_SCENARIO) -> DataFrame:
    """One row per evidence gate with its value, limit and pass flag."""
    known, unknown = F.col("failure_taxonomy") == "known_failure", F.col("failure_taxonomy") == "unknown_failure"
    tally = lambda c: F.sum(c.cast("bigint"))
    per = labels_df.groupBy(scenario).agg(F.count("*").alias("n"), tally(known).alias("k"), tally(unknown).alias("u"))
    facts = per.agg(F.sum("k").alias("known"), tally(F.col("k") > 0).alias("scen"), F.sum("u").alias("unknown"), F.max("n").alias("largest"))
    burst = burst_check(labels_df, reason, scenario).agg(F.sum(F.col("concentrated").cast("bigint")).alias("bursts"))
    row = lambda n, v, lim, ok: F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), lim.cast("double").alias("limit"), ok.alias("passed"))
    wide = facts.crossJoin(burst)  # one row each
    c = F.col
    rows = F.array(row("known_positives", c("known"), F.lit(min_positives), c("known") >= min_positives),
                   row("positive_scenarios", c("scen"), F.lit(min_scenarios), c("scen") >= min_scenarios),
                   row("unknown_not_above_known", c("unknown"), c("known"), c("unknown") <= c("known")),
                   row("no_concentrated_burst", c("bursts"), F.lit(0), c("bursts") == 0),
                   row("samples_per_scenario", c("largest"), F.lit(max_per_scenario), c("largest") <= max_per_scenario))
    out = wide.select(F.explode(rows).alias("g")).select("g.*")
    if deltas is None:
        return out
    won = bootstrap.wins(deltas).select(F.concat(F.lit("beats:"), F.concat_ws(">", "enhanced", "baseline"), F.lit(":"), F.col("metric")).alias("gate"),
                                        F.col("ci_low").alias("value"), F.lit(0.0).alias("limit"), F.col("win").alias("passed"))
    return out.unionByName(won)


def _paired(table: DataFrame, by: Sequence[str], scores: Sequence[str], baselines: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per group and (score, baseline) with the change of every metric, null where one of the two is missing. Of repeated rows the largest metric counts."""
    at = lambda s, v: F.max(F.when(F.col("score_name") == s, F.col(v)))
    pairs = F.array(*[F.struct(F.lit(s).alias("score_name"), F.lit(b).alias("baseline"), *[(at(s, v) - at(b, v)).alias(f"{v}_delta") for v in values]) for s in scores for b in baselines])
    return table.groupBy(*by).agg(F.max("positive_count").alias("positive_count"), pairs.alias("_p")).select(*by, "positive_count", F.explode("_p").alias("_p")).select(*by, "positive_count", "_p.*")


def overlap_gates(clean: DataFrame, scores: Sequence[str], baselines: Sequence[str], recall: str = "recall_at_5pct_fpr_strict") -> DataFrame:
    """A gate per score and baseline on samples without overlap at the start: AUPRC and recall both have to rise.

    ``clean`` is the metric table of those samples by ``score_name``. ``value`` is the smaller of the two changes; a pair with a missing
    score, or an empty table, does not pass.
    """
    pairs = _paired(clean, [], scores, baselines, ["auprc", recall])
    a, b = F.col("auprc_delta"), F.col(f"{recall}_delta")
    return pairs.select(F.concat(F.lit("clean_start:"), "score_name", F.lit(">"), "baseline").alias("gate"), F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).alias("value"),
                        F.lit(0.0).alias("limit"), F.coalesce((a > 0) & (b > 0), F.lit(False)).alias("passed"))


def negative_strata(strata: DataFrame, score: str, baselines: Sequence[str], min_positives: int = 10, tolerance: float = 0.02) -> DataFrame:
    """Strata with enough positives where the score's AUPRC lies below a baseline's by more than the tolerance."""
    pairs = _paired(strata, ["stratum_column", "stratum"], [score], baselines, ["auprc"])
    return pairs.filter((F.col("positive_count") >= min_positives) & (F.col("auprc_delta") < -tolerance))


def stratum_gates(strata: DataFrame, score: str, baselines: Sequence[str], min_positives: int = 10, tolerance: float = 0.02) -> DataFrame:
    """A gate per baseline: no stratum may be clearly negative. ``value`` counts those that are; without any stratum nothing passes."""
    bad = negative_strata(strata, score, baselines, min_positives, tolerance)
    counts = bad.agg(*[F.sum((F.col("baseline") == b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(baselines)])
    wide = counts.crossJoin(strata.agg(F.count("*").alias("strata")))  # one row each
    n = lambda i: F.coalesce(F.col(f"b{i}"), F.lit(0))
    rows = F.array(*[F.struct(F.lit(f"no_negative_stratum:{score}>{b}").alias("gate"), n(i).cast("double").alias("value"), F.lit(0.0).alias("limit"),
                              ((n(i) == 0) & (F.col("strata") > 0)).alias("passed")) for i, b in enumerate(baselines)])
    return wide.select(F.explode(rows).alias("g")).select("g.*")


def sanity_checks(df: DataFrame, pairs: Sequence[tuple[str, str]], cols: Sequence[str]) -> DataFrame:
    """Largest difference of column pairs that must not be copies; finite share and median of columns that must vary."""
    diff = {f"max_abs_{a}_minus_{b}": F.max(F.abs(num_or(df, a) - num_or(df, b))) for a, b in pairs}
    finite = {f"{c}_finite_fraction": F.avg(num_or(df, c).isNotNull().cast("double")) for c in cols}
    names = [*diff, *finite]
    one = ordered.melt(df.agg(*[v.alias(k) for k, v in {**diff, **finite}.items()]), [], names, "check", "value")
    med = ordered.column_quantiles(df.select(*[num_or(df, c).alias(c) for c in cols]), cols, [0.5]).select(
        F.concat(F.col("column"), F.lit("_median")).alias("check"), F.col("q0").alias("value"))
    return one.unionByName(med)


def robustness(scored: DataFrame, y: str, score: str, kinds: Sequence[str] = ("kind", "level"), buckets=None) -> DataFrame:
    """Metric bundle per perturbation kind and level."""
    return metrics.binary_metrics(scored, y, score, list(kinds), (0.05,), buckets)
