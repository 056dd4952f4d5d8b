"""Deterministic hash splits, cohorts and samples that never look at outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.functions.columns import bucket, num, num_or, unit_hash
from feaslens.operators import ordered

# Columns that reveal outcomes and must not reach cohort selection.
OUTCOME_COLUMNS = (
    "planner_success", "planner_failure", "failure_taxonomy", "failure_subtype", "known_failure", "unknown_failure",
    "planner_failure_reason", "feasible_candidate_count", "feasible_candidate_ratio", "actionability_label_id",
)


def group_folds(df: DataFrame, key: str, k: int, seed: int, fmt: str = "pipe", out: str = "fold") -> DataFrame:
    """Fold of the key's hash. ``fmt`` picks the hashed text: ``seed|key`` or ``outer:seed:key``."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    u = unit_hash(F.lit(str(seed)), text) if fmt == "pipe" else unit_hash(F.lit("outer"), F.lit(str(seed)), text, sep=":")
    return df.withColumn(out, F.least(F.floor(u * k), F.lit(k - 1)).cast("int"))


def hash_split(df: DataFrame, key: str, fraction: float, seed: int, out: str = "is_test") -> DataFrame:
    """Keys whose hash is below the fraction are held out; both sides are kept non-empty when there are two keys."""
    text = F.col(key).cast("string")
    u = unit_hash(F.lit(str(seed)), text, sep=":")
    marked = df.withColumn("_k", F.struct(u.alias("u"), text.alias("k")))
    edge = marked.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).select(F.struct("lo", "hi").alias("e"))
    placed = marked.withColumn("_e", edge.scalar())
    lo, hi = F.col("_e")["lo"], F.col("_e")["hi"]
    picked = (F.col("_k")["u"] < fraction) | (F.col("_k") == lo)
    all_picked = hi["u"] < fraction
    test = (lo != hi) & picked & ~(all_picked & (F.col("_k") == hi))
    return placed.withColumn(out, test).drop("_k", "_e")


def exact_split(df: DataFrame, key: str, fraction: float, seed: int, out: str = "is_test") -> DataFrame:
    """Exactly round(keys * fraction) keys in hash order are held out (at least one of two or more).

    The cut is one (hash, key) value, so rows are marked without a join.
    """
    text = F.col(key).cast("string")
    marked = df.withColumn("_k", F.struct(unit_hash(F.lit(str(seed)), text).alias("u"), text.alias("k")))
    keys = marked.select(F.col("_k.u").alias("u"), F.col("_k.k").alias("k")).distinct()
    placed = ordered.dense_index(keys, [], "u", ["k"])
    n = F.col("tot_one")
    want = F.when(n > 1, F.greatest(F.lit(1).cast("bigint"), F.bround(n * fraction).cast("bigint"))).otherwise(F.lit(0))
    cut = placed.filter(F.col("ix") == want - 1).agg(F.max(F.struct("u", "k")).alias("cut"))
    return marked.withColumn("_cut", cut.scalar()).withColumn(
        out, F.coalesce(F.col("_k") <= F.col("_cut"), F.lit(False))).drop("_k", "_cut")


def calibration_split(df: DataFrame, key: str, seed: int, fold: Column | int, fraction: float, by: Sequence[str] = (),
                      out: str = "is_calibration") -> DataFrame:
    """Calibration keys inside a training set; the smallest hash is taken where none falls below the fraction."""
    text = F.col(key).cast("string")
    fold_text = F.lit(str(fold)) if isinstance(fold, int) else fold.cast("string")
    u = unit_hash(F.lit("cal"), F.lit(str(seed)), fold_text, text, sep=":")
    marked = df.withColumn("_k", F.struct(u.alias("u"), text.alias("k")))
    floor = marked.groupBy(*by).agg(F.min("_k").alias("_lo"))
    joined = ordered.match(marked, floor, by) if by else marked.withColumn("_lo", floor.scalar())
    return joined.withColumn(out, (F.col("_k.u") < fraction) | (F.col("_k") == F.col("_lo"))).drop("_k", "_lo")


def neutral_strata(df: DataFrame) -> DataFrame:
    """Scenario strata from size columns only."""
    text = lambda c: F.coalesce(F.col(c), F.lit("unknown")) if c in df.columns else F.lit("unknown")
    out = df.withColumns({"source_hint": text("source_hint"), "scenario_family": text("scenario_family")})
    out = out.withColumns({
        "lanelet_stratum": bucket(num_or(df, "lanelet_count"), [20, 60], ["lt20_lanelets", "20to60_lanelets", "gte60_lanelets"], "missing_lanelets"),
        "density_stratum": bucket(num_or(df, "dynamic_obstacle_count"), [5, 15], ["lt5_dyn", "5to15_dyn", "gte15_dyn"], "missing_density"),
        "horizon_stratum": bucket(num_or(df, "max_time_step"), [30, 90], ["lt30_steps", "30to90_steps", "gte90_steps"], "missing_horizon"),
    })
    parts = ["source_hint", "scenario_family", "lanelet_stratum", "density_stratum", "horizon_stratum"]
    return out.withColumn("neutral_scenario_stratum", F.concat_ws("|", *parts))


def sample_strata(df: DataFrame) -> DataFrame:
    """Sample strata from current distance, time to collision and speed."""
    return df.withColumns({
        "distance_stratum": bucket(num_or(df, "current_min_distance_m"), [2, 5, 10], ["lt2m", "2to5m", "5to10m", "gte10m"], "missing_distance"),
        "ttc_stratum": bucket(num_or(df, "current_ttc_s"), [0, 3, 10], ["no_ttc", "lt3s", "3to10s", "gte10s"], "missing_ttc"),
        "speed_stratum": bucket(num_or(df, "ego_speed_mps"), [5, 15], ["lt5mps", "5to15mps", "gte15mps"], "missing_speed"),
    })


def refuse_outcomes(df: DataFrame, forbidden: Sequence[str] = OUTCOME_COLUMNS) -> None:
    found = [c for c in df.columns if c in forbidden]
    if found:
        raise ValueError(f"cohort selection must not see outcome columns: {found}")


def neutral_cohort(df: DataFrame, id_col: str, stratum: str, n_max: int, seed: int, scenario: str | None = None,
                   cap: int | None = None) -> DataFrame:
    """Round-robin over strata in hash order, rows of a stratum in hash order, at most ``cap`` per scenario.

    Position r of a stratum is taken in round r, so sorting by (round, stratum hash) is the round-robin order.
    Ranks are cut at ``n_max`` (and ``cap``), which Spark applies before the shuffle.
    """
    refuse_outcomes(df)
    work = df.withColumn("_u", unit_hash(F.lit(str(seed)), id_col))
    if cap is not None:
        per = Window.partitionBy(scenario).orderBy("_u", F.col(id_col))
        work = work.withColumn("_c", F.row_number().over(per)).filter(F.col("_c") <= cap).drop("_c")
    inside = Window.partitionBy(stratum).orderBy("_u", F.col(id_col))
    ranked = work.withColumn("_round", F.row_number().over(inside)).filter(F.col("_round") <= n_max)
    ordered_rows = ranked.withColumn("_h", unit_hash(F.lit(str(seed)), F.lit("bucket"), stratum))
    picked = ordered_rows.orderBy("_round", "_h", stratum).limit(n_max)
    place = F.row_number().over(Window.orderBy("_round", "_h", stratum))  # at most n_max rows
    return picked.withColumn("selected_order", place).drop("_u", "_h", "_round")


def cohort_diagnostics(cohort: DataFrame, scenario: str, stratum: str, n_min: int, n_max: int, min_groups: int) -> DataFrame:
    per = cohort.groupBy(scenario, stratum).agg(F.count("*").alias("n"))
    by_scenario = per.groupBy(scenario).agg(F.sum("n").alias("n"))
    top = by_scenario.agg(F.sum("n").alias("selected_samples"), F.count("*").alias("unique_scenarios"),
                          F.max("n").alias("max_samples_per_scenario"))
    strata = per.agg(F.countDistinct(stratum).alias("strata"))
    return top.crossJoin(strata).select(
        "*", ((F.col("selected_samples") >= n_min) & (F.col("selected_samples") <= n_max)).alias("size_ok"),
        (F.col("unique_scenarios") >= min_groups).alias("scenarios_ok"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """First ``n`` rows in hash order."""
    return df.withColumn("_u", unit_hash(F.lit(str(seed)), key)).orderBy("_u", key).limit(n).drop("_u")


def quota_sample(df: DataFrame, keys: Sequence[str], bucket_col: str, n: int, seed: int,
                 quotas: Mapping[str, float | int] | None = None, caps: Mapping[str, int] | None = None) -> DataFrame:
    """Quota per bucket first, then fill in hash order up to ``n``; buckets in ``caps`` never exceed their cap."""
    quotas = dict(quotas if quotas is not None else {
        "medium_interaction": int(round(n * 0.35)), "far_but_interactive": int(round(n * 0.20)), "close_interaction": int(n * 0.25)})
    caps = dict(caps if caps is not None else {"close_interaction": int(n * 0.25)})
    text = [F.col(k).cast("string") for k in keys]
    work = df.withColumn("_u", unit_hash(F.lit(str(seed)), *text)).withColumn("_f", unit_hash(F.lit(f"{seed}|fill"), *text))
    once = Window.partitionBy(*keys).orderBy("_u")
    work = work.withColumn("_d", F.row_number().over(once)).filter("_d = 1").drop("_d")
    inside = Window.partitionBy(bucket_col).orderBy("_u", *keys)
    # A bucket gives at most n rows: by quota order, or by fill order among its first rows.
    ranked = work.withColumn("_r", F.row_number().over(inside))
    quota = F.lit(0)
    for name, limit in quotas.items():
        quota = F.when(F.col(bucket_col) == name, F.lit(int(limit))).otherwise(quota)
    cap = F.lit(None).cast("int")
    for name, limit in caps.items():
        cap = F.when(F.col(bucket_col) == name, F.lit(int(limit))).otherwise(cap)
    first = ranked.filter(F.col("_r") <= max(quotas.values(), default=0)).filter(F.col("_r") <= quota)
    first = first.withColumn("_phase", F.lit(0))
    chosen = first.select(*keys)
    # A capped bucket may still give what its cap leaves above its quota, in fill order.
    fill = F.row_number().over(Window.partitionBy(bucket_col).orderBy("_f", *keys))
    rest = ordered.match(work, chosen, keys, "left_anti").withColumn("_k", fill).filter(F.col("_k") <= n).filter(
        cap.isNull() | (F.col("_k") <= cap - F.least(quota, cap))).drop("_k").withColumn("_phase", F.lit(1)).orderBy("_f", *keys).limit(n)
    both = first.drop("_r").unionByName(rest)
    return both.orderBy("_phase", F.when(F.col("_phase") == 1, F.col("_f")).otherwise(F.col("_u")), *keys).limit(n).drop("_u", "_f", "_phase")


def severity_sample(df: DataFrame, key: str, label: str, n: int, seed: int, severe: int = 200, reduced: int = 300) -> DataFrame:
    """Up to ``severe`` rows of level 2+, up to ``reduced`` of level 1, then level 0, then unlabelled rows."""
    work = df.withColumn("_u", unit_hash(F.lit(str(seed)), key))
    lab = num(label).cast("int")
    group = F.when(lab >= 2, 0).when(lab == 1, 1).when(lab == 0, 2).otherwise(3)
    work = work.withColumn("_g", group)
    inside = Window.partitionBy("_g").orderBy("_u", key)
    limits = {0: severe, 1: reduced, 2: n, 3: n}
    ranked = work.withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") <= n)
    phase = F.col("_g")
    for g, limit in limits.items():
        phase = F.when((F.col("_g") == g) & (F.col("_r") > limit), F.lit(3)).otherwise(phase)
    return ranked.withColumn("_p", phase).orderBy("_p", "_u", key).limit(n).drop("_u", "_g", "_r", "_p")


def hard_case_flag(df: DataFrame) -> DataFrame:
    """Adds ``is_hard``: close but safe, or risky without a usable time to collision, at low speed, or in dense traffic."""
    lab = F.coalesce(num_or(df, "label_id").cast("int"), F.lit(0))
    dist, ttc, speed, agents = (num_or(df, c) for c in ("current_min_distance_m", "current_ttc_s", "ego_speed_kph", "agent_count"))
    p75 = ordered.quantile_row(df.select(agents.alias("a")), ["a"], [0.75]).select("a__q0")
    work = df.withColumn("_p75", p75.scalar())
    no_ttc = ttc.isNull() | (ttc < 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    hard = (yes((dist < 5.0) & (lab <= 1)) | ((no_ttc | yes(ttc > 3.0)) & (lab >= 2))
            | yes((speed < 15.0) & (lab >= 2)) | yes((agents >= F.col("_p75")) & (lab >= 2)))
    return work.withColumn("is_hard", hard).drop("_p75")


def hard_cases(df: DataFrame) -> DataFrame:
    return hard_case_flag(df).filter("is_hard").drop("is_hard")


def stratified_sets(df: DataFrame, key: str, scenario: str, caps: Mapping[int, int], fraction: float, seed: int) -> DataFrame:
    """Membership rows (set name + row): capped training set with hard cases, natural test, hard cases, enriched set.

    ``key`` is unique. Only the capped picks, bounded by the caps, are joined back; everything else is a flag of the row.
    """
    split = exact_split(hard_case_flag(df), scenario, fraction, seed)
    lab = F.coalesce(num("label_id").cast("int"), F.lit(0))
    work = split.withColumn("_lab", lab).withColumn("_u", unit_hash(F.lit(str(seed)), key))
    train = work.filter("not is_test")
    capped = {k: v for k, v in caps.items() if v and v > 0}
    inside = Window.partitionBy("_lab").orderBy("_u", key)
    cap = F.lit(0)
    for k, v in capped.items():
        cap = F.when(F.col("_lab") == k, F.lit(v)).otherwise(cap)
    limited = train.filter(F.col("_lab").isin(*capped))
    kept = limited.withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") <= max(capped.values())).filter(F.col("_r") <= cap)
    rows = work.join(kept.select(key, F.lit(True).alias("_kept")), key, "left")
    in_train = ~F.col("is_test") & (F.col("is_hard") | ~F.col("_lab").isin(*capped) | F.coalesce("_kept", F.lit(False)))
    sets = {"stratified_train": in_train, "natural_test": F.col("is_test"), "hard_cases": F.col("is_hard"), "emergency_enriched": (F.col("_lab") >= 2) | F.col("is_hard")}
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in sets.items()]))
    return rows.select(F.explode(names).alias("split"), *df.columns)


def set_summary(members: DataFrame, scenario: str) -> DataFrame:
    lab = F.coalesce(num("label_id").cast("int"), F.lit(0))
    per = members.groupBy("split", scenario).agg(F.count("*").alias("n"), *[F.sum((lab == k).cast("bigint")).alias(f"c{k}") for k in range(4)])
    return per.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("n_scenarios"),
                                    *[F.sum(f"c{k}").alias(f"label_{k}_n") for k in range(4)])


def subset_membership(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (row, diagnostic subset it belongs to)."""
    dist, ttc, speed, agents = (num_or(df, c) for c in ("current_min_distance_m", "current_ttc_s", "ego_speed_kph", "agent_count"))
    lab = F.coalesce(num_or(df, "label_id").cast("int"), F.lit(0))
    act = F.coalesce(num_or(df, "actionability_label_id").cast("int"), F.lit(0))
    p75 = ordered.quantile_row(df.select(agents.alias("a")), ["a"], [0.75]).select("a__q0")
    work = df.withColumn("_p75", p75.scalar())
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_ttc = ttc.isNull() | (ttc < 0)
    large = no_ttc | yes(ttc > 3.0)
    masks = {
        "all": F.lit(True), "no_ttc": no_ttc, "large_or_no_ttc": large, "low_speed_lt15kph": yes(speed < 15.0),
        "dense_agents_p75": yes(agents >= F.col("_p75")), "close_distance_lt5m": yes(dist < 5.0),
        "hard_safe_close": yes(dist < 5.0) & (lab <= 1), "future_risk_no_ttc": no_ttc & (lab >= 2),
        "future_risk_large_ttc": large & (lab >= 2), "original_safe": lab == 0, "original_warning": lab == 2,
        "original_emergency": lab == 3,
    }
    if "actionability_label_id" in df.columns:
        masks |= {"high_actionability": act == 0, "reduced_actionability": act == 1, "critical_actionability": act == 2,
                  "infeasible_or_unavoidable": act == 3}
    names = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))
    return work.select(*keep, F.explode(names).alias("subset"))


def coverage_filter(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key is present in every other table."""
    for other in others:
        df = df.join(other.select(key), key, "left_semi")
    return df


def coverage_counts(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Row and key counts before and after the coverage filter."""
    fact = lambda d, stage: d.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys")).select(
        F.lit(stage).alias("stage"), "n_rows", "n_keys")
    return fact(df, "before").unionByName(fact(coverage_filter(df, key, *others), "after"))
