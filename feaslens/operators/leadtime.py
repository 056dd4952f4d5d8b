"""Event onsets, lead times and aligned trajectories over rolling frames; case mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.functions.columns import count_string, num
from feaslens.operators import metrics, ordered, splits
from feaslens.session import checkpointed


def event_onset(df: DataFrame, key: str, order: Sequence[str], t: str, y: str, min_pre: float) -> DataFrame:
    """First 0→1 transition per key with at least ``min_pre`` seconds before it.

    The first positive after the first negative is that transition, so two grouped minima replace a walk over the frames
    and a long key is combined map-side. A first transition that comes too early makes the key invalid.
    """
    place = F.struct(*order)
    work = df.select(F.col(key).alias("key"), place.alias("at"), num(t).alias("t"), num(y).cast("int").alias("y"))
    first = work.groupBy("key").agg(
        F.min(F.when(F.col("y") == 0, F.col("at"))).alias("zero_at"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.max("y").alias("any_y"), F.count("*").alias("n_frames"))
    onset = work.filter("y = 1").join(first.select("key", "zero_at"), "key").filter(F.col("at") > F.col("zero_at")).groupBy("key").agg(
        F.min(F.struct("at", "t")).alias("hit"))
    joined = first.join(onset, "key", "left")
    hit_t = F.col("hit.t")
    pre = hit_t - F.col("t0")
    valid = F.coalesce(pre >= min_pre, F.lit(False))
    return joined.select(
        F.col("key").alias(key), valid.alias("has_valid_onset"), F.when(valid, hit_t).alias("event_time_s"),
        F.coalesce(pre, F.col("t1") - F.col("t0")).alias("pre_event_duration_s"),
        (F.col("any_y") == 1).alias("has_any_event"), "n_frames")


def lead_time(df: DataFrame, onsets: DataFrame, thresholds: DataFrame, key: str, t: str, score: str) -> DataFrame:
    """Per key and threshold row: first alert before the onset, lead, missed event, false alert of a non-event key.

    ``thresholds`` is a table (score name, target rate, ``threshold``) with a row for each rate asked for; it meets the rows as one list.
    """
    rows = df.select(key, num(t).alias("_t"), num(score).alias("_s")).join(onsets, key)
    names = [c for c in thresholds.columns if c != "threshold"]
    listed = thresholds.agg(F.collect_list(F.struct(*names, "threshold")).alias("_list"))  # one row
    return _leads(rows.crossJoin(F.broadcast(listed)).withColumn("_x", F.explode("_list")).select(*rows.columns, "_x.*"), key, names)


def _leads(crossed: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row per key and threshold from rows (``_t``, ``_s``) that carry the onset and the threshold."""
    alert = F.col("_s") >= F.col("threshold")
    before = F.col("_t") < F.col("event_time_s")
    keys = [key, *names, "threshold", "has_valid_onset", "event_time_s", "pre_event_duration_s", "has_any_event"]
    agg = crossed.groupBy(*keys).agg(
        F.min(F.when(alert & before, F.col("_t"))).alias("first_pre_event_alert_time_s"), F.max(alert).alias("_any"))
    first = F.col("first_pre_event_alert_time_s")
    return agg.select(
        key, *names, "threshold", F.col("has_any_event").alias("has_event"), "has_valid_onset", "event_time_s", "pre_event_duration_s",
        F.when(F.col("has_valid_onset"), first).alias("first_pre_event_alert_time_s"),
        F.when(F.col("has_valid_onset"), F.col("event_time_s") - first).alias("lead_time_s"),
        (F.col("has_valid_onset") & first.isNull()).alias("missed_event"),
        (~F.col("has_any_event") & F.coalesce(F.col("_any"), F.lit(False))).alias("false_alert_non_event"))


def calibrated_lead_time(df: DataFrame, onsets: DataFrame, key: str, t: str, y: str, scores: Sequence[str], rates: Sequence[float] = (0.01, 0.05),
                         fraction: float = 0.35, seed: int = 42) -> DataFrame:
    """Lead times of the test keys at thresholds fitted on the calibration keys, per score and rate.

    Exactly ``round(keys * fraction)`` keys, in hash order, calibrate. A score without calibration negatives, or with one class there, has no threshold and no rows.
    Each row meets the rates of its own score only.
    """
    marked = splits.exact_split(df, key, fraction, seed, "_cal")
    long = marked.select(key, F.col(t).alias("_t"), F.col(y).alias("_y"), "_cal", F.explode(F.array(*[
        F.struct(F.lit(s).alias("score_name"), num(s).alias("_score")) for s in scores])).alias("_s")).select(key, "_t", "_y", "_cal", "_s.*")
    fitted = metrics.fpr_threshold(long.filter("_cal"), "_y", "_score", rates, ["score_name"])
    listed = fitted.select("score_name", F.filter(F.array(*[
        F.struct(F.lit(float(r)).alias("target_fpr"), F.col(f"threshold_at_{metrics.level_name(r)}_fpr").alias("threshold")) for r in rates]),
        lambda x: x["threshold"].isNotNull()).alias("_list"))
    rows = long.filter("not _cal").join(F.broadcast(listed), "score_name").withColumn("_x", F.explode("_list"))  # a row a score
    return _leads(rows.select(key, num("_t").alias("_t"), F.col("_score").alias("_s"), "score_name", "_x.*").join(onsets, key), key, ["score_name", "target_fpr"])


def lead_time_summary(leads: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    ok, non = F.col("has_valid_onset"), ~F.col("has_event")
    tally = lambda c: F.sum(c.cast("bigint"))
    base = leads.groupBy(*by).agg(
        tally(ok).alias("n_event_scenarios"), tally(F.col("has_event") & ~ok).alias("n_invalid_event_scenarios"),
        tally(non).alias("n_non_event_scenarios"), F.avg(F.when(ok, F.col("lead_time_s"))).alias("mean_lead_time_s"),
        F.avg(F.when(ok, F.col("missed_event").cast("double"))).alias("missed_event_rate"),
        F.avg(F.when(non, F.col("false_alert_non_event").cast("double"))).alias("false_alert_non_event_rate"))
    med = ordered.quantiles(leads.filter(ok), "lead_time_s", [0.5], by, names=["median_lead_time_s"])
    return ordered.match(base, med, by, "left")


def align_to_event(df: DataFrame, onsets: DataFrame, key: str, t: str, keep: Sequence[str], start=-5.0, stop=1.0) -> DataFrame:
    """Frames of keys with a valid onset, in seconds relative to it, inside [start, stop]."""
    joined = df.join(onsets.filter("has_valid_onset").select(key, "event_time_s"), key)
    rel = num(t) - F.col("event_time_s")
    return joined.withColumn("time_to_event_s", rel).filter(F.col("time_to_event_s").between(start, stop)).select(key, "time_to_event_s", *keep)


def add_alerts(df: DataFrame, y: str, scores: Sequence[str], levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``<score>_alert_at_<n>fpr`` from the negatives' quantile per score and level."""
    by = list(by)
    out = df
    for s in scores:
        thr = ordered.quantiles(metrics.scored(df.filter(num(y) == 0), y, s, by), "score", [1 - v for v in levels], by,
                                names=[f"_thr{i}" for i in range(len(levels))])
        out = ordered.match(out, thr, by) if by else out.crossJoin(F.broadcast(thr))  # one row
        for i, v in enumerate(levels):
            out = out.withColumn(f"{s}_alert_at_{int(round(v * 100))}fpr", num(s) >= F.col(f"_thr{i}")).drop(f"_thr{i}")
    return out


def select_cases(df: DataFrame, y: str, base: str, enhanced: str, id_col: str, k: int, original: str = "original_label_id",
                 action: str = "actionability_label_id", infeasible_task: bool = True) -> DataFrame:
    """Top ``k`` rows of nine case categories; a row can be in several. Ties go to the smaller id."""
    flagged = add_alerts(df, y, [base, enhanced], [0.05, 0.01])
    y1 = num(y) == 1
    pos = flagged.filter(y1).select(num(base).alias("b"), num(enhanced).alias("e"))
    cut = ordered.quantile_row(pos, ["b", "e"], [0.5, 0.75]).select(F.struct(F.col("b__q0").alias("b"), F.col("e__q1").alias("e")).alias("c"))
    work = flagged.withColumn("_c", cut.scalar()).withColumn("score_delta", num(enhanced) - num(base))
    b5, e5, b1, e1 = (F.col(f"{s}_alert_at_{n}fpr") for n, s in ((5, base), (5, enhanced), (1, base), (1, enhanced)))
    orig, act = num(original), num(action)
    strong = y1 & (num(base) <= F.col("_c.b")) & (num(enhanced) >= F.col("_c.e"))
    delta, enh, bas = F.col("score_delta"), num(enhanced), num(base)
    specs: list[tuple[str, Column, Column]] = [
        ("recovered_positive_at_5fpr", y1 & ~b5 & e5, delta),
        ("recovered_positive_at_1fpr", y1 & ~b1 & e1, delta),
        ("baseline_missed_enhanced_high_score", strong, delta),
        ("enhanced_false_positive_at_5fpr", ~y1 & ~b5 & e5, enh),
        ("baseline_false_positive_fixed", ~y1 & b5 & ~e5, -delta),
        ("original_safe_but_actionability_critical", orig.isin(0, 1) & (act >= 2), enh),
        ("original_warning_emergency_but_high_actionability", (orig >= 2) & (act == 0), bas),
    ]
    if infeasible_task:
        specs += [("infeasible_true_positive", y1 & e5, enh), ("infeasible_missed", y1 & ~e5, -enh)]
    tags = F.array_compact(F.array(*[
        F.when(m, F.struct(F.lit(n).alias("case_category"), key.alias("sort_value"))) for n, m, key in specs]))
    long = work.select("*", F.explode(tags).alias("_t")).select(*df.columns, "score_delta", "_t.*")
    rank = F.row_number().over(Window.partitionBy("case_category").orderBy(F.desc("sort_value"), F.col(id_col)))
    return long.withColumn("case_rank", rank).filter(F.col("case_rank") <= k)


def case_summary(cases: DataFrame, enhanced: str, by: Sequence[str] = ("case_category",), original: str = "original_label_id",
                 action: str = "actionability_label_id", medians: Sequence[str] = ()) -> DataFrame:
    # Cases are at most k per category, so they are written once and summarised with plain aggregates.
    by = list(by)
    kept = checkpointed(cases)
    meds = [F.percentile(num(c), 0.5).alias(f"{c}_median") for c in [*medians, enhanced, "score_delta"]]
    base = kept.groupBy(*by).agg(F.count("*").alias("count"), *meds)
    for col, out in ((original, "original_label_id_distribution"), (action, "actionability_label_id_distribution")):
        base = base.join(count_string(kept, by, col, out), by, "left")
    return base


def case_context(cases: DataFrame, key: str, *tables: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds context columns, each from the first table that has a value."""
    out = cases
    for i, table in enumerate(tables):
        have = [c for c in columns if c in table.columns]
        out = out.join(table.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in have]), key, "left")
    picks = []
    for c in columns:
        found = [F.col(f"_{i}_{c}") for i, table in enumerate(tables) if c in table.columns]
        own = [F.col(c)] if c in cases.columns else []
        picks.append(F.coalesce(*own, *found).alias(c))
    return out.select(*[c for c in cases.columns if c not in columns], *picks)
