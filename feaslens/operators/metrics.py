"""Ranking, threshold, calibration and agreement metrics as grouped aggregates.

Scored rows are first reduced to one row per (group, distinct score) with positive and negative counts; the tie-grouped
cumulative table is then built bucket by bucket (see ``ordered``), so no group needs to fit one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.functions.columns import clip, num
from feaslens.operators import ordered

LEVEL_SLACK = 1e-12


def level_name(level: float) -> str:
    return f"{int(round(level * 100))}pct"


def scored(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows that count: label and score present and finite. Columns ``by``, ``score``, ``y`` (0/1)."""
    out = df.select(*by, num(score).alias("score"), num(y).cast("int").alias("y"))
    return out.filter(F.col("score").isNotNull() & F.col("y").isNotNull())


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return scored(df, y, score, by).groupBy(*by, "score").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"),
    )


def curve(df: DataFrame, y: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """One row per tied score, best first: ``pos, neg`` at the score, ``cum_*`` down to it, ``tot_*`` of the group."""
    counts = ordered.with_bucket(score_counts(df, y, score, by), "score", buckets, source=scored(df, y, score))
    return ordered.running(counts, by, ["score"], ["pos", "neg"], descending=True).drop("_b")




def _both() -> Column:
    return (F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)


def auprc_expr() -> Column:
    part = F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return F.when(_both(), F.sum(part) / F.max("tot_pos"))


def auroc_expr() -> Column:
    below = F.col("tot_neg") - F.col("cum_neg") + F.col("neg") / 2.0
    return F.when(_both(), F.sum(F.col("pos") * below) / (F.max("tot_pos") * F.max("tot_neg").cast("double")))


def best_f1_expr() -> Column:
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    recall = F.col("cum_pos") / F.nullif(F.col("tot_pos"), F.lit(0))
    f1 = 2.0 * precision * recall / F.greatest(precision + recall, F.lit(LEVEL_SLACK))
    return F.when(_both(), F.max(f1))


def strict_exprs(level: float) -> list[Column]:
    """Best recall over tied thresholds whose false-positive rate stays within the level; 0 when none does."""
    within = F.col("cum_neg") / F.nullif(F.col("tot_neg"), F.lit(0)) <= level + LEVEL_SLACK
    best = F.max(F.when(within, F.struct(F.col("cum_pos").alias("tp"), (-F.col("cum_neg")).alias("nfp"),
                                         F.col("score").alias("thr"))))
    name = level_name(level)
    recall = F.coalesce(best["tp"] / F.nullif(F.max("tot_pos"), F.lit(0)), F.lit(0.0))
    fpr = F.coalesce(-best["nfp"] / F.nullif(F.max("tot_neg"), F.lit(0)), F.lit(0.0))
    return [
        F.when(_both(), recall).alias(f"recall_at_{name}_fpr_strict"),
        F.when(_both(), fpr).alias(f"actual_fpr_at_{name}_strict"),
        F.when(_both(), best["thr"]).alias(f"threshold_at_{name}_fpr_strict"),
    ]


def auprc(df, y, score, by=(), buckets=None) -> DataFrame:
    return curve(df, y, score, by, buckets).groupBy(*by).agg(auprc_expr().alias("auprc"))


def auroc(df, y, score, by=(), buckets=None) -> DataFrame:
    return curve(df, y, score, by, buckets).groupBy(*by).agg(auroc_expr().alias("auroc"))


def best_f1(df, y, score, by=(), buckets=None) -> DataFrame:
    return curve(df, y, score, by, buckets).groupBy(*by).agg(best_f1_expr().alias("best_f1"))


def recall_at_fpr_strict(df, y, score, level=0.05, by=(), buckets=None) -> DataFrame:
    return curve(df, y, score, by, buckets).groupBy(*by).agg(*strict_exprs(level))


def _negative_quantile(level: float) -> Column:
    """Linear (1 - level) quantile of the negatives, read off the cumulative table."""
    pos = F.lit(max(0.0, min(1.0, 1.0 - level))) * (F.col("tot_neg") - 1)
    first = F.col("tot_neg") - F.col("cum_neg")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("neg")), F.col("score")))

    low, high = at(F.floor(pos)), at(F.ceil(pos))
    return F.when(_both(), low + (high - low) * F.max(pos - F.floor(pos)))


def fpr_threshold(df, y, score, levels: Sequence[float] = (0.05,), by=(), buckets=None) -> DataFrame:
    """Quantile threshold per level with the recall and false-positive rate it reaches (``>=`` alerts)."""
    return _quantile_recall(curve(df, y, score, by, buckets), levels, by)


def _quantile_recall(table: DataFrame, levels: Sequence[float], by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    names = [level_name(level) for level in levels]
    thresholds = table.groupBy(*by).agg(
        *[_negative_quantile(level).alias(f"threshold_at_{n}_fpr") for level, n in zip(levels, names)]
    )
    joined = ordered.match(table, thresholds, by)
    aggs = []
    for n in names:
        above = F.col("score") >= F.col(f"threshold_at_{n}_fpr")
        reach = lambda c, t: F.coalesce(F.max(F.when(above, F.col(c))), F.lit(0)) / F.nullif(F.max(t), F.lit(0))
        aggs += [
            F.when(_both(), reach("cum_pos", "tot_pos")).alias(f"recall_at_{n}_fpr"),
            F.when(_both(), reach("cum_neg", "tot_neg")).alias(f"actual_fpr_at_{n}"),
            F.max(f"threshold_at_{n}_fpr").alias(f"threshold_at_{n}_fpr"),
        ]
    return joined.groupBy(*by).agg(*aggs, *extra)


def ece_expr(bins: int = 10) -> Column:
    """Expected calibration error over equal bins; edges are the doubles ``k * (1 / bins)``, the last bin closed."""
    p = clip(F.col("score"), 0.0, 1.0)
    edges = [k * (1.0 / bins) for k in range(bins)] + [1.0]
    gap = p * (F.col("pos") + F.col("neg")) - F.col("pos")
    parts = []
    for k in range(bins):
        inside = (p >= edges[k]) & ((p < edges[k + 1]) if k < bins - 1 else (p <= 1.0))
        parts.append(F.abs(F.sum(F.when(inside, gap).otherwise(0.0))))
    return sum(parts[1:], parts[0]) / F.sum(F.col("pos") + F.col("neg"))


def brier_expr() -> Column:
    p = clip(F.col("score"), 0.0, 1.0)
    return F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / F.sum(F.col("pos") + F.col("neg"))


def brier(df, y, score, by=()) -> DataFrame:
    return score_counts(df, y, score, by).groupBy(*by).agg(brier_expr().alias("brier"))


def ece(df, y, score, by=(), bins: int = 10) -> DataFrame:
    return score_counts(df, y, score, by).groupBy(*by).agg(ece_expr(bins).alias("ece"))


def binary_metrics(df, y, score, by=(), levels: Sequence[float] = (0.01, 0.05), buckets=None) -> DataFrame:
    """The whole bundle per group from one cumulative table. A group with one class gets nulls."""
    table = curve(df, y, score, by, buckets)
    extra = [
        F.sum(F.col("pos") + F.col("neg")).alias("n_eval"),
        F.sum("pos").alias("positive_count"),
        (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("positive_rate"),
        auroc_expr().alias("auroc"),
        auprc_expr().alias("auprc"),
        F.when(_both(), brier_expr()).alias("brier"),
        F.when(_both(), ece_expr()).alias("ece"),
        best_f1_expr().alias("best_f1"),
    ]
    for level in levels:
        extra += strict_exprs(level)
    return _quantile_recall(table, levels, by, extra)


def confusion_exprs(alert: Column, y: Column, weight: Column = None) -> list[Column]:
    w = F.lit(1) if weight is None else weight
    tally = lambda cond: F.sum(F.when(cond, w).otherwise(0))
    tp, fp = tally(alert & (y == 1)), tally(alert & (y == 0))
    fn, tn = tally(~alert & (y == 1)), tally(~alert & (y == 0))
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
        (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"),
        (tn / F.nullif(tn + fp, F.lit(0))).alias("specificity"),
        (fp / F.nullif(fp + tn, F.lit(0))).alias("fpr"),
        ((tp + fp) / F.nullif(tp + fp + fn + tn, F.lit(0))).alias("alert_rate"),
    ]


def confusion_at(df, y, score, threshold: Column | float, by=()) -> DataFrame:
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    work = df.select(*by, num(y).cast("int").alias("y"), (num(score) >= thr).alias("alert"))
    return work.filter("y is not null and alert is not null").groupBy(*by).agg(
        *confusion_exprs(F.col("alert"), F.col("y")))


def confusion_from_alerts(df, y, alert, by=()) -> DataFrame:
    work = df.select(*by, num(y).cast("int").alias("y"), F.col(alert).cast("boolean").alias("alert"))
    return work.filter("y is not null and alert is not null").groupBy(*by).agg(
        *confusion_exprs(F.col("alert"), F.col("y")))


def best_f1_grid(df, y, score, by=(), points: int = 101, buckets=None) -> DataFrame:
    """Best F1 over evenly spaced score quantiles, with its threshold (the lowest one wins a tie)."""
    by = list(by)
    qs = [i / (points - 1) for i in range(points)]
    thresholds = ordered.quantile_points(scored(df, y, score, by), "score", qs, by, buckets).select(
        *by, F.col("quantile").alias("threshold")).distinct()
    table = curve(df, y, score, by, buckets)
    # Counts at a threshold are differences of a histogram over the grid, not a rows-by-thresholds product.
    bounds = thresholds.groupBy(*by).agg(F.sort_array(F.collect_list("threshold")).alias("grid"))
    slotted = ordered.match(table, bounds, by).withColumn(
        "slot", F.size(F.filter("grid", lambda t: t <= F.col("score"))))
    hist = slotted.filter("slot > 0").groupBy(*by, "slot").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("tot_pos").alias("tot_pos"),
        F.max(F.get("grid", F.col("slot") - 1)).alias("threshold"))
    down = Window.partitionBy(*by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select(*by, "threshold", "tot_pos", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    precision = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    recall = F.col("tp") / F.nullif(F.col("tot_pos"), F.lit(0))
    f1 = 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    scored_grid = cum.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    best = F.max_by(F.struct("f1", "precision", "recall", "threshold"), F.struct(F.col("f1"), -F.col("threshold")))
    return scored_grid.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*").withColumnRenamed("f1", "best_f1")


def pr_curve(df, y, score, by=(), buckets=None) -> DataFrame:
    """Precision–recall points, one per tied score, in rank order ``pos_ix`` starting at 1."""
    table = curve(df, y, score, by, buckets)
    return table.filter((F.col("tot_pos") > 0)).select(
        *by, F.col("score").alias("threshold"),
        (F.col("cum_pos") / F.col("tot_pos")).alias("recall"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("tot_pos") / (F.col("tot_pos") + F.col("tot_neg"))).alias("prevalence"),
    )


def thin_curve(points: DataFrame, by=(), step: float = 0.01) -> DataFrame:
    """Keeps the first (highest-threshold) point in every recall cell of width ``step``, and the last point.

    Working per cell instead of walking the curve keeps it a plain aggregate.
    """
    cell = F.floor(F.col("recall") / step + 1e-9)
    packed = F.struct("recall", "precision", "threshold")
    firsts = points.groupBy(*by, cell.alias("cell")).agg(F.max_by(packed, F.col("threshold")).alias("p"))
    last = points.groupBy(*by).agg(F.min_by(packed, F.col("threshold")).alias("p")).withColumn("cell", F.lit(None).cast("bigint"))
    both = firsts.unionByName(last).select(*by, "p.*")
    return both.dropDuplicates([*by, "threshold"])


def mean_pr_curve(points: DataFrame, by: Sequence[str], grid_points: int = 101) -> DataFrame:
    """Mean precision over groups (for instance seeds) on an even recall grid, linear between neighbours.

    Points are reduced to the grid first: for each grid cell only its lowest- and highest-recall
    points can be neighbours of a grid value. The neighbours are then found with last/first over the reduced set.
    """
    by = list(by)
    n = grid_points - 1
    per_recall = points.groupBy(*by, "recall").agg(F.max("precision").alias("precision"))
    cell = F.floor(F.col("recall") * n)
    edge = F.struct("recall", "precision")
    reduced = per_recall.groupBy(*by, cell.alias("cell")).agg(
        F.min_by(edge, "recall").alias("a"), F.max_by(edge, "recall").alias("b"))
    known = reduced.select(*by, F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select(
        *by, F.col("p.recall").alias("recall"), F.col("p").alias("known"), F.lit(None).cast("int").alias("g"))
    asks = reduced.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("g")).select(
        *by, (F.col("g") / float(n)).alias("recall"), F.lit(None).cast(reduced.schema["a"].dataType).alias("known"), "g")
    merged = known.unionByName(asks)
    # At most 2 * grid_points known points and grid_points asks per group.
    order = Window.partitionBy(*by).orderBy(F.col("recall"), F.col("g").asc_nulls_first())
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    forth = order.rowsBetween(0, Window.unboundedFollowing)
    placed = merged.select(
        *by, "g", "recall", F.last("known", ignorenulls=True).over(back).alias("lo"),
        F.first("known", ignorenulls=True).over(forth).alias("hi")).filter(F.col("g").isNotNull())
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    span = hi["recall"] - lo["recall"]
    value = F.when(span <= 0, lo["precision"]).otherwise(
        lo["precision"] + (hi["precision"] - lo["precision"]) * (F.col("recall") - lo["recall"]) / F.nullif(span, F.lit(0.0)))
    return placed.withColumn("value", value).groupBy("g").agg(
        F.first("recall").alias("recall"), F.avg("value").alias("precision_mean"), F.count("value").alias("n_curves"))


def risk_coverage(df, y, score, n: int = 101, by=()) -> DataFrame:
    """Alert and safe-accept views at ``n`` even thresholds in [0, 1], from a histogram of the clipped scores."""
    by = list(by)
    step = 1.0 / (n - 1)
    p = clip(F.col("score"), 0.0, 1.0)
    # Slot = number of thresholds <= p, corrected where division and the threshold double disagree.
    guess = F.floor(p / step + 1e-9).cast("int")
    slot = F.when(guess * F.lit(step) > p, guess - 1).when((guess + 1) * F.lit(step) <= p, guess + 1).otherwise(guess)
    hist = scored(df, y, score, by).groupBy(*by, slot.alias("slot")).agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"))
    frame = hist.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    full = ordered.match(frame, hist, [*by, "slot"], "left").fillna(0, ["n", "pos"])
    up = Window.partitionBy(*by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    counted = full.select(
        *by, "slot", (F.col("slot") * F.lit(step)).alias("threshold"),
        F.sum("n").over(up).alias("alerts"), F.sum("pos").over(up).alias("alert_pos"),
        F.sum("n").over(whole).alias("total"), F.sum("pos").over(whole).alias("total_pos"))
    accepts, accept_pos = F.col("total") - F.col("alerts"), F.col("total_pos") - F.col("alert_pos")
    return counted.select(
        *by, "slot", "threshold",
        (F.col("alerts") / F.col("total")).alias("alert_coverage"),
        (F.col("alert_pos") / F.nullif(F.col("alerts"), F.lit(0))).alias("alert_precision"),
        (F.col("alert_pos") / F.nullif(F.col("total_pos"), F.lit(0))).alias("alert_recall"),
        (accepts / F.col("total")).alias("safe_coverage"),
        (accept_pos / F.nullif(accepts, F.lit(0))).alias("safe_risk"),
    )


def rank_correlation(df, x: str, y: str, by=(), buckets=None) -> DataFrame:
    """Pearson, Spearman and Kendall tau-b; null below three rows or for constant input (see ``note``).

    Ranks come from distinct values; pairs for tau are counted on the (x, y) contingency table. Pass the column with
    fewer distinct values as ``y``.
    """
    by = list(by)
    pairs = df.select(*by, num(x).alias("x"), num(y).alias("y")).filter("x is not null and y is not null")
    cells = pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    rx = ordered.average_rank(pairs, by, "x", buckets).select(*by, "x", F.col("rank").alias("rx"), F.col("n").alias("nx"))
    ry = ordered.average_rank(pairs, by, "y", buckets).select(*by, "y", F.col("rank").alias("ry"), F.col("n").alias("ny"))
    ranked = ordered.match(ordered.match(cells, rx, [*by, "x"]), ry, [*by, "y"])
    moments = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *weighted_moments("rx", "ry", "n", "s"),
    )
    # The built-in keeps centred moments, which hold their digits where the mean is far from 0.
    plain = pairs.groupBy(*by).agg(F.corr("x", "y").alias("pearson"))
    tau = kendall_counts(cells, by, buckets)
    ties = lambda table, c: table.groupBy(*by).agg(F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2.0).alias(f"t_{c}"))
    on = lambda a, b: ordered.match(a, b, by)
    out = on(on(on(on(moments, plain), tau), ties(rx, "nx")), ties(ry, "ny"))
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2.0
    dx, dy = n0 - F.col("t_nx"), n0 - F.col("t_ny")
    enough = F.col("n") >= 3
    constant = (dx <= 0) | (dy <= 0)
    ok = enough & ~constant
    return out.select(
        *by, "n",
        F.when(ok, F.col("pearson")).alias("pearson"),
        F.when(ok, weighted_corr("s")).alias("spearman"),
        F.when(ok, F.col("s_net") / F.sqrt(dx * dy)).alias("kendall_tau_b"),
        F.when(~enough, F.lit("fewer than 3 rows")).when(constant, F.lit("constant input")).otherwise(F.lit("")).alias("note"),
    )


def weighted_moments(a: str, b: str, w: str, tag: str) -> list[Column]:
    a_, b_, w_ = F.col(a).cast("double"), F.col(b).cast("double"), F.col(w)
    return [F.sum(w_).alias(f"{tag}w"), F.sum(w_ * a_).alias(f"{tag}a"), F.sum(w_ * b_).alias(f"{tag}b"),
            F.sum(w_ * a_ * a_).alias(f"{tag}aa"), F.sum(w_ * b_ * b_).alias(f"{tag}bb"),
            F.sum(w_ * a_ * b_).alias(f"{tag}ab")]


def weighted_corr(tag: str) -> Column:
    w, a, b, aa, bb, ab = (F.col(f"{tag}{s}") for s in ("w", "a", "b", "aa", "bb", "ab"))
    return (ab / w - a / w * b / w) / F.nullif(
        F.sqrt((aa / w - (a / w) * (a / w)) * (bb / w - (b / w) * (b / w))), F.lit(0.0))


def kendall_counts(cells: DataFrame, by: Sequence[str], buckets=None) -> DataFrame:
    """Concordant minus discordant pairs ``s_net`` from the contingency table, in rows times log2(distinct y).

    Two y positions differ first at one binary digit. For every digit, cells that share the digits above it are put
    in x order, and running sums of the cells with digit 0 and digit 1 give the pairs that meet at this digit.
    """
    by = list(by)
    marked = cells.select(*by, "y").distinct().withColumn("one", F.lit(1).cast("bigint"))
    place = ordered.running(ordered.with_bucket(marked, "y", buckets), by, ["y"], ["one"]).select(
        *by, "y", (F.col("cum_one") - 1).alias("at"), F.greatest(F.ceil(F.log2(F.col("tot_one"))), F.lit(1)).cast("int").alias("digits"))
    digit = F.explode(F.sequence(F.lit(0), F.col("digits") - 1)).alias("digit")
    spread = ordered.match(cells, place, [*by, "y"]).select(*by, "x", "n", "at", digit)
    shifted = F.call_function("shiftright", F.col("at"), F.col("digit"))
    parts = spread.select(*by, "x", "digit", F.floor(shifted / 2).alias("head"),
                          F.when(shifted % 2 == 0, F.col("n")).otherwise(0).alias("n0"),
                          F.when(shifted % 2 == 1, F.col("n")).otherwise(0).alias("n1"))
    counts = parts.groupBy(*by, "digit", "head", "x").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    run = ordered.running(ordered.with_bucket(counts, "x", buckets, source=cells), [*by, "digit", "head"], ["x"], ["n0", "n1"])
    # Products of counts outgrow 64 bits; whole numbers stay exact in 38 digits.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    net = wide("n1") * (wide("cum_n0") - wide("n0")) - wide("n0") * (wide("cum_n1") - wide("n1"))
    return run.groupBy(*by).agg(F.sum(net).cast("double").alias("s_net"))


def multiclass_metrics(df, y: str, pred: str, by=(), levels: Sequence[int] = (0, 1, 2, 3), score: str | None = None,
                       buckets=None) -> DataFrame:
    """Accuracy, macro and weighted F1, ordinal error, and recall/precision of the top level."""
    by = list(by)
    cells = df.select(*by, num(y).cast("int").alias("y"), num(pred).cast("int").alias("p")).filter(
        "y is not null and p is not null").groupBy(*by, "y", "p").agg(F.count("*").alias("n"))
    total = F.sum("n")
    aggs = [total.alias("n"),
            (F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / total).alias("accuracy"),
            (F.sum(F.abs(F.col("y") - F.col("p")) * F.col("n")) / total).alias("ordinal_mae")]
    f1s, supports = [], []
    for k in levels:
        tp = F.sum(F.when((F.col("y") == k) & (F.col("p") == k), F.col("n")).otherwise(0))
        fp = F.sum(F.when((F.col("y") != k) & (F.col("p") == k), F.col("n")).otherwise(0))
        fn = F.sum(F.when((F.col("y") == k) & (F.col("p") != k), F.col("n")).otherwise(0))
        f1s.append(F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)))
        supports.append((tp + fn, tp + fp + fn, tp, fp, fn))
    seen = sum((F.when(s[1] > 0, 1).otherwise(0) for s in supports[1:]), F.when(supports[0][1] > 0, 1).otherwise(0))
    aggs.append((sum(f1s[1:], f1s[0]) / F.nullif(seen, F.lit(0))).alias("macro_f1"))
    weighted = sum((f * s[0] for f, s in zip(f1s[1:], supports[1:])), f1s[0] * supports[0][0])
    aggs.append((weighted / total).alias("weighted_f1"))
    _, _, tp, fp, fn = supports[-1]
    aggs += [(tp / F.nullif(tp + fn, F.lit(0))).alias("emergency_recall"),
             (tp / F.nullif(tp + fp, F.lit(0))).alias("emergency_precision")]
    out = cells.groupBy(*by).agg(*aggs)
    if score is not None:
        top = df.withColumn("_top", (num(y) == levels[-1]).cast("int"))
        auc = auroc(top, "_top", score, by, buckets).withColumnRenamed("auroc", "emergency_auc")
        out = ordered.match(out, auc, by, "left")
    return out


def agreement_exprs(a: str, b: str, n: str, levels: Sequence[int] = (0, 1, 2, 3), severe: int = 2) -> list[Column]:
    """Aggregates over a contingency table: quadratic kappa, severe-set Jaccard, changes."""
    a_, b_, n_ = F.col(a), F.col(b), F.col(n)
    total = F.sum(n_)
    tally = lambda cond: F.sum(F.when(cond, n_).otherwise(0))
    # sum over cells of (i-j)^2 expected = via first and second moments of the margins
    ea, eb = F.sum(a_ * n_) / total, F.sum(b_ * n_) / total
    eaa, ebb = F.sum(a_ * a_ * n_) / total, F.sum(b_ * b_ * n_) / total
    observed = F.sum((a_ - b_) * (a_ - b_) * n_) / total
    expected = eaa - 2 * ea * eb + ebb
    sa, sb = a_ >= severe, b_ >= severe
    return [
        total.alias("n"),
        F.when(expected > 0, 1 - observed / F.nullif(expected, F.lit(0.0))).alias("quadratic_kappa"),
        F.coalesce(tally(sa & sb) / F.nullif(tally(sa | sb), F.lit(0)), F.lit(1.0)).alias("severe_jaccard"),
        (tally(a_ != b_) / total).alias("changed_fraction"),
        tally(~sa & sb).alias("severe_added"),
        tally(sa & ~sb).alias("severe_removed"),
        (tally(a_ == b_) / total).alias("exact_agreement"),
    ]


def contingency(df, a: str, b: str, by=()) -> DataFrame:
    return df.select(*by, num(a).cast("int").alias("a"), num(b).cast("int").alias("b")).filter(
        "a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def label_agreement(df, a: str, b: str, by=()) -> DataFrame:
    return contingency(df, a, b, by).groupBy(*by).agg(*agreement_exprs("a", "b", "n"))


def transition_matrix(df, a: str, b: str, levels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Every (from, to) cell with count and row fraction, zero cells included."""
    lv = F.array(*[F.lit(int(v)) for v in levels])
    cells = df.sparkSession.range(1).select(F.explode(lv).alias("a")).select("a", F.explode(lv).alias("b"))
    full = cells.join(contingency(df, a, b), ["a", "b"], "left").fillna(0, ["n"])
    row = F.sum("n").over(Window.partitionBy("a"))
    return full.select(F.col("a").alias("from_label"), F.col("b").alias("to_label"), "n",
                       (F.col("n") / F.nullif(row, F.lit(0))).alias("row_fraction"))


def label_distribution(df, col: str, levels: Sequence[int] = (0, 1, 2, 3), by=()) -> DataFrame:
    by = list(by)
    counts = df.groupBy(*by, num(col).cast("int").alias("label")).agg(F.count("*").alias("n"))
    lv = F.array(*[F.lit(int(v)) for v in levels])
    frame = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = frame.select(*by, F.explode(lv).alias("label"))
    full = ordered.match(grid, counts, [*by, "label"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*by))
    return full.select(*by, "label", "n", (F.col("n") / F.nullif(total, F.lit(0))).alias("fraction"))


def describe(df, cols: Sequence[str], by=(), sample_std: bool = False, buckets=None) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum; rows keyed by ``by`` and ``column``."""
    by = list(by)
    clean = df.select(*by, *[num(c).alias(c) for c in cols])
    long = ordered.melt(clean, by, cols, "column", "value").filter("value is not null")
    std = F.stddev_samp("value") if sample_std else F.stddev_pop("value")
    basic = long.groupBy(*by, "column").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), std.alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = ordered.quantiles(long, "value", [0.25, 0.5, 0.75], [*by, "column"], buckets, ["p25", "p50", "p75"])
    return ordered.match(basic, quart, [*by, "column"])


def label_summary(df, label: str, binary: Sequence[str], numeric: Sequence[str], other_label: str, buckets=None) -> DataFrame:
    """One long report: label counts, binary rates, per-class means and medians, cross table."""
    lab = num(label).cast("int").cast("string")
    none = F.lit(None).cast("double")
    dist = df.groupBy(lab.alias("key")).agg(F.count("*").cast("double").alias("value")).select(
        F.lit("label_count").alias("section"), "key", F.lit("").alias("metric"), "value")
    rates = df.agg(*[F.avg(num(c)).alias(c) for c in binary])
    rates = ordered.melt(rates, [], binary, "metric", "value").select(
        F.lit("binary_rate").alias("section"), F.lit("").alias("key"), "metric", "value")
    long = ordered.melt(df.select(lab.alias("key"), *[num(c).alias(c) for c in numeric]), ["key"], numeric, "metric", "value"
                        ).filter("value is not null and key is not null")
    means = long.groupBy("key", "metric").agg(F.avg("value").alias("value")).select(
        F.lit("class_mean").alias("section"), "key", "metric", "value")
    medians = ordered.quantiles(long, "value", [0.5], ["key", "metric"], buckets, ["value"]).select(
        F.lit("class_median").alias("section"), "key", "metric", "value")
    cross = df.groupBy(lab.alias("key"), F.col(other_label).cast("string").alias("metric")).agg(
        F.count("*").cast("double").alias("value")).select(F.lit("crosstab").alias("section"), "key", "metric", "value")
    out = dist
    for part in (rates, means, medians, cross):
        out = out.unionByName(part)
    return out


def stratum_long(df, y: str, strata: Sequence[str], scores: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows keyed by (stratum_column, stratum, score name). Reduced to distinct (stratum, score) counts by the caller."""
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("stratum_column"), F.col(c).cast("string").alias("stratum"))
                            for c in strata])).alias("_s")
    c = F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), num(n).alias("score")) for n in scores])).alias("_c")
    staged = df.select(*keep, num(y).alias("y"), s, *[F.col(n) for n in scores]).select(*keep, "y", "_s", c)
    return staged.select(*keep, "y", "_s.*", "_c.*")


def stratum_metrics(df, y: str, strata: Sequence[str], scores: Sequence[str], levels=(0.01, 0.05), buckets=None) -> DataFrame:
    long = stratum_long(df, y, strata, scores)
    return binary_metrics(long, "y", "score", ["stratum_column", "stratum", "score_name"], levels, buckets)


def unknown_sensitivity(df, taxonomy: str, scores: Sequence[str], levels=(0.05,), buckets=None) -> DataFrame:
    """Metrics of known failures with unknown outcomes left out, counted as positive, and counted as negative."""
    known, unknown = F.col(taxonomy) == "known_failure", F.col(taxonomy) == "unknown_failure"
    modes = F.explode(F.array(
        F.struct(F.lit("unknown_excluded").alias("sensitivity_mode"), F.when(~unknown, known.cast("int")).alias("y")),
        F.struct(F.lit("unknown_as_positive").alias("sensitivity_mode"), (known | unknown).cast("int").alias("y")),
        F.struct(F.lit("unknown_as_negative").alias("sensitivity_mode"), known.cast("int").alias("y")),
    )).alias("_m")
    long = df.select(modes, *scores).select("_m.*", *scores)
    melted = long.select("sensitivity_mode", "y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("score_name"), num(n).alias("score")) for n in scores])).alias("_c")).select(
        "sensitivity_mode", "y", "_c.*")
    return binary_metrics(melted, "y", "score", ["sensitivity_mode", "score_name"], levels, buckets)


def overlap_sensitivity(df, y: str, scores: Sequence[str], overlap: str = "initial_overlap_count",
                        strata: Sequence[str] = (), levels=(0.05,), buckets=None) -> DataFrame:
    """Metrics with all rows and without rows that overlap at the start, plus the change between the two."""
    clean = F.coalesce(num(overlap), F.lit(0.0)) <= 0
    marked = df.withColumns({"_all": F.lit("all"), "_clean": clean})
    long = marked.withColumn("sensitivity_mode", F.lit("all_primary")).unionByName(
        marked.filter("_clean").withColumn("sensitivity_mode", F.lit("exclude_initial_overlap_count_gt0")))
    rows = stratum_long(long, y, ["_all", *strata], scores, ["sensitivity_mode"]).withColumn(
        "stratum_column", F.when(F.col("stratum_column") == "_all", "overall").otherwise(F.col("stratum_column")))
    keys = ["stratum_column", "stratum", "score_name"]
    table = binary_metrics(rows, "y", "score", ["sensitivity_mode", *keys], levels, buckets)
    name = f"recall_at_{level_name(levels[0])}_fpr_strict"
    pick = lambda m, c: F.max(F.when(F.col("sensitivity_mode") == m, F.col(c)))
    a, b = "all_primary", "exclude_initial_overlap_count_gt0"
    return table.groupBy(*keys).agg(
        pick(a, "n_eval").alias("n_all"), pick(b, "n_eval").alias("n_clean"),
        (pick(a, "n_eval") - F.coalesce(pick(b, "n_eval"), F.lit(0))).alias("excluded_initial_overlap_samples"),
        pick(a, "auprc").alias("auprc_all"), pick(b, "auprc").alias("auprc_clean"),
        (pick(b, "auprc") - pick(a, "auprc")).alias("auprc_change"),
        (pick(b, name) - pick(a, name)).alias("recall_change"))


def fpr_warnings(table: DataFrame, keys: Sequence[str], levels: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """Quantile thresholds whose achieved false-positive rate exceeds the target (ties at the threshold)."""
    rows = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("target_fpr"),
                                        F.col(f"actual_fpr_at_{level_name(v)}").alias("actual_fpr"),
                                        F.col(f"recall_at_{level_name(v)}_fpr").alias("legacy_recall"),
                                        F.col(f"recall_at_{level_name(v)}_fpr_strict").alias("strict_recall"))
                               for v in levels])).alias("_w")
    return table.select(*keys, rows).select(*keys, "_w.*").filter(F.col("actual_fpr") > F.col("target_fpr") + LEVEL_SLACK)


METRICS: Mapping[str, object] = {"auprc": auprc_expr, "auroc": auroc_expr, "best_f1": best_f1_expr}
