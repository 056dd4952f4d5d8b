"""Matched comparisons: nearest neighbour, caliper (range) and exact-bin matching, and their evaluation.

With one covariate the nearest partner is the next smaller or the next larger one: two running passes over sorted buckets, no pairs.
With more, nearest partners are looked for in a k-d tree (``boxtree``): a positive meets only the partners in boxes that are no farther than the
best one found so far. Equal covariate vectors are matched once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions.columns import num, unit_hash
from feaslens.operators import boxtree, metrics, ordered
from feaslens.session import checkpointed


@dataclass(frozen=True)
class Setting:
    """Caliper preset: maximal absolute difference per covariate and a rule on the time to collision of both sides."""

    name: str
    family: str
    calipers: tuple[tuple[str, float], ...]
    ttc_rule: str = ""


D, T, S, A = "current_min_distance_m", "current_ttc_s", "ego_speed_kph", "agent_count"
# The eight presets.
SETTINGS = (
    Setting("distance_only_0p25m", "distance_only", ((D, 0.25),)),
    Setting("distance_only_0p5m", "distance_only", ((D, 0.5),)),
    Setting("distance_only_1p0m", "distance_only", ((D, 1.0),)),
    Setting("distance_speed_agent", "distance_speed_agent", ((D, 0.5), (S, 2.0), (A, 2.0))),
    Setting("finite_ttc_strict", "finite_ttc_strict", ((D, 0.5), (T, 1.0), (S, 2.0)), "finite"),
    Setting("finite_ttc_loose", "finite_ttc_loose", ((D, 1.0), (T, 2.0), (S, 5.0)), "finite"),
    Setting("no_ttc_pair", "no_ttc_pair", ((D, 1.0), (S, 5.0)), "none"),
    Setting("large_or_no_ttc", "large_or_no_ttc", ((D, 1.0), (S, 5.0)), "large_or_none"),
)


def ttc_allowed(rule: str, ttc: Column) -> Column:
    return {"": F.lit(True), "finite": ttc >= 0, "none": ttc < 0, "large_or_none": (ttc < 0) | (ttc > 3.0)}[rule]


def caliper_match(df: DataFrame, id_col: str, y: str, setting: Setting, ttc: str = T) -> DataFrame:
    """Each positive with its nearest negative (scaled by the calipers, so that every caliper is 1) inside all calipers; ties go to the smaller id."""
    cols = [c for c, _ in setting.calipers]
    allowed = ttc_allowed(setting.ttc_rule, num(ttc)) if setting.ttc_rule else F.lit(True)
    work = df.filter(allowed).select(
        F.col(id_col).alias("id"), num(y).cast("int").alias("y"),
        F.array(*[num(c) / max(w, 1e-9) for c, w in setting.calipers]).alias("v")).filter(
        ~F.exists("v", lambda x: x.isNull()) & F.col("y").isNotNull())
    pairs = _match(work, len(cols), 1.0)
    return pairs.select(F.lit(setting.name).alias("setting_name"), F.lit(setting.family).alias("family"), "pos_id", "neg_id",
                        "match_distance_z")


def _match(work: DataFrame, dims: int, limit: float | None) -> DataFrame:
    """Matches distinct covariate vectors and hands the partner to every positive that has the vector."""
    if dims == 1:
        return _match_line(work, limit)
    positives = work.filter("y = 1")
    partners = work.filter("y = 0").groupBy("v").agg(F.min("id").alias("nid"))
    found = boxtree.nearest(positives.select("v").distinct(), partners, dims, limit).filter("best is not null")
    joined = positives.join(found, "v")
    return joined.select(F.col("id").alias("pos_id"), F.col("best.nid").alias("neg_id"), F.sqrt("best.d2").alias("match_distance_z"))


def _match_line(work: DataFrame, limit: float | None) -> DataFrame:
    """The same for one covariate: each value's neighbours on both sides, carried over sorted buckets."""
    positives, x = work.filter("y = 1"), F.col("v")[0]
    partners = work.filter("y = 0").groupBy(x.alias("x")).agg(F.min("id").alias("nid"))
    # At equal values partners come first, on either pass.
    own = positives.select(x.alias("x")).distinct().select("x", F.lit(1).alias("kind"))
    rows = partners.select("x", F.lit(0).alias("kind"), F.struct(F.col("x").alias("w"), "nid").alias("p")).unionByName(own, allowMissingColumns=True)
    rows = ordered.carry_forward(ordered.with_bucket(rows, "x"), [], ["x", "kind"], "p", "below", "_b").drop("_b").withColumn("minus", -F.col("x"))
    rows = ordered.carry_forward(ordered.with_bucket(rows, "minus"), [], ["minus", "kind"], "p", "above", "_b").filter("kind = 1")
    gap = lambda p: p["w"] - F.col("x")
    sides = F.filter(F.array("below", "above"), lambda p: p.isNotNull() & (F.lit(True) if limit is None else F.abs(gap(p)) <= limit))
    best = F.array_min(F.transform(sides, lambda p: F.struct((gap(p) * gap(p)).alias("d2"), p["nid"].alias("nid"))))
    found = rows.select(F.array("x").alias("v"), best.alias("best")).filter("best is not null")
    joined = positives.join(found, "v")
    return joined.select(F.col("id").alias("pos_id"), F.col("best.nid").alias("neg_id"), F.sqrt("best.d2").alias("match_distance_z"))


def nn_match(df: DataFrame, id_col: str, y: str, cols: Sequence[str]) -> DataFrame:
    """Each positive with its nearest negative over z-scored covariates (population deviation, medians for nulls); none to match with is an error."""
    from feaslens.functions.frames import median_fill
    clean = median_fill(df.select(F.col(id_col).alias("id"), num(y).cast("int").alias("y"), *cols), cols)
    stats = clean.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    z = F.array(*[(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(F.lit(1.0)) for c in cols])
    work = checkpointed(clean.filter("y is not null").crossJoin(F.broadcast(stats)).select("id", "y", z.alias("v")))
    if work.filter("y = 0").isEmpty() and not work.isEmpty():
        raise ValueError("no negatives to match with")
    return _match(work, len(cols), None)


def relaxed_bin(distance, ttc, speed, agents, d_bin=3.0, t_bin=2.0, s_bin=10.0, a_bin=10.0) -> Column:
    """Bin key text ``distance|ttc|speed|agents``; no usable time to collision is the bin ``no``."""
    def part(x: Column, width: float, top: int) -> Column:
        return F.greatest(F.least(F.floor(x / width), F.lit(top)), F.lit(0)).cast("string")
    t = num(ttc)
    return F.concat_ws("|", part(num(distance, 999.0), d_bin, 50),
                       F.when(t.isNull() | (t < 0), F.lit("no")).otherwise(part(t, t_bin, 50)),
                       part(num(speed, 0.0), s_bin, 30), part(num(agents, 0.0), a_bin, 20))


def bin_match(df: DataFrame, id_col: str, y: str, bin_col: str, seed: int) -> DataFrame:
    """Positives and negatives of a bin paired without replacement in hash order.

    Positions come from bucketed ranks, so a bin holding a large share of the rows is still spread over tasks.
    """
    work = df.select(F.col(id_col).alias("id"), num(y).cast("int").alias("y"), F.col(bin_col).alias("match_bin")).filter(
        "y is not null and match_bin is not null").withColumn("_u", unit_hash(F.lit(str(seed)), "id"))
    placed = ordered.dense_index(work, ["match_bin", "y"], "_u", ["id"])
    pos = placed.filter("y = 1").select("match_bin", "ix", F.col("id").alias("pos_id"))
    neg = placed.filter("y = 0").select("match_bin", "ix", F.col("id").alias("neg_id"))
    return pos.join(neg, ["match_bin", "ix"]).select("match_bin", "pos_id", "neg_id")


def _attach(pairs: DataFrame, df: DataFrame, id_col: str, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    side = lambda tag: df.select(F.col(id_col).alias(f"{tag}_id"), *[num(c).alias(f"{tag}_{c}") for c in cols])
    return pairs.select(*by, "pos_id", "neg_id").join(side("pos"), "pos_id").join(side("neg"), "neg_id")


def evaluate_pairs(pairs: DataFrame, df: DataFrame, id_col: str, scores: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Win, tie and loss rates of the positive side, and AUROC/AUPRC over the pooled pair members."""
    by = list(by)
    wide = _attach(pairs, df, id_col, scores, by)
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(f"pos_{s}").alias("p"), F.col(f"neg_{s}").alias("n"))
                               for s in scores])).alias("_s")
    long = wide.select(*by, "pos_id", "neg_id", both).select(*by, "pos_id", "neg_id", "_s.*").filter("p is not null and n is not null")
    keys = [*by, "score_name"]
    rates = long.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.avg((F.col("p") > F.col("n")).cast("double")).alias("win_rate"),
        F.avg((F.col("p") == F.col("n")).cast("double")).alias("tie_rate"),
        F.avg((F.col("p") < F.col("n")).cast("double")).alias("loss_rate"), F.avg(F.col("p") - F.col("n")).alias("mean_difference"))
    members = long.select(*keys, F.explode(F.array(
        F.struct(F.lit(1).alias("y"), F.col("p").alias("score")), F.struct(F.lit(0).alias("y"), F.col("n").alias("score")))).alias("_m")
    ).select(*keys, "_m.*")
    table = metrics.curve(members, "y", "score", keys).groupBy(*keys).agg(
        metrics.auroc_expr().alias("pair_auroc"), metrics.auprc_expr().alias("pair_auprc"))
    uniques = long.groupBy(*keys).agg(F.countDistinct("neg_id").alias("unique_negatives"))
    return ordered.match(ordered.match(rates, table, keys), uniques, keys)


def balance(pairs: DataFrame, df: DataFrame, id_col: str, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Covariate means of both sides, mean and 95% quantile of the absolute difference."""
    by = list(by)
    wide = _attach(pairs, df, id_col, cols, by)
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"pos_{c}").alias("p"), F.col(f"neg_{c}").alias("n"))
                               for c in cols])).alias("_s")
    long = wide.select(*by, both).select(*by, "_s.*").withColumn("gap", F.abs(F.col("p") - F.col("n")))
    keys = [*by, "variable"]
    means = long.groupBy(*keys).agg(F.avg("p").alias("pos_mean"), F.avg("n").alias("neg_mean"), F.avg("gap").alias("mean_abs_diff"))
    return ordered.match(means, ordered.quantiles(long, "gap", [0.95], keys, names=["p95_abs_diff"]), keys)
