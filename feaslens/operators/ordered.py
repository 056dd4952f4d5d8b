"""Ordered work without a single-task sort: running totals, exact quantiles and ranks.

A Spark window without a partition column moves every row into one task, and a window over a hot key moves that
key's rows into one task. Here the order column is cut into buckets, each bucket is sorted by itself, and
the totals of the buckets before it are added. The bucket bounds are values picked by hash from
the data (one per hash slot), so the cut is balanced over distinct values and is the same when a task is retried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the named columns, null meeting null; without keys the right side has to be one row. The keys come from the left side."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def default_buckets(spark: SparkSession) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def splitters(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """One row with at most ``buckets`` sorted values of the column.

    Repeated values fall into one slot with one hash, so raw rows give the same bounds as distinct values, and the whole pass is a
    map-side aggregate of ``buckets`` rows.
    """
    slot = F.pmod(F.xxhash64(value), F.lit(buckets))
    pick = F.min_by(F.col(value), F.xxhash64(F.col(value), F.lit(7)))
    picked = df.filter(F.col(value).isNotNull()).groupBy(slot.alias("_slot")).agg(pick.alias("_v"))
    return picked.agg(F.sort_array(F.collect_list("_v")).alias("_splits"))


def bucket_of(value: Column, bounds: Column, buckets: int) -> Column:
    """How many bounds are <= the value, found in two short scans of the sorted bounds."""
    step = max(1, int(buckets**0.5))
    size = F.size(bounds)
    coarse = F.size(F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step)),
                             lambda i: F.get(bounds, i) <= value))
    start = (coarse - 1) * step
    fine = F.size(F.filter(F.slice(bounds, F.greatest(start, F.lit(0)) + 1, F.lit(step)), lambda x: x <= value))
    return F.when(coarse == 0, F.lit(0)).otherwise(start + fine).cast("int")


def with_bucket(df: DataFrame, value: str, buckets: int | None = None, source: DataFrame | None = None,
                out: str = "_b") -> DataFrame:
    """Adds the order-preserving bucket of ``value``; bounds come from ``source`` (default: the frame itself)."""
    n = buckets or default_buckets(df.sparkSession)
    if n == 1:
        return df.withColumn(out, F.lit(0))
    bounds = splitters((source if source is not None else df).select(value), value, n)
    # One row of at most n values. As a join it is evaluated once, after the aggregation below it.
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, bucket_of(F.col(value), F.col("_splits"), n)).drop("_splits")


def with_hash_bucket(df: DataFrame, unit: str, buckets: int | None = None, out: str = "_b") -> DataFrame:
    """Same for a uniform number in [0, 1): equal slices are balanced already."""
    n = buckets or default_buckets(df.sparkSession)
    return df.withColumn(out, F.least(F.floor(F.col(unit) * n), F.lit(n - 1)).cast("int"))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str], descending: bool = False,
            bucket: str = "_b") -> DataFrame:
    """Inclusive running sums ``cum_<c>`` and group totals ``tot_<c>`` in order of the columns ``order``.

    The frame must carry ``bucket``, monotone in the order columns. A null in ``by`` is a group of its own.
    """
    by = list(by)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by, bucket,
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"tot_{c}") for c in sums],
    )
    inner_order = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inner = Window.partitionBy(*by, bucket).orderBy(*inner_order).rowsBetween(Window.unboundedPreceding, 0)
    # Every row has its offset row; a left join keeps the optimizer from pushing a null test of the bucket below the aggregation.
    joined = match(df, offsets, [*by, bucket], "left")
    return joined.withColumns({f"cum_{c}": F.sum(c).over(inner) + F.col(f"_o_{c}") for c in sums}).drop(*[f"_o_{c}" for c in sums])


def value_counts_running(df: DataFrame, by: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Distinct values per group with count ``n``, running count ``cum_n`` and total ``tot_n``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(with_bucket(counts, value, buckets, source=df), by, [value], ["n"])


ACCURACY = 10_000  # of the quantile summaries: their ranks are off by at most n / ACCURACY
WHOLE = 100_000  # below this many values nothing is cut away


def bracketed_counts(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """What exact quantiles need of whole columns: running counts of the values near each level, one row for each stretch between.

    The first pass builds mergeable quantile summaries, a few thousand numbers a task and column, and reads two bounds around every
    level from them, twice as far off as a summary can err. The second pass counts: values inside a bracket one by one, all others by
    the stretch they lie in, so that of a column only some 0.04 % a level leave a task. Rows are ``_i`` (position in ``cols``), ``low``
    and ``high`` (least and largest value of the row), ``n``, ``cum_n``, ``tot_n``. Nulls are left out, NaN is larger than all else.
    Order buckets are the brackets and stretches themselves.
    """
    levels = sorted({float(q) for q in qs})
    slack = 2.0 / ACCURACY
    marks = [min(1.0, max(0.0, q + d)) for q in levels for d in (-slack, slack)]
    work = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])

    def bounds(v: Column) -> Column:
        known = F.percentile_approx(F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v), marks, ACCURACY)
        everything = F.array(*[F.lit(float(x)) for _ in levels for x in ("-inf", "inf")])
        return F.when(F.count(v) < WHOLE, everything).otherwise(known)

    summary = work.agg(F.array(*[bounds(F.col(f"_v{i}")) for i in range(len(cols))]).alias("_bounds"))  # one row
    long = work.crossJoin(F.broadcast(summary)).select(
        "_bounds", F.posexplode(F.array(*[f"_v{i}" for i in range(len(cols))])).alias("_i", "_v")).filter("_v is not null")
    cut = F.get("_bounds", F.col("_i"))
    pairs = [(F.get(cut, F.lit(2 * k)), F.get(cut, F.lit(2 * k + 1))) for k in range(len(levels))]
    passed, inside = F.lit(0), F.lit(False)
    for lo, hi in pairs:
        passed = passed + (F.col("_v") > hi).cast("int")
        inside = inside | F.col("_v").between(lo, hi)
    marked = long.select("_i", "_v", (2 * passed + inside.cast("int")).alias("_b"))
    counts = marked.groupBy("_i", "_b", F.when(F.col("_b") % 2 == 1, F.col("_v")).alias("_kept")).agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))
    return running(counts, ["_i"], ["low"], ["n"])


def quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), buckets: int | None = None,
              names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per level (``q0``, ``q1``, … or ``names``)."""
    names = list(names or [f"q{i}" for i in range(len(qs))])
    if not by:
        return quantile_row(df, [value], qs).toDF(*names)
    ranked = value_counts_running(df, by, value, buckets)
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < last), F.col(value).cast("double")))

    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("tot_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_w{i}")]
    flat = ranked.groupBy(*by).agg(*aggs)
    return flat.select(*by, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(n)
        for i, n in enumerate(names)
    ])


def quantile_points(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact quantiles for a long list of levels, one row per level: ``by``, ``level_ix``, ``quantile``."""
    ranked = value_counts_running(df, by, value, buckets)
    last = F.col("tot_n") - 1
    levels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])
    covers = lambda rank: (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))
    hits = F.explode(F.filter(levels, lambda v: covers(F.floor(v["q"] * last)) | covers(F.ceil(v["q"] * last)))).alias("_v")
    pos = F.col("_v.q") * last
    rows = ranked.select(*by, value, "cum_n", "n", "tot_n", hits)
    at = lambda rank: F.max(F.when(covers(rank), F.col(value).cast("double")))
    lo, hi, w = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
    return rows.groupBy(*by, F.col("_v.i").alias("level_ix")).agg((lo + (hi - lo) * w).alias("quantile"))


def quantile_row(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """One row of exact linear-interpolation quantiles named ``<col>__q<i>``; null for a column without values."""
    ranked = bracketed_counts(df, cols, qs)
    exact = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.raise_error(F.lit("a quantile lies outside the bracket of its summary")).cast("double"))
    at = lambda rank: F.max(F.when((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")), exact))
    levels = []
    for j, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("tot_n") - 1)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        levels.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(f"q{j}"))
    flat = ranked.groupBy("_i").agg(*levels)
    return flat.agg(*[F.max(F.when(F.col("_i") == i, F.col(f"q{j}"))).alias(f"{c}__q{j}") for i, c in enumerate(cols) for j in range(len(qs))])


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """The same as one row per column that has values: ``column`` and ``q0``, ``q1``, …"""
    flat = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__q{j}`").alias(f"q{j}") for j in range(len(qs))]) for c in cols])
    return quantile_row(df, cols, qs).select(F.explode(flat).alias("_p")).select("_p.*").filter("q0 is not null")


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Numeric columns to rows; all values as double, nulls kept."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*ids, F.explode(pairs).alias("_p")).select(*ids, f"_p.{name}", f"_p.{value}")


def average_rank(df: DataFrame, by: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Distinct values with their average rank ``rank`` (1-based) and count ``n``."""
    ranked = value_counts_running(df, by, value, buckets)
    return ranked.withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)


def dense_index(keys: DataFrame, by: Sequence[str], unit: str, tie: Sequence[str], buckets: int | None = None,
                out: str = "ix") -> DataFrame:
    """0-based position of each key in hash order within ``by``; the group size is ``tot_one``."""
    marked = with_hash_bucket(keys, unit, buckets).withColumn("one", F.lit(1).cast("bigint"))
    placed = running(marked, by, [unit, *tie], ["one"])
    return placed.withColumn(out, F.col("cum_one") - 1).drop("cum_one", "one", "_b")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions rows that are about to be expanded many times.

    Adaptive execution sizes partitions by what goes in, so a small input that grows a thousandfold would end in few tasks; an explicit
    partition count is kept.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_rows(df: DataFrame, rows: int, *keys: str, per_task: int = 250_000, least: int | None = None) -> DataFrame:
    """The same for tables of any size: as many partitions as keep ``per_task`` of the ``rows`` in a task, so that its memory does not grow with the table."""
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // per_task)), *keys)


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, bucket: str) -> DataFrame:
    """Last non-null ``value`` at or before each row. ``bucket`` cuts long groups (monotone in the order columns)."""
    by = list(by)
    stamp = F.struct(*order)
    ends = df.filter(F.col(value).isNotNull()).groupBy(*by, bucket).agg(F.max_by(F.col(value), stamp).alias("_end"))
    cells = match(df.select(*by, bucket).distinct(), ends, [*by, bucket], "left")
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*by, bucket, F.last("_end", ignorenulls=True).over(before).alias("_in"))
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return match(df, carried, [*by, bucket]).withColumn(
        out, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_in"))).drop("_in")
