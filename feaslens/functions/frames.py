"""Column cleaning that needs statistics of the whole column (medians, percentile ranges)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.functions.columns import clip, num
from feaslens.operators import ordered


def ttc_large(df: DataFrame, col: str, floor: float = 10.0) -> DataFrame:
    """Missing or negative values become the 95% quantile of the valid ones, at least ``floor``."""
    x = num(col)
    valid = df.select(F.when(x >= 0, x).alias(col))
    big = ordered.quantile_row(valid, [col], [0.95]).select(F.greatest(F.coalesce(F.col(f"{col}__q0"), F.lit(floor)), F.lit(floor)).alias("_big"))
    return df.withColumn(col, F.coalesce(F.when(x >= 0, x), big.scalar()))


def median_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the exact median of the column, or 0 where the column is all null."""
    clean = df.select([num(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    med = ordered.quantile_row(clean, cols, [0.5])
    joined = clean.crossJoin(F.broadcast(med))  # one row
    return joined.select(*[F.coalesce(F.col(c), F.col(f"{c}__q0"), F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Norm:
    """Percentile scaling of one column to [0, 1]."""

    source: str | Column
    out: str
    invert: bool = False
    keep_null: bool = False
    anchor: str = "p99"


def normalize(df: DataFrame, specs: Sequence[Norm]) -> DataFrame:
    """Adds every ``out`` column. All ranges come from one pass over the distinct values.

    Inverting first reflects the values around their 99% point (or maximum), which mirrors the percentiles, so the range
    of the mirrored values follows from the same statistics.
    """
    staged = df
    names = []
    for i, s in enumerate(specs):
        names.append(f"_n{i}")
        staged = staged.withColumn(names[-1], num(s.source))
    distinct: dict[str, str] = {}
    for name, s in zip(names, specs):
        distinct.setdefault(str(s.source), name)
    use = [distinct[str(s.source)] for s in specs]
    stats = ordered.quantile_row(staged.select(*distinct.values()), list(distinct.values()), [0.0, 0.01, 0.99, 1.0])
    joined = staged.crossJoin(F.broadcast(stats))  # one row
    for name, base, s in zip(names, use, specs):
        q = lambda i: F.col(f"{base}__q{i}")
        x, lo, hi, low, high = F.col(name), q(1), q(2), q(0), q(3)
        if s.invert:
            top = q(2) if s.anchor == "p99" else q(3)
            x, lo, hi, low, high = top - x, top - q(2), top - q(1), top - q(3), top - q(0)
        wide, some = hi > lo, high > low
        a, b = F.when(wide, lo).otherwise(low), F.when(wide, hi).otherwise(high)
        value = F.when(wide | some, clip((x - a) / F.nullif(b - a, F.lit(0.0)), 0.0, 1.0)).when(x.isNotNull(), F.lit(0.0))
        value = F.when(x.isNotNull(), value)
        joined = joined.withColumn(s.out, value if s.keep_null else F.coalesce(value, F.lit(0.0)))
    return joined.select(*df.columns, *[s.out for s in specs])


def normalize_score(df: DataFrame, col: str, out: str, invert: bool = False, keep_null: bool = False, anchor: str = "p99") -> DataFrame:
    return normalize(df, [Norm(col, out, invert, keep_null, anchor)])
