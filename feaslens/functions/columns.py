"""Scalar cleaning, hashing and bucketing helpers. Every function returns a Column."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts read as true, and the endpoint rules over the ordinal label.
TRUE_TEXTS = ("true", "1", "yes", "y")
BINARY_RULES = {"ge1": (">=", 1), "ge2": (">=", 2), "eq3": ("=", 3)}
TASK_RULES = {"safe_vs_risky": "ge1", "warning_or_above": "ge2", "emergency_only": "eq3"}


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def num(col: Column | str, default: float | None = None) -> Column:
    """Number or null: text that is no number, NaN and infinities become null (then ``default`` when given)."""
    x = as_col(col).try_cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(None).cast("double")).otherwise(x)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def num_or(df: DataFrame, name: str, default: float | None = None) -> Column:
    """``num`` of a column that may be absent from the frame; an absent column is all ``default``."""
    if name in df.columns:
        return num(name)
    return F.lit(default).cast("double")


def num_filled(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """``num`` where an absent column and a null both count as ``default``."""
    return F.coalesce(num_or(df, name), F.lit(float(default)))


def non_negative_or_null(col: Column | str) -> Column:
    x = num(col)
    return F.when(x >= 0, x)


def ttc_capped(col: Column | str, cap: float) -> Column:
    """Time to collision where missing or negative counts as the cap, and nothing exceeds it."""
    return F.least(F.coalesce(non_negative_or_null(col), F.lit(float(cap))), F.lit(float(cap)))


def ttc_inverse(col: Column | str, floor: float = 0.1) -> Column:
    """1/max(ttc, floor), zero where there is no collision course."""
    ttc = non_negative_or_null(col)
    return F.coalesce(F.when(ttc.isNotNull(), 1.0 / F.greatest(ttc, F.lit(float(floor)))), F.lit(0.0))


def ttc_sentinel(col: Column | str, sentinel: float = 999.0) -> Column:
    return F.coalesce(non_negative_or_null(col), F.lit(float(sentinel)))


def mean_of(cols: Sequence[Column | str]) -> Column:
    """Row mean of the terms that are present; null when none is."""
    terms = [as_col(c) for c in cols]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    count = sum((t.isNotNull().cast("int") for t in terms[1:]), terms[0].isNotNull().cast("int"))
    return F.when(count > 0, total / count)


def wrap_to_pi(angle: Column | str) -> Column:
    return F.pmod(as_col(angle) + F.lit(math.pi), F.lit(2.0 * math.pi)) - F.lit(math.pi)


def _of_libm(f: Callable[[float], float]):
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) if math.isfinite(v) else math.nan for v in x.to_pylist()], pa.float64())
    return F.arrow_udf(run, "double")


def cos(col: Column | str) -> Column:
    """Cosine as the C library rounds it. The JVM's may be off by the last bit, which decides between equal distances and on edges of boxes."""
    return _of_libm(math.cos)(as_col(col).cast("double"))


def sin(col: Column | str) -> Column:
    """Sine as the C library rounds it, see ``cos``."""
    return _of_libm(math.sin)(as_col(col).cast("double"))


def to_local(x, y, origin_x, origin_y, heading) -> tuple[Column, Column]:
    """Point in the frame whose origin and x axis are the ego position and heading."""
    dx, dy = as_col(x) - as_col(origin_x), as_col(y) - as_col(origin_y)
    return to_local_vector(dx, dy, heading)


def to_local_vector(vx, vy, heading) -> tuple[Column, Column]:
    c, s = cos(heading), sin(heading)
    vx, vy = as_col(vx), as_col(vy)
    return c * vx + s * vy, c * vy - s * vx


def nearest_bin(col: Column | str, bins: Sequence[float]) -> Column:
    """Closest bin value; the earlier bin wins a tie."""
    x = as_col(col)
    ranked = [
        F.struct(F.abs(x - F.lit(float(b))).alias("gap"), F.lit(i).alias("ix"), F.lit(float(b)).alias("bin"))
        for i, b in enumerate(bins)
    ]
    return F.least(*ranked)["bin"] if len(ranked) > 1 else ranked[0]["bin"]


def clip(col: Column, low: float, high: float) -> Column:
    """Limits a number to [low, high]; null stays null (least/greatest alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high))))


def smoothstep(u: Column) -> Column:
    z = clip(u, 0.0, 1.0)
    return z * z * (3.0 - 2.0 * z)


def smoothstep_slope(u: Column) -> Column:
    z = clip(u, 0.0, 1.0)
    return 6.0 * z * (1.0 - z)


def bucket(col: Column | str, edges: Sequence[float], labels: Sequence[str], missing: str, right: bool = True) -> Column:
    """Label of the interval holding the value; ``right`` closes intervals on the right, otherwise on the left."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    x = num(col)
    out = F.when(x.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge if right else x < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def distance_bucket(col: Column | str) -> Column:
    return bucket(col, [3.0, 10.0], ["<3m", "3-10m", ">=10m"], "missing", right=False)


def ttc_bucket(col: Column | str) -> Column:
    return bucket(col, [0.0, 1.0, 3.0], ["ttc<0", "0-1s", "1-3s", ">=3s"], "missing", right=False)


def hex_unit(digest: Column, start: int, digits: int) -> Column:
    """Hex digits of a digest as a number in [0, 1). Up to 16 digits."""
    # Up to 15 digits fit a signed long; more need a decimal on the way.
    text = F.conv(F.substring(digest, start, digits), 16, 10)
    whole = (text.cast("bigint") if digits <= 15 else text.cast("decimal(20,0)")).cast("double")
    return whole / F.lit(float(16**digits))


def unit_hash(*parts: Column | str | int, sep: str = "|") -> Column:
    """Stable number in [0, 1) from the SHA-1 of the parts joined by ``sep``. Plain str parts are column names."""
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    return hex_unit(F.sha1(F.concat_ws(sep, *cols).cast("binary")), 1, 16)


def unit_hash12(*parts: Column | str | int, sep: str = ":") -> Column:
    """The twelve-digit variant, which divides by the largest value and so can reach 1."""
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    whole = F.conv(F.substring(F.sha1(F.concat_ws(sep, *cols).cast("binary")), 1, 12), 16, 10)
    return whole.cast("double") / F.lit(float(16**12 - 1))


def job_seed(*parts: Column | str | int, sep: str = "|") -> Column:
    """Integer seed from the first eight hex digits."""
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    return F.conv(F.substring(F.sha1(F.concat_ws(sep, *cols).cast("binary")), 1, 8), 16, 10).cast("bigint")


def row_hash(col: Column | str) -> Column:
    return F.substring(F.sha1(as_col(col).cast("string").cast("binary")), 1, 12)


def truthy(col: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(as_col(col).cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def first_present(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """First non-null of the columns that exist."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    if default is not None:
        found.append(F.lit(default))
    if not found:
        raise ValueError(f"none of {list(names)} is present")
    return F.coalesce(*found)


def with_scenario_id(df: DataFrame) -> DataFrame:
    """Cluster key: scenario id, else planner scenario id, else sample id."""
    names = ["scenario_id", "commonroad_scenario_id", "sample_id"]
    return df.withColumn("scenario_id", first_present(df, names))


def binary_target(label: Column | str, rule: str) -> Column:
    op, level = BINARY_RULES[TASK_RULES.get(rule, rule)]
    x = num(label).cast("int")
    return F.coalesce((x >= level if op == ">=" else x == level).cast("int"), F.lit(0))


def round6(col: Column | str) -> Column:
    return F.bround(as_col(col), 6)


def available(df: DataFrame, names: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def count_string(df: DataFrame, keys: Sequence[str], col: str, out: str = "counts") -> DataFrame:
    """``value:count`` pairs joined by semicolons in value order, one row per key.

    Counts are aggregated before they are gathered, so a hot key costs one row per distinct value.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    pair = F.struct(F.col(col).cast("string").alias("v"), F.col("_n").alias("n"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat_ws(":", p["v"], p["n"].cast("string"))), ";"
    )
    return counts.groupBy(*keys).agg(joined.alias(out))


def split_counts(df: DataFrame, col: str) -> DataFrame:
    """Inverse of ``count_string``: one row per pair, in columns ``value`` and ``n``."""
    pair = F.explode(F.filter(F.split(F.col(col), ";"), lambda p: p.contains(":")))
    text = df.withColumn("_pair", pair)
    name = F.regexp_extract("_pair", r"^(.*):(\d+)$", 1)
    return text.select(
        *df.columns, name.alias("value"), F.regexp_extract("_pair", r"^(.*):(\d+)$", 2).cast("bigint").alias("n")
    )
