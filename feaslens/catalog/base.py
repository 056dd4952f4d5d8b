"""Registry of queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r(expr: str, digits: int = 6) -> str:
    """Half-even rounding in the check SQL, with negative zero folded into zero."""
    return f"(round_even({expr}, {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column half-even, as the check SQL does."""
    return df.select(*[
        (F.bround(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double"
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def rcol(col: Column, digits: int = 6) -> Column:
    return F.bround(col, digits) + F.lit(0.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCORED_SQL = """scored as (
  select l_orderkey as scenario, l_linenumber, l_linestatus, l_extendedprice as score, l_quantity as qty,
         l_discount as disc, l_tax as tax, case when l_returnflag = 'R' then 1 else 0 end as y
  from lineitem)"""


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("scenario"), "l_linenumber", "l_linestatus",
        F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
