"""Mixing sources to target weights.

Every document gets a hash-random key. Inside a source the keys are cut into ranges, ranges are sorted, and running word counts are sums
of earlier ranges plus a running sum inside the range, so no source is ever sorted in one task. A source's budget is cut exactly: whole
passes (epochs) first, then documents in key order, the last one in part.

Defined cases: a null text has size 0; a null source is a source of its own and sorts last; a null id takes part with one key;
repeated rows each count; an empty table gives an empty result; columns other than the three named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.llm.common import WORD, partitions, pick, stored, text_of

KEY_DIGITS = 7


def key(doc_id: Column, seed: int) -> Column:
    """Random order that depends on the id and the seed only."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows with ``source`` and ``size``.

    Sources in code-point order take the weights in turn and share ``share`` times all words. A target stops at ``cap`` times its source;
    what is over is shared again by weight, until no target is above. In order of cap / weight the capped sources come first, so two
    running sums over the list of sources find the level at which the rest is shared.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(turn, F.lit(len(weights))).cast("int") + 1)
    rows = totals.withColumns({"turn": turn, "weight": weight, "most": F.col("source_size") * F.lit(float(cap))})
    order = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "left_words": F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("left_words") / F.col("left_weight"))
    free = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct(F.col("most") / F.col("weight"), "turn", "level"))).over(whole)
    return rows.withColumn("free", free).select(
        "source", "source_size", F.least(F.col("most"), F.coalesce(F.col("free.level") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    n = buckets or partitions(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    rows = stored(rows, "mix-sizes").withColumn("key", key(F.col("doc_id"), seed))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("long") * n / F.lit(16**KEY_DIGITS)).cast("int"))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    targets = source_targets(ranges, weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    places = ranges.select("source", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("earlier"))
    places = places.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target")
    placed = rows.alias("r").join(places.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range"))).select(
        "r.*", "earlier", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("earlier") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size") - start
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its n-th word."""
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    kept = F.zip_with(F.slice(gaps, 1, n), F.slice(words, 1, n), lambda g, w: F.concat(g, w))
    return F.array_join(kept, "")


def mixed_documents(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text", "lang", "source", "n_chars"), **options) -> DataFrame:
    """The mix as documents: a row for each pass over a document, the last one cut after the words that the budget still allows.

    Documents of which nothing is taken go; ``n_chars`` is the new length. Rows that share an id are taken alike, as the one with most.
    """
    taken = mix(docs, **options).groupBy("doc_id").agg(F.max("size").alias("size"), F.max("taken").alias("taken")).filter("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), "size", "taken")
    rows = pick(docs, **{c: c for c in columns}).join(taken, F.col("doc_id").eqNullSafe(F.col("_id")))
    size = F.col("size")
    rows = rows.withColumn("_words", F.explode(F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int")), lambda i: F.least(size, F.col("taken") - (i - 1) * size).cast("int"))))
    text = F.when(F.col("_words") == size, F.col("text")).otherwise(first_words(F.col("text"), F.col("_words")))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


MIX_SQL = """
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, 'null') || ':17') as key from documents),
totals as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][1 + ((turn - 1) % 3)] as weight, source_size * 2.0::double as most
  from (select *, row_number() over (order by source asc nulls last) as turn from totals)),
filled as (
  select *, (sum(source_size) over ()::double * 1.5::double - coalesce(sum(most) over before, 0.0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0.0)) as level
  from weighed window before as (order by most / weight, turn rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(most, coalesce((select level from filled where most / weight > level order by most / weight, turn limit 1) * weight, most)) as target
  from filled),
cut as (
  select doc_id, size, source_size, target, floor(target + 0.5)::bigint as budget,
         (sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and current row))::bigint - size as start
  from sizes s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then budget // source_size else 0 end * size
        + greatest(0, least(budget - (case when source_size > 0 then budget // source_size else 0 end) * source_size - start, size)))::bigint as taken
from cut
"""
