"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

A version of a file (here: a document) is addressed by the SHA-256 of its text. Each distinct blob is scanned once for each version of a rule;
what the ledger already has is not scanned again. Findings are kept by blob and joined back to every path that holds the blob.

A match is placed by lengths: ``split`` gives the gaps between matches and ``regexp_extract_all`` the matches, so starts are running sums of code points.

Defined cases: a null text is the empty blob; a null id is a path like others; repeated rows give repeated rows; an empty table gives
an empty result; overlapping matches of different kinds are all kept; columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.llm.common import pick, stored, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: The group whose length counts, and its least length in characters.
    group: int = 0
    least: int = 1


#: Fixed values of the base rules, in their listed order. Runs of one class are asked for at their least length at once;
#: ``assign`` is not, since a value that is too short still ends its match.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("private", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 40),
)
RULES = BASE + MORE


def address(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def blobs(paths: DataFrame) -> DataFrame:
    """(blob, text): every distinct text once. Copies within a task meet before the shuffle."""
    return paths.groupBy("blob").agg(F.first("text").alias("text"))


def _scan(fresh: DataFrame, rule: Rule, number: int) -> DataFrame:
    """Matches of one rule, with lengths still to be summed."""
    lengths = lambda a: F.transform(a, F.length)
    all_of = lambda g: F.regexp_extract_all("text", F.lit(rule.pattern), g)
    parts = F.arrays_zip(lengths(F.split("text", rule.pattern, -1)).alias("gap"), lengths(all_of(0)).alias("hit"), lengths(all_of(rule.group)).alias("held"))
    return fresh.filter(F.col("text").rlike(rule.pattern)).select(
        "blob", F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.posexplode(parts).alias("place", "part")
    ).select("blob", "number", "kind", "version", "place", "part.gap", "part.hit", F.col("part.held").alias("held"), F.lit(rule.least).alias("least"))


def findings(fresh: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, number, kind, version, start, end) of rows with ``blob`` and ``text``; code points, end exclusive."""
    marked = reduce(DataFrame.unionByName, [_scan(fresh, rule, i) for i, rule in enumerate(rules)])
    upto = Window.partitionBy("blob", "number").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.col("hit"), F.lit(0))).over(upto)
    return marked.withColumn("end", end).filter(F.col("hit").isNotNull() & (F.col("held") >= F.col("least"))).select(
        "blob", "number", "kind", "version", (F.col("end") - F.col("hit")).alias("start"), "end")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None, known: DataFrame | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger): paths (path, blob) of every row, findings by blob, and the (blob, kind, version) pairs scanned so far.

    Hand the ledger and the findings of the last run back in, and only pairs that are not in it are scanned.
    """
    paths = pick(docs, path=id_col, text=text_col).select("path", address(text_of()).alias("blob"), text_of().alias("text"))
    every = blobs(paths)
    if ledger is None:
        found = findings(every, rules)
        seen = every.select("blob")
        done = reduce(DataFrame.unionByName, [seen.withColumns({"kind": F.lit(r.kind), "version": F.lit(r.version)}) for r in rules])
    else:
        parts, pairs = [], [ledger]
        for i, rule in enumerate(rules):
            had = ledger.filter((F.col("kind") == rule.kind) & (F.col("version") == rule.version)).select("blob")
            fresh = every.join(had, "blob", "left_anti")
            parts.append(findings(fresh, [rule]).withColumn("number", F.lit(i)))
            pairs.append(fresh.select("blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))
        found, done = reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, pairs)
    found = stored(found, "secret-findings")
    if known is not None:
        found = found.unionByName(known)
    return paths.select("path", "blob"), found, done


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_blob(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """One row per blob with findings: counts by base kind, the base spans and all spans as text."""
    span = F.struct("start", "number", "kind", "end")
    return found.groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in base],
        F.collect_list(F.when(F.col("number") < len(base), span)).alias("base"), F.collect_list(span).alias("every"),
    ).select("blob", *[f"n_{r.kind}" for r in base], _written(F.col("base")).alias("base"), _written(F.col("every")).alias("spans"))


def scan_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    paths, found, _ = scan(docs, **options)
    # Stored, so that both sides of the join come straight from a shuffle: a blob with very many paths can then be split.
    rows = paths.join(stored(by_blob(found), "secret-blobs"), "blob", "left")
    return rows.select(
        F.col("path").alias("doc_id"), *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text", "lang", "source", "n_chars"), rules: Sequence[Rule] = RULES,
           mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by ``mark``; overlapping and touching spans become one. ``n_chars`` is the new length."""
    _, found, _ = scan(docs, rules, id_col=id_col, text_col=text_col)
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn(
        "island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # What is kept runs from the end of one island to the start of the next.
    cuts = stored(merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")), "secret-cuts")
    rows = docs.select(*columns).withColumn("_blob", address(text_of(text_col)))
    rows = rows.join(cuts.withColumnRenamed("blob", "_blob").withColumnRenamed("cuts", "_cuts"), "_blob", "left")
    from_ = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["end"].cast("int")))
    to = F.concat(F.transform("_cuts", lambda c: c["start"].cast("int")), F.array(F.length(text_col)))
    kept = F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda p: F.substring(F.col(text_col), p["a"] + 1, p["b"] - p["a"]))
    text = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, mark))
    return rows.withColumn(text_col, text).withColumn("n_chars", F.length(text_col).cast("long")).select(*columns)


def report_sql() -> str:
    parts = []
    for i, r in enumerate(BASE + MORE):
        p = r.pattern.replace("'", "''")
        parts.append(f"""select doc_id, text, {i} as number, '{r.kind}' as kind, {r.least} as least, [length(x) for x in string_split_regex(text, '{p}')] as gaps,
      [length(x) for x in regexp_extract_all(text, '{p}', 0)] as hits, [length(x) for x in regexp_extract_all(text, '{p}', {r.group})] as held
    from docs where regexp_matches(text, '{p}')""")
    union = "\n    union all ".join(parts)
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
hit as (
    {union}),
placed as (
  select doc_id, number, kind, hits[i] as len, list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i-1]), 0) as start
  from (select *, unnest(range(1, len(hits) + 1)) as i from hit) where held[i] >= least),
spans as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || start::bigint || ':' || (start + len)::bigint, ',' order by start, number) filter (number < {len(BASE)}) as base,
         string_agg(kind || ':' || start::bigint || ':' || (start + len)::bigint, ',' order by start, number) as spans
  from placed group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join spans using (doc_id)
"""
