"""How far the word use of each source of a language is from that of the other sources and of the language.

Words are counted once per task and group before any shuffle. The kept terms of a language get ids by falling count and are cut into blocks. In a block every
group's counts are the leaves of a segment tree; equal subtrees are one node, whatever group or place they stand in (most groups lack most rare terms, so
whole runs of zeros or ones are a single node a level). Two trees are walked at the same time, level by level, and each pair of nodes met under the same two
group totals is priced once. Prices are summed over blocks by Spark. The same walk of a group's tree and the language's tree, with the
largest surplus of a subtree for its price, finds the terms that a group uses more, without looking into subtrees that can't be among the first.

Sources are dealt into tiles, and a task has one block of terms for two tiles, so its rows are bounded however many sources, terms or rows there are.

Defined cases: null text, language or source read as ''; documents without terms still make their group occur; a document repeated counts each time; a
language without kept terms has pairs of value 0 and no terms; an empty table gives no rows; columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feaslens.llm.common import BLOCK, pick, stored, utf8
from feaslens.operators import ordered

#: Terms of a block (a power of two), sources of a tile about, tokens counted before a task hands its counts on, copies of a language's row in joins.
TERMS = 2048
TILE = 128
TOKENS = 4_000_000
SHARES = 32
SCALE = 10**9
SMOOTH = 5

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _count(batches: Iterator[pa.RecordBatch]):
    """Occurrences and documents of terms per group, handed on whenever enough tokens were read; a row without term says that the group occurs."""
    words: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    read = 0

    def rows():
        for (lang, source), (count, docs) in words.items():
            terms = list(count)
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n), pa.array([source] * n), pa.array([*(t.decode() for t in terms), None], pa.string()),
                pa.array([*count.values(), 0], pa.int64()), pa.array([*(docs[t] for t in terms), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text"))):
            count, docs = words.setdefault((lang, source), (Counter(), Counter()))
            data = text.translate(_TERM_BYTES)
            seen: set[bytes] = set()
            at = 0
            while at < len(data):
                end = data.find(b" ", at + BLOCK)
                end = len(data) if end < 0 else end
                tokens = data[at:end].split()
                count.update(tokens)
                seen.update(tokens)
                read += len(tokens)
                at = end
            docs.update(seen)
            if read >= TOKENS:
                yield from rows()
                words, read = {}, 0
    yield from rows()


class Trees:
    """Segment trees over the same leaves, one a row, in which equal subtrees are one node."""

    def __init__(self, counts: np.ndarray):
        self.values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            known = np.int64(ids.max() + 1) if ids.size else np.int64(1)
            keys, place = np.unique(ids[:, 0::2] * known + ids[:, 1::2], return_inverse=True)
            self.children.append((keys // known, keys % known))
            ids = place.reshape(ids.shape[0], -1)
        self.roots = ids[:, 0]


class Walk:
    """Pairs of trees walked together. A side is a node and its group's class; a pair of sides stands once on each level."""

    def __init__(self, trees: Trees, a: np.ndarray, b: np.ndarray, classes: np.ndarray):
        n = np.int64(classes.max() + 1)
        size = [len(trees.values), *[len(left) for left, _ in trees.children]]
        left, right = trees.roots[a] * n + classes[a], trees.roots[b] * n + classes[b]
        self.places: list[np.ndarray] = []
        for level in range(len(size) - 1, -1, -1):
            sides = np.int64(size[level]) * n
            keys, place = np.unique(left * sides + right, return_inverse=True)
            self.places.append(place)
            left, right = keys // sides, keys % sides
            if level:
                down_left, down_right = trees.children[level - 1]
                x, cx, y, cy = left // n, left % n, right // n, right % n
                left = np.concatenate([down_left[x] * n + cx, down_right[x] * n + cx])
                right = np.concatenate([down_left[y] * n + cy, down_right[y] * n + cy])
        #: The leaves' pairs: count and class of both sides.
        self.leaves = trees.values[left // n], left % n, trees.values[right // n], right % n

    def fold(self, prices: np.ndarray, op) -> list[np.ndarray]:
        """Prices of all pairs, from the roots' level to the leaves', made of their children's by ``op``."""
        out = [prices]
        for place in self.places[:0:-1]:
            both = out[0][place]
            out.insert(0, op(both[:len(both) // 2], both[len(both) // 2:]))
        return out


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), exact at any size."""
    if count.size and int(count.max()) + SMOOTH > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + SMOOTH) // int(t) for c, t in zip(count, total)], dtype=np.int64)
    return 1 + SCALE * (count + SMOOTH) // total


def _first(walk: Walk, prices: list[np.ndarray], row: int, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and prices of a pair of trees: all that can be among the first ``ranks``."""
    pair, leaf = walk.places[0][row:row + 1], np.zeros(1, dtype=np.int64)
    for level in range(len(prices)):
        if level:
            place = walk.places[level]
            pair = np.concatenate([place[pair], place[len(place) // 2 + pair]])
            leaf = np.concatenate([leaf * 2, leaf * 2 + 1])
        price = prices[level][pair]
        least = max(1, int(np.partition(price, -ranks)[-ranks])) if len(price) > ranks else 1
        pair, leaf = pair[price >= least], leaf[price >= least]
    return leaf, prices[-1][pair]


PRICED = "lang string, source string, part string, item string, value bigint"


def _price(ranks: int):
    def run(table: pa.Table) -> pa.Table:
        """One block of a language's terms for the sources of two tiles."""
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        head = np.flatnonzero(col["leaf"].is_null().to_numpy(zero_copy_only=False))
        lang, block = col["lang"][0].as_py(), col["block"][0].as_py()
        both = col["tile_a"][0].as_py(), col["tile_b"][0].as_py()
        numbers = lambda c, at: col[c].take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
        sources, total, tile = col["source"].take(pa.array(head)).to_pylist(), numbers("total", head), numbers("tile", head)
        terms, whole = int(numbers("terms", head[:1])[0]), int(numbers("whole", head[:1])[0])
        body = np.setdiff1d(np.arange(table.num_rows), head)
        leaf = numbers("leaf", body)
        row = {s: i for i, s in enumerate(sources)}
        at = np.array([row[s] for s in col["source"].take(pa.array(body)).to_pylist()], dtype=np.int64)
        # The last row is the language itself. Leaves without a term count -5: all shares are 1 there.
        counts = np.full((len(sources) + 1, TERMS), -SMOOTH, dtype=np.int64)
        counts[:, :max(0, min(TERMS, terms - block * TERMS))] = 0
        counts[at, leaf] = numbers("n", body)
        counts[-1, leaf] = numbers("n_lang", body)
        trees = Trees(counts)
        totals, classes = np.unique(np.append(total, whole), return_inverse=True)
        scale = np.maximum(totals + SMOOTH * terms, 1)
        out: list[tuple[list[str], list[str], list[str], list[int]]] = []

        def priced(a, b):
            walk = Walk(trees, a, b, classes)
            ca, ka, cb, kb = walk.leaves
            return walk, ca, _shares(ca, scale[ka]) - _shares(cb, scale[kb])

        a, b = np.triu_indices(len(sources), 1) if both[0] == both[1] else map(np.ravel, np.meshgrid(np.flatnonzero(tile == both[0]), np.flatnonzero(tile == both[1]), indexing="ij"))
        if len(a):
            walk, _, gap = priced(a, b)
            value = walk.fold(np.abs(gap), np.add)[0][walk.places[0]].tolist()
            left, right = [sources[i] for i in a.tolist()], [sources[i] for i in b.tolist()]
            out.append((left + right, ["pair"] * (2 * len(left)), right + left, value * 2))
        if both[0] == both[1] and len(body):
            groups = np.arange(len(sources))
            walk, count, gap = priced(groups, np.full(len(groups), len(sources)))
            prices = walk.fold(np.where(count > 0, gap, -1), np.maximum)
            names = dict(zip(leaf.tolist(), col["term"].take(pa.array(body)).to_pylist()))
            for i in groups.tolist():
                best, value = _first(walk, prices, i, ranks)
                if len(best):
                    found = sorted(zip(value.tolist(), (names[x] for x in best.tolist())), key=lambda p: (-p[0], p[1].encode()))[:ranks]
                    out.append(([sources[i]] * len(found), ["term"] * len(found), [t for _, t in found], [v for v, _ in found]))
        source, part, item, value = ([x for o in out for x in o[k]] for k in range(4))
        return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()),
                         "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})
    return run


def _with_language(rows: DataFrame, langs: DataFrame, spread: str, *columns: str) -> DataFrame:
    """A language's columns joined to rows: its row is copied and the rows are dealt among the copies, so a language with most rows isn't one task's."""
    copies = langs.select(F.col("lang").alias("_lang"), *columns, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(spread), F.lit(SHARES)).cast("int"))
    return dealt.join(copies, (dealt["lang"] == copies["_lang"]) & (dealt["_deal"] == copies["_share"])).drop("_lang", "_share", "_deal")


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank``."""
    named = pick(docs, text=text, lang=lang, source=source)
    named = named.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counts = stored(named.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    # Falling count, then a hash: one number that parts even the many terms of one count.
    unit = F.pmod(F.xxhash64("term"), F.lit(1 << 20)) / float(1 << 20)
    kept = stored(kept.select("lang", "term", "n", (unit - F.col("n")).alias("order"), F.lit(1).cast("bigint").alias("one")), "kept-terms")
    ids = ordered.running(ordered.with_bucket(kept, "order"), ["lang"], ["order", "term"], ["one"])
    place = F.col("cum_one") - 1
    ids = ids.select("lang", "term", F.col("n").alias("n_lang"), F.floor(place / TERMS).alias("block"), F.pmod(place, F.lit(TERMS)).cast("int").alias("leaf"))
    rows = stored(counts.filter("term is not null").drop("docs").join(ids, ["lang", "term"]), "block-counts")
    groups = counts.filter("term is null").select("lang", "source").join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = stored(groups.withColumn("total", F.coalesce("total", F.lit(0).cast("bigint"))), "term-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.ceil(F.count("*") / TILE).alias("tiles")).join(
        kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("bigint")))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("tile_a"), F.greatest("tile", t).alias("tile_b"))))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)) - 1)
    heads = _with_language(groups, langs, "source", "whole", "tiles", "terms").withColumn("tile", tile).withColumn("block", F.explode(blocks))
    body = _with_language(rows, langs, "term", "tiles").withColumn("tile", tile)
    key = ["lang", "block", "tile_a", "tile_b"]
    heads = heads.withColumn("_t", pairs).select("lang", "block", "_t.*", "source", "tile", "total", "whole", "terms")
    body = body.withColumn("_t", pairs).select("lang", "block", "_t.*", "source", "term", "leaf", "n", "n_lang")
    parts = heads.unionByName(body, allowMissingColumns=True).groupBy(*key).applyInArrow(_price(ranks), PRICED)
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = sums.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("part").isin("pair") | (F.col("rank") <= ranks))


AUDIT_SQL = """
with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by lang, term having count(distinct id) >= 30),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join c using (lang, source) group by lang, source),
p as (select lang, source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (t.total + 5 * v) as p, 1 + 1000000000 * (k.n + 5) // (l.total + 5 * v) as q
  from totals t join langs l using (lang) join kept k using (lang) left join c using (lang, source, term)),
pairs as (select g.lang, g.source, o.source as item, coalesce(sum(abs(a.p - b.p)), 0)::bigint as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source left join p a on a.lang = g.lang and a.source = g.source
  left join p b on b.lang = o.lang and b.source = o.source and b.term = a.term group by all),
rows_ as (select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from rows_)
select * from ranked where part = 'pair' or rank <= 50
"""
