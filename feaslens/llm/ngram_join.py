"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct runs of five words as 64-bit hashes. All sets are ordered by hash. A set of n tokens may miss n - ceil(t n) of them in a
partner, so its first n - ceil(t n) + k tokens hold k tokens of any partner, and both prefixes share k tokens at least. Among these there is a
token that is rare, or all k are frequent: rare tokens are indexed one by one, frequent ones count only as combinations of k.

1. Prefixes are extended by k = 8 + n/24. Tokens in more than ``RARE`` sets are the frequent class.
2. Sets with k frequent tokens in their prefix are indexed again, among themselves, with all their tokens (k is then ceil(t n)). Of those that again hold
   too many frequent ones, the prefix is taken in order of frequency, so their combinations are of the least frequent tokens.
3. Links to the first set of each index entry are verified first, for frequent tokens in several turns with another first set each; what they join is one cluster. After that
   only pairs between different clusters are left to look at, so a group of near copies doesn't become all its pairs. These pairs must share enough
   prefix tokens: rare ones counted, and no more frequent ones than either has. Those that do are verified on the whole sets. Where only frequent tokens
   are shared, sets that hang together over them are compared in blocks, cluster against cluster, by products of 0/1 matrices.

Equal sets are one node throughout (their 64-bit digest), so copies are never compared. No candidate is dropped: counts below what step 1 proves are no link.

Defined cases: a null or empty text and one without words has an empty set, linked with nothing; fewer than five words are one token; ids may be
null (they never become a component's id while another is there) or repeated; columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feaslens.llm.common import BLOCK, mix64, partitions, passes, pick, pieces, shingle_hashes, sieve, stored, utf8, word_hashes
from feaslens.llm.graph import components
from feaslens.operators.ordered import match

SHINGLE = 5
#: Similarity in percent from which two sets are linked.
PERCENT = 75
RARE = 16
#: Sets of which a task remembers that it has emitted their tokens already.
REMEMBERED = 100_000
#: A token in more sets of one piece of text than RARE is frequent for certain; its rows are dealt over so many parts.
PARTS = 64
#: Sets that each set is held against for a frequent token before the pairs between clusters are taken.
TURNS = 4
#: Tokens of a block of sets, and columns of a matrix at a time.
TILE = 1 << 16
COLUMNS = 4096


def token_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for a, b in pieces([len(t) for t in texts]):
        words, _, begins, _ = word_hashes(texts[a:b])
        shingles, at = shingle_hashes(words, begins, size)
        out += [np.unique(shingles[i:j]) for i, j in zip(at, at[1:])]
    return out


def digest(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix64(np.array([np.bitwise_xor.reduce(mix64(tokens + np.uint64(77))) ], dtype=np.uint64) + mix64(tokens).sum(keepdims=True) * np.uint64(3) + np.uint64(len(tokens))).view(np.int64)[0])


def least_overlap(n, percent: int):
    """ceil(t n), on numbers or columns."""
    return (n * percent + 99) // 100


def documents_sets(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, sid) of rows with doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = token_sets(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64())],
                                             names=["doc_id", "n", "sid"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, sid long")


def _fresh(texts: list[bytes], seen: OrderedDict) -> list[tuple[int, np.ndarray, bytes]]:
    """(sid, tokens, text) of the sets not met by this task of late."""
    out = []
    for tokens, text in zip(token_sets(texts), texts):
        if len(tokens):
            sid = digest(tokens)
            if sid not in seen:
                out.append((sid, tokens, text))
                seen[sid] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
    return out


def index(rows: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(token, sids, ns, frequent) of every token in the prefixes of two sets or more.

    A rare token is one row with all its sets, in order; a frequent one has a row for each set.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in pieces([len(t) for t in texts], 4 * BLOCK):
                sets = _fresh(texts[a:b], seen)
                if not sets:
                    continue
                n = np.array([len(s) for _, s, _ in sets])
                length = n if whole else np.minimum(n, n - least_overlap(n, percent) + 8 + n // 24)
                tokens = np.concatenate([s[:m] for (_, s, _), m in zip(sets, length)]).view(np.int64)
                sids, ns = np.repeat(np.array([s for s, _, _ in sets], dtype=np.int64), length), np.repeat(n, length).astype(np.int32)
                found, back, counts = np.unique(tokens, return_inverse=True, return_counts=True)
                hot = counts > RARE
                part = np.where(hot[back], 1 + (sids % PARTS + PARTS) % PARTS, 0).astype(np.int32)
                marks = found[hot]  # tell the part of the others that this token is frequent
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([tokens, marks])), pa.array(np.concatenate([part, np.zeros(len(marks), np.int32)])),
                    pa.array(np.concatenate([sids, np.zeros(len(marks), np.int64)])), pa.array(np.concatenate([ns, np.full(len(marks), -1, np.int32)]))],
                    names=["token", "part", "sid", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32))
        frequent_key = None
        for batch in _columns(batches):
            rows_ = tuple(np.concatenate(x) for x in zip(held, batch))
            if not len(rows_[0]):
                continue
            token, part = rows_[0], rows_[1]
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))
            cut = int(starts[-1])
            yield from _groups(tuple(x[:cut] for x in rows_), frequent_key)
            if cut:
                frequent_key = None
            held = tuple(x[cut:] for x in rows_)
            if len(held[0]) > 1 << 16:  # frequent whatever follows
                key = (int(held[0][0]), int(held[1][0]))
                yield from _groups(held, key)
                frequent_key, held = key, tuple(x[-1:] for x in held)
        yield from _groups(held, frequent_key)

    spread = rows.mapInArrow(emit, "token long, part int, sid long, n int").repartition(partitions(rows.sparkSession), "token", "part")
    return spread.sortWithinPartitions("token", "part", "sid").mapInArrow(gather, "token long, sids array<long>, ns array<int>, frequent boolean")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "part", "sid", "n"))


def _groups(rows: tuple, frequent_key: tuple | None) -> Iterator[pa.RecordBatch]:
    """Index rows of whole (token, part) groups, or of a frequent group's next rows."""
    token, part, sid, n = rows
    if not len(token):
        return
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
    group = np.cumsum(new) - 1
    frequent = np.zeros(int(group[-1]) + 1, dtype=bool)
    frequent[group[(n < 0) | (part > 0)]] = True
    if frequent_key is not None and (int(token[0]), int(part[0])) == frequent_key:
        frequent[0] = True
    keep = (n >= 0) & (new | np.concatenate([[True], sid[1:] != sid[:-1]]) | np.concatenate([[True], n[:-1] < 0]))
    token, sid, n, group = token[keep], sid[keep], n[keep], group[keep]
    counts = np.bincount(group, minlength=len(frequent))
    frequent |= counts > RARE
    kind, size = frequent[group], counts[group]
    one = np.flatnonzero(kind)
    if len(one):
        yield _index_rows(token[one], np.arange(len(one) + 1), sid[one], n[one], True)
    few = np.flatnonzero(~kind & (size > 1))
    if len(few):
        g = group[few]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        yield _index_rows(token[few][first], np.concatenate([first, [len(few)]]), sid[few], n[few], False)


def _index_rows(token, offsets, sid, n, frequent: bool) -> pa.RecordBatch:
    offsets = pa.array(offsets.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(token), pa.ListArray.from_arrays(offsets, pa.array(sid)), pa.ListArray.from_arrays(offsets, pa.array(n)),
                                       pa.array(np.full(len(token), frequent))], names=["token", "sids", "ns", "frequent"])


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text): a text for each set in ``wanted`` (sid)."""
    bits = rows.sparkSession.sparkContext.broadcast(sieve(wanted, "sid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            sets = [s for s in _fresh(utf8(batch.column("text")), seen) if passes(bits.value, s[0])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in sets], pa.int64()), pa.array([t for _, _, t in sets], pa.binary()).cast(pa.string())], names=["sid", "text"])

    named = rows.select("text").mapInArrow(run, "sid long, text string")
    return named.join(wanted, "sid").groupBy("sid").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs of sets whose similarity, counted on the whole sets, is ``percent`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = utf8(batch.column("a")), utf8(batch.column("b"))
            good = []
            for a, b in pieces([len(x) + len(y) for x, y in zip(left, right)]):
                sets = token_sets(left[a:b] + right[a:b])
                for x, y in zip(sets[:b - a], sets[b - a:]):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    pairs = stored(pairs, "pairs")
    sided = pairs.join(texts.select(F.col("sid").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("sid").alias("v"), F.col("text").alias("b")), "v")
    return sided.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _k(n: Column, percent: int, whole: bool) -> Column:
    """Tokens that the prefix shares with any partner's at least (if the partner isn't smaller)."""
    full = F.floor((n * percent + 99) / 100)
    return full if whole else F.least(F.lit(8) + F.floor(n / 24), full)


def _long_enough(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_sets(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the sets that have a link, from rows with ``text``."""
    first = stored(index(rows, percent, False), "prefix-index")
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # tokens of the smallest possible partner
    members = first.select("frequent", F.explode(F.arrays_zip("sids", "ns")).alias("m")).select("frequent", F.col("m.sids").alias("sid"), F.col("m.ns").alias("n"))
    counts = stored(members.groupBy("sid", "n").agg(F.count("*").alias("shared"), F.count(F.when(F.col("frequent"), 1)).alias("frequent")).filter(
        F.col("shared") >= _k(smallest, percent, False)), "prefix-counts")
    texts = stored(texts_of(rows, counts.select("sid")), "texts")
    again = counts.filter(F.col("frequent") >= _k(smallest, percent, False)).select("sid")
    second = stored(index(texts.join(again, "sid").select("text"), percent, True), "whole-index")
    members2 = second.filter("frequent").select(F.col("sids")[0].alias("sid"), F.col("ns")[0].alias("n"), "token")
    counts2 = stored(members2.groupBy("sid", "n").agg(F.count("*").alias("frequent")), "whole-counts")
    frequent = stored(_least_frequent(members2, counts2, percent), "frequent-rows")

    stars = []
    for part, whole in ((first, False), (second, True)):
        rare = part.filter("not frequent").select(F.col("sids")[0].alias("u"), F.col("ns")[0].alias("m"), F.explode(F.arrays_zip("sids", "ns")).alias("x")).select(
            "u", "m", F.col("x.sids").alias("v"), F.col("x.ns").alias("n")).filter("u <> v")
        stars.append(_enough(rare, percent, whole))
    known = counts.select("sid")
    stars += [_starred(frequent, turn, percent) for turn in range(TURNS)]
    clusters = stored(components(verified(reduce(DataFrame.unionByName, stars).distinct(), texts, percent)), "clusters")

    # All other pairs lie between clusters.
    pairs = [_across(first, counts, clusters, known, percent, False), _across(second, counts2, clusters, known, percent, True)]
    more = verified(pairs[0].unionByName(pairs[1]).distinct(), texts, percent).unionByName(_tiled(frequent, clusters, texts, percent))
    return components(stored(more, "links").unionByName(clusters.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def _least_frequent(members: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """(sid, n, token) of the frequent tokens in the extended prefix of each set, when tokens are ordered by frequency.

    Tokens that aren't frequent come first, so a set with enough of them keeps none.
    """
    often = members.groupBy("token").agg(F.count("*").alias("often"))
    room = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + _k(F.col("n"), percent, False) - (F.col("n") - F.col("frequent"))
    some = counts.withColumn("room", room).filter("room > 0").select("sid", "room")
    order = Window.partitionBy("sid").orderBy("often", "token")
    ranked = members.join(some, "sid").join(often, "token").withColumn("place", F.row_number().over(order))
    return ranked.filter("place <= room").select("sid", "n", "token")


def _starred(frequent: DataFrame, turn: int, percent: int) -> DataFrame:
    """(u, v): each set with the one that this turn's hash puts first among the holders of a frequent token."""
    lead = frequent.groupBy("token").agg(F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("key"), "sid", "n")).alias("first"))
    pairs = frequent.join(lead, "token").filter("sid <> first.sid")
    pairs = pairs.select(F.least("sid", "first.sid").alias("u"), F.greatest("sid", "first.sid").alias("v"), F.least("n", "first.n").alias("m"), F.greatest("n", "first.n").alias("n"))
    return _enough(pairs, percent, False)


def _enough(pairs: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(u, v) of pairs that are first in an entry together for a fair part of their tokens."""
    counted = pairs.groupBy("u", "v", "m", "n").agg(F.count("*").alias("c")).filter(_long_enough(F.col("m"), F.col("n"), percent))
    return counted.filter(F.col("c") * 4 >= _k(F.least("m", "n"), percent, whole)).select("u", "v")


def _clustered(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    return rows.join(clusters.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _across(part: DataFrame, counts: DataFrame, clusters: DataFrame, known: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(u, v) of different clusters with a rare token in common that share enough tokens."""
    rows = part.filter("not frequent").select("token", F.explode(F.arrays_zip("sids", "ns")).alias("x")).select("token", F.col("x.sids").alias("sid"), F.col("x.ns").alias("n"))
    held = F.coalesce(F.col("frequent"), F.lit(0))
    rows = _clustered(rows.join(known, "sid", "left_semi").join(counts.select("sid", "frequent"), "sid", "left").withColumn("held", held), clusters)
    groups = rows.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("sid", "n", "root", "held"))).alias("g")).filter(  # at most RARE
        F.size(F.array_distinct(F.transform("g", lambda x: x["root"]))) > 1)
    pairs = groups.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b")).filter("a.root <> b.root")
    pairs = pairs.filter(_long_enough(F.col("a.n"), F.col("b.n"), percent))
    counted = pairs.groupBy(F.col("a.sid").alias("u"), F.col("b.sid").alias("v"), F.least("a.n", "b.n").alias("n"), F.greatest("a.n", "b.n").alias("m"),
                            F.least("a.held", "b.held").alias("held")).agg(F.count("*").alias("c"))
    need = _k(F.col("m"), percent, True) if whole else F.least(_k(F.col("n"), percent, False), _k(F.col("m"), percent, True))
    return counted.filter(F.col("c") + F.col("held") >= need).select("u", "v")


def _tiled(frequent: DataFrame, clusters: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between different clusters of sets that share frequent tokens of their prefixes.

    Sets that hang together over such tokens are one family. A family is cut into blocks of about ``TILE`` tokens, a large cluster in blocks of its own; two
    blocks are one tile, unless both are of the same cluster. A tile's overlaps are one product of 0/1 matrices over the tokens that both blocks have, so
    what Spark moves is blocks, and what comes out is links only.
    """
    lead = frequent.groupBy("token").agg(F.min("sid").alias("first"))
    edges = frequent.join(lead, "token").filter("sid <> first").select(F.col("sid").alias("u"), F.col("first").alias("v"))
    families = components(edges).select(F.col("node").alias("sid"), F.col("root").alias("family"))
    sets = stored(_clustered(frequent.select("sid", "n").distinct().join(families, "sid"), clusters), "families")
    several = sets.groupBy("family").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("family")
    sets = sets.join(several, "family", "left_semi")
    totals = sets.groupBy("family", "root").agg(F.sum("n").alias("tokens"))
    homes = stored(totals.withColumn("home", F.when(F.col("tokens") * 2 >= TILE, F.col("root"))), "homes")
    parts = homes.groupBy("family", "home").agg(F.ceil(F.sum("tokens") / TILE).alias("parts"))
    placed = match(sets.join(homes.select("family", "root", "home"), ["family", "root"]), parts, ["family", "home"])
    block = F.xxhash64("family", F.col("home").isNull(), F.coalesce("home", F.lit(0)), F.pmod(F.xxhash64("sid"), F.col("parts")))
    placed = stored(placed.select("family", "home", "sid", "root", block.alias("block")), "placed")
    heads = placed.select("family", "home", "block").distinct()
    a, b = heads.alias("a"), heads.alias("b")
    tiles = stored(a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.block") <= F.col("b.block")) & F.coalesce(F.col("a.home") != F.col("b.home"), F.lit(True))).select(
        F.col("a.block").alias("left"), F.col("b.block").alias("right")), "tiles")
    held = stored(placed.join(texts, "sid").groupBy("block").agg(F.collect_list(F.struct("sid", "root", "text")).alias("rows")), "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("left")[i].as_py() == batch.column("right")[i].as_py()
                u, v = _tile(batch.column("a")[i].as_py(), batch.column("b")[i].as_py(), same, percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    full = tiles.join(held.select(F.col("block").alias("left"), F.col("rows").alias("a")), "left").join(held.select(F.col("block").alias("right"), F.col("rows").alias("b")), "right")
    return full.select("left", "right", "a", "b").mapInArrow(run, "u long, v long").distinct()


def _tile(left: list[dict], right: list[dict], same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different clusters, one set from either side."""
    a, b = (token_sets([r["text"].encode() for r in rows]) for rows in (left, right))
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    overlap = np.zeros((len(a), len(b)), dtype=np.float32)
    places = [[_common(s, both) for s in side] for side in (a, b)]
    for low in range(0, len(both), COLUMNS):
        dense = []
        for side in places:
            m = np.zeros((len(side), min(COLUMNS, len(both) - low)), dtype=np.float32)
            for i, p in enumerate(side):
                m[i, p[np.searchsorted(p, low):np.searchsorted(p, low + COLUMNS)] - low] = 1.0
            dense.append(m)
        overlap += dense[0] @ dense[1].T
    n, m = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    shared = overlap.astype(np.int64)
    roots = np.array([r["root"] for r in left])[:, None] != np.array([r["root"] for r in right])[None, :]
    linked = roots & (100 * shared >= percent * (n[:, None] + m[None, :] - shared))
    if same:
        linked &= np.triu(np.ones(linked.shape, dtype=bool), 1)
    i, j = np.nonzero(linked)
    return np.array([r["sid"] for r in left], dtype=np.int64)[i], np.array([r["sid"] for r in right], dtype=np.int64)[j]


def _common(tokens: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Places in ``both`` of the tokens that it holds; both are sorted."""
    if not len(both):
        return np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
    return at[both[at] == tokens]


def classes_of(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) from (doc_id, n, sid) and the (node, root) of linked sets."""
    named = sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = named.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(named.select("sid", "root").join(least, "root").select("sid", "component_id"), "classes")
    return sets.join(classes, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similarity_classes(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the set's size and the smallest id reachable by links."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    sets = stored(documents_sets(rows, percent), "sets")
    roots = near_sets(rows, percent)
    return classes_of(sets, roots)


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their class, with all their columns: of each group of near copies the one with the smallest id. Rows that share an id stay together."""
    named = similarity_classes(docs, percent, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(named, docs[id_col].eqNullSafe(named["_kept"]), "left_semi")
