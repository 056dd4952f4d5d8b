"""Nearest partners by a k-d tree: a top tree over a sample deals points to leaves, a halving tree inside a leaf is searched by all its queries at once.

The top tree is made from a bounded sample picked by hash, so it is the same after a retry and holds at most ``LEAVES`` leaves. Every query first
visits the leaf whose box is nearest; the distance found there is its bound, and it goes on only to the leaves whose boxes are no farther. A leaf
with many queries is visited in shares. Box distances are rounded the same way as point distances and never exceed them, so the result is exact and
ties are seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feaslens.session import checkpointed

#: Points of a leaf aimed at, most leaves of the top tree, sampled points a leaf, points of an inner leaf, queries of a share, queries searched at a time.
LEAF_POINTS = 4096
LEAVES = 4096
SAMPLED = 16
INNER = 12
SHARE = 1 << 16
TOGETHER = 1 << 13


def split_planes(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, value, left, right) of a tree whose leaves -1, -2, … hold about equal parts of the sample; values up to ``value`` go left."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(points: np.ndarray, parts: int) -> int:
        nonlocal count
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        dim = int(spread.argmax())
        if parts <= 1 or not spread[dim] > 0:
            count += 1
            return -count
        line = np.sort(points[:, dim])
        value = float(line[(len(line) - 1) // 2])
        if value == line[-1]:
            value = float(line[np.searchsorted(line, value) - 1])
        at = len(nodes)
        nodes.append((dim, value, 0, 0))
        low = points[:, dim] <= value
        nodes[at] = dim, value, grow(points[low], parts // 2), grow(points[~low], parts - parts // 2)
        return at

    grow(sample, leaves)
    return nodes


def leaf_of(x: np.ndarray, nodes: Sequence[tuple[int, float, int, int]]) -> np.ndarray:
    """Leaf 0, 1, … of each point."""
    out = np.zeros(len(x), dtype=np.int32)
    todo = [(0 if nodes else -1, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -at - 1
        else:
            dim, value, left, right = nodes[at]
            low = x[rows, dim] <= value
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def box_gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far boxes lie outside points, per dimension, as the distance to a point at the near face would be rounded."""
    return np.maximum(np.maximum(low - q, q - high), 0.0)


def _squared(gaps: np.ndarray) -> np.ndarray:
    """Sums of squares in the order of the dimensions."""
    out = gaps[..., 0] * gaps[..., 0]
    for i in range(1, gaps.shape[-1]):
        out = out + gaps[..., i] * gaps[..., i]
    return out


class HalvingTree:
    """Points in the order of a tree that is halved at the widest side; level k has 2^k nodes."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.order, self.starts, self.low, self.high = np.arange(n), [np.array([0, n])], [], []
        while True:
            starts = self.starts[-1]
            y, s = x[self.order], starts[:-1]
            low, high = np.minimum.reduceat(y, s, axis=0), np.maximum.reduceat(y, s, axis=0)
            self.low.append(low)
            self.high.append(high)
            if n >> (len(self.starts) - 1) <= INNER:
                break
            node = np.repeat(np.arange(len(s)), np.diff(starts))
            side = np.argmax(high - low, axis=1)[node]
            self.order = self.order[np.lexsort((y[np.arange(n), side], node))]
            self.starts.append(np.append(np.stack([s, (s + starts[1:]) // 2], axis=1).ravel(), n))
        self.points = x[self.order]

    def nearest(self, q: np.ndarray, bound: np.ndarray, rank: np.ndarray, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query the squared distance (infinite: none within the bound) and place of its nearest point, ties to the lower ``rank``, and how many points it met."""
        query, node = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
        bound = bound.copy()
        last = len(self.starts) - 1
        for level in range(last + 1):
            gaps = box_gaps(q[query], self.low[level][node], self.high[level][node])
            keep = _squared(gaps) <= bound[query]
            if limit is not None:
                keep &= (gaps <= limit).all(axis=1)
            query, node = query[keep], node[keep]
            if level < last:
                # A point of each node lowers the bound.
                gaps = self.points[(self.starts[level][node] + self.starts[level][node + 1]) // 2] - q[query]
                d2 = _squared(gaps)
                fits = np.isfinite(d2) if limit is None else (np.abs(gaps) <= limit).all(axis=1)
                np.minimum.at(bound, query[fits], d2[fits])
                query, node = np.repeat(query, 2), np.stack([node * 2, node * 2 + 1], axis=1).ravel()
        best, place, met = np.full(len(q), np.inf), np.full(len(q), -1), np.zeros(len(q), dtype=np.int64)
        first = self.starts[-1][node]
        size = self.starts[-1][node + 1] - first
        point = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        query = np.repeat(query, size)
        met += np.bincount(query, minlength=len(q))
        gaps = self.points[point] - q[query]
        d2 = _squared(gaps)
        keep = d2 <= bound[query]
        if limit is not None:
            keep &= (np.abs(gaps) <= limit).all(axis=1)
        query, point, d2 = query[keep], self.order[point[keep]], d2[keep]
        by = np.lexsort((rank[point], d2, query))
        query, point, d2 = query[by], point[by], d2[by]
        heads = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, dtype=np.int64)
        best[query[heads]], place[query[heads]] = d2[heads], point[heads]
        return best, place, met


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _search(dims: int, limit: float | None):
    def run(table: pa.Table) -> pa.Table:
        """One leaf's partners and a share of its queries."""
        partner = table.filter(pc.is_valid(table.column("nid")))
        partner = partner.take(pc.sort_indices(partner.column("nid")))
        query = table.filter(pc.is_null(table.column("nid")))
        x, q = matrix(partner.column("v"), dims), matrix(query.column("v"), dims)
        bound = query.column("bound").to_numpy()
        best, place, met = np.full(len(q), np.inf), np.full(len(q), -1), np.zeros(len(q), dtype=np.int64)
        if len(x):
            tree, rank = HalvingTree(x), np.arange(len(x))
            for a in range(0, len(q), TOGETHER):
                s = slice(a, a + TOGETHER)
                best[s], place[s], met[s] = tree.nearest(q[s], bound[s], rank, limit)
        found = place >= 0
        return pa.table({"v": query.column("v"), "d2": pa.array(best, mask=~found), "nid": partner.column("nid").take(pa.array(place, mask=~found)), "met": met})
    return run


def _dealt(dims: int, nodes):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(matrix(batch.column("v"), dims), nodes))], names=[*batch.schema.names, "leaf"])
    return run


def _visits(dims: int, leaves: np.ndarray, low: np.ndarray, high: np.ndarray, limit: float | None, first: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        """The leaf with the nearest box for a query without bound; for one that has been there, the other leaves within its bound."""
        for batch in batches:
            for a in range(0, batch.num_rows, max(1, (1 << 20) // len(leaves))):
                part = batch.slice(a, max(1, (1 << 20) // len(leaves)))
                q = matrix(part.column("v"), dims)
                gaps = box_gaps(q[:, None], low, high)
                d2 = _squared(gaps)
                home = d2.argmin(axis=1)
                if first:
                    row, leaf, bound = np.arange(len(q)), home, np.full(len(q), np.inf)
                else:
                    bound = pc.fill_null(part.column("d2"), np.inf).to_numpy(zero_copy_only=False)
                    open_ = d2 <= bound[:, None]
                    if limit is not None:
                        open_ &= (gaps <= limit).all(axis=2)
                    open_[np.arange(len(q)), home] = False
                    row, leaf = np.nonzero(open_)
                    bound = bound[row]
                yield pa.RecordBatch.from_arrays([part.column("v").take(pa.array(row)), pa.array(bound), pa.array(leaves[leaf])], names=["v", "bound", "leaf"])
    return run


def nearest(queries: DataFrame, partners: DataFrame, dims: int, limit: float | None = None) -> DataFrame:
    """Nearest partner (``v``, ``nid``) of each query vector ``v`` as ``best`` (``d2``, ``nid``), ties to the smaller ``nid``, with ``met``, the partners it was compared with.

    Vectors are distinct on either side. Under a ``limit`` no dimension may differ by more; queries without such a partner have a null ``best``.
    """
    kind = partners.schema["nid"].dataType.simpleString()
    partners = checkpointed(partners.select("v", "nid"))
    n = partners.count()
    if not n:
        return queries.select("v", F.lit(None).cast(f"struct<d2:double,nid:{kind}>").alias("best"), F.lit(0).cast("bigint").alias("met"))
    leaves = min(LEAVES, -(-n // LEAF_POINTS))
    sample = partners.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLED * leaves).collect()
    nodes = split_planes(np.array([r.v for r in sample]), leaves)
    placed = checkpointed(partners.mapInArrow(_dealt(dims, nodes), f"v array<double>, nid {kind}, leaf int"))
    # One row a leaf, LEAVES at most.
    boxes = placed.groupBy("leaf").agg(*[f(F.col("v")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dims)]).orderBy("leaf").collect()
    names = np.array([r.leaf for r in boxes], dtype=np.int32)
    low, high = (np.array([[r[f"{f}{i}"] for i in range(dims)] for r in boxes]) for f in ("min", "max"))

    def visit(rows: DataFrame, first: bool) -> DataFrame:
        visits = checkpointed(rows.mapInArrow(_visits(dims, names, low, high, limit, first), "v array<double>, bound double, leaf int"))
        shares = visits.groupBy("leaf").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
        asked = visits.join(F.broadcast(shares), "leaf").withColumn("share", F.pmod(F.xxhash64("v"), F.col("shares")))
        there = placed.join(F.broadcast(shares), "leaf").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
        both = asked.select("leaf", "share", "v", "bound").unionByName(there.select("leaf", "share", "v", "nid"), allowMissingColumns=True)
        return both.groupBy("leaf", "share").applyInArrow(_search(dims, limit), f"v array<double>, d2 double, nid {kind}, met bigint")

    home = checkpointed(visit(queries.select("v"), True))
    found = home.unionByName(visit(home.select("v", "d2"), False))
    best = F.min(F.when(F.col("d2").isNotNull(), F.struct("d2", "nid")))
    return found.groupBy("v").agg(best.alias("best"), F.sum("met").alias("met"))
