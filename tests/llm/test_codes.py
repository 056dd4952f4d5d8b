"""Vector codes against plain rounds over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from feaslens.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error long, share int, slot int, v long"


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1, 2, 3, 4) for i, e, label in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """Rows of (vec_id, label, code, error, label_error), and the digest."""
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    length = -(-max((len(e) for _, e, _ in kept), default=0) // parts) * parts
    w = length // parts
    whole = lambda x: math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256
    vectors = [[whole(x) for x in e] + [0] * (length - len(e)) for _, e, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[vectors[k][p * w:(p + 1) * w] for k in first] for p in range(parts)]
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in vectors]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (d(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, b in zip(cut, best) if b[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    best = assign() if kept else []
    errors = [min(sum(d(v[p], books[p][b[p]]) for p in range(parts)), codes.LARGEST) for v, b in zip(cut, best)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    text = ",".join(str(x) for book in books for row in book for x in row)
    return [(i, label, "".join(f"{x:02x}" for x in b), e, min(by_label[label], codes.LARGEST)) for (i, _, label), b, e in zip(kept, best, errors)], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, parts=4, entries=8, rounds=2):
    want, digest = plain(rows, parts, entries, rounds)
    got = codes.compress(table(spark, rows), parts, entries, rounds).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.codebooks_sha256 == digest for r in got)


def vectors(n, width, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 3) for _ in range(width)] for _ in range(12)]
    return [(i * 7 % n, [c + r.gauss(0, spread) for c in r.choice(centres)], r.choice(["a", "a", "b", None])) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_rounds_are_exact(spark, spread):
    check(spark, vectors(900, 16, 4, spread))


def test_odd_rows(spark):
    rows = vectors(40, 8, 2)
    odd = [(None, [1.0] * 8, "a"), (3, None, "a"), (4, [None] + [1.0] * 7, "b"), (5, [float("nan")] * 8, "b"), (6, [float("inf")] * 8, None),
           (7, [], "c"), (8, [0.5] * 5, None), (9, [-0.001] * 8, "c"), (9, [-0.001] * 8, "c"), (9, [0.001] * 8, "c"), (None, [-1.0] * 8, None)]
    check(spark, rows + odd, entries=16)
    check(spark, odd, entries=64)
    check(spark, [(1, [0.25, 1.5], "a"), (1, [0.25, 1.5], "a")], entries=64)
    check(spark, [(1, [], "a"), (None, [], None)])
    empty = codes.compress(table(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(table(spark, [(1, None, "a")])).collect() == []


def test_huge_components(spark):
    check(spark, vectors(30, 8, 3) + [(100, [1e308, -1e308, 1e20, 3.5, 1e9, -1e9, 0.0, 1e5], "big"), (101, [1e307] * 8, "big"), (2, [2e6] * 8, None)], entries=4)


@pytest.mark.parametrize("n,k,width", [(1, 1, 1), (23, 5, 2), (500, 64, 3), (3000, 37, 4), (700, 8, 40)])
def test_trees_give_the_nearest_entry(n, k, width):
    r = np.random.default_rng(n)
    x = r.integers(-900, 900, (n, width)) if width != 3 else r.integers(-3, 3, (n, width))
    entries = x[r.integers(0, n, k)] if n > k else r.integers(-900, 900, (k, width))
    order, stats = codes._tree(x, codes.LEAF)
    best, whole = codes.Book(entries).assign(x[order], stats)
    want = ((x[order][:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (best == want).all()
    for a, b, e, s in whole:
        assert (best[a:b] == e).all() and (x[order][a:b].sum(axis=0) == s).all()


def test_far_clusters_are_assigned_whole():
    r = np.random.default_rng(1)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    x = centres[r.integers(0, 4, 4000)] + r.integers(-50, 50, (4000, 2))
    order, stats = codes._tree(x, codes.LEAF)
    best, whole = codes.Book(centres).assign(x[order], stats)
    assert sum(b - a for a, b, _, _ in whole) > 3500 and (best == ((x[order][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_query_over_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, digest = plain([(r.vec_id, r.embedding, r.label) for r in rows], 16, 64, 2)
    got = queries.QUERIES["op11_vector_codes"](spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, le) for i, _, c, e, le in want)
    assert {r.codebooks_sha256 for r in got} == {digest}
