"""The source audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feaslens.llm import divergence
from tests.llm.helpers import LOWER, ODD, docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, ranks):
    words, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = TERM.findall((text or "").translate(LOWER))
        words[key].update(found)
        seen[key[0]].update(set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        mine = sorted(s for g, s in groups if g == lang)
        counts = {s: {t: words[lang, s][t] for t in kept} for s in mine}
        counts[None] = {t: sum(counts[s][t] for s in mine) for t in kept}
        share = {s: {t: 1 + 10**9 * (c + 5) // (sum(v.values()) + 5 * len(kept)) for t, c in v.items()} for s, v in counts.items()}
        for s in mine:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(share[s][t] - share[None][t], t) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, ranks)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda p: (-p[0], p[1].encode()))[:top], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out, key=repr)


def table(n, sources, seed, vocabulary=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.randrange(sources) if i % 3 else 0  # a third of the rows from one source
        text = " ".join(f"W{chr(97 + int(r.paretovariate(0.7) + s) % 26)}{chr(97 + r.randrange(vocabulary) % 26)}é{r.choice('.,! 1_')}" for _ in range(r.randrange(30)))
        rows.append((i, text, r.choice(["en", "en", "de"]), f"s{s}"))
    return rows


def check(spark, rows, least, ranks):
    got = divergence.audit(docs(spark, rows), least, ranks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, least, ranks)


def test_whole_result(spark):
    check(spark, table(600, 7, 1), 20, 5)


def test_small_blocks_and_tiles_and_early_hand_over(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 8)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "TOKENS", 50)
    check(spark, table(400, 11, 2), 4, 6)


def test_odd_rows(spark):
    many = [(i, "tie one two", None, None if i % 2 else "b") for i in range(6)]
    check(spark, ODD + many, 3, 50)
    check(spark, ODD, 1, 50)
    check(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "12 34", "en", "b")], 1, 50)
    assert divergence.audit(docs(spark, [])).collect() == []


def test_long_text_goes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 100)
    check(spark, [(1, "aa bb cc dd " * 500, "en", "a"), (2, "aa " + "x" * 5000, "en", "b")], 1, 50)


def test_equal_subtrees_are_one_node_and_a_pair_is_priced_once():
    counts = np.zeros((3, 16), dtype=np.int64)
    counts[0, 0] = counts[1, 8] = 4
    trees = divergence.Trees(counts)
    assert [len(left) for left, _ in trees.children] == [2, 2, 2, 3]  # of 24, 12, 6 and 3 places
    walk = divergence.Walk(trees, np.array([0, 0, 1]), np.array([1, 2, 2]), np.zeros(3, dtype=np.int64))
    a, _, b, _ = walk.leaves
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 4), (4, 0)]
    assert walk.fold(abs(a - b), np.add)[0][walk.places[0]].tolist() == [8, 4, 4]


def test_shares_are_exact_at_any_count():
    big = np.array([0, 10**12, 10**13 + 7])
    total = np.array([10**14 + 3] * 3)
    assert divergence._shares(big, total).tolist() == [1 + 10**9 * (int(c) + 5) // (10**14 + 3) for c in big]


@pytest.mark.parametrize("seed", range(3))
def test_first_terms_of_a_pair(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 4, (4, 64))
    trees = divergence.Trees(counts)
    walk = divergence.Walk(trees, np.arange(3), np.full(3, 3), np.arange(4))
    a, _, b, _ = walk.leaves
    prices = walk.fold(np.where(a > 0, a - b, -1), np.maximum)
    for i in range(3):
        leaf, value = divergence._first(walk, prices, i, 5)
        want = np.where(counts[i] > 0, counts[i] - counts[3], -1)
        cut = max(1, np.sort(want)[-5])
        assert sorted(zip(leaf.tolist(), value.tolist())) == [(k, int(v)) for k, v in enumerate(want) if v >= cut]
