import bisect
import gzip
import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np

from feaslens.llm import graph, neighbours, ngram_join, substrings, warc
from tests.llm.helpers import ODD, docs, prose, shingles, sorted_rows, words


def classes(rows, percent=75):
    """component_id by comparing every pair of sets."""
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    sets = [shingles(r[1]) for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(j)] = find(i)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    smallest = {root: min((x for x in ids if x is not None), default=None) for root, ids in least.items()}
    return sorted_rows((r[0], len(s), smallest[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def near_tables():
    r = random.Random(11)
    passage, rows = prose(1, 70), list(ODD)
    for family in range(4):
        base = prose(100 + family, 60 + 40 * family)
        rows += [(1000 * family + 100 + i, edited(base, (0.0, 0.01, 0.02, 0.04)[i % 4], i), "en", "s") for i in range(40)]
    rows += [(9000 + i, prose(500 + i, 30) + " " + passage + " " + prose(700 + i, 40), "en", "s") for i in range(40)]
    rows += [(9500 + i, passage + (f" w{i}" if i % 2 else ""), "en", "s") for i in range(6)] + [(9600 + i, "short text", "en", "s") for i in range(3)]
    r.shuffle(rows)
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows = near_tables()
    got = ngram_join.similarity_classes(docs(spark, rows)).collect()
    assert sorted_rows((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got) == classes(rows)


def test_classes_when_everything_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 3)
    rows = near_tables()
    for percent in (75, 50):
        got = ngram_join.similarity_classes(docs(spark, rows), percent).collect()
        assert sorted_rows((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got) == classes(rows, percent)


def test_one_document_of_each_group_stays(spark):
    rows = near_tables()
    kept = ngram_join.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    want = sorted_rows((i,) for i, _, c in classes(rows) if i == c)
    assert sorted_rows((r["doc_id"],) for r in kept.collect()) == want
    assert ngram_join.one_of_each(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def nearest_plain(rows, queries, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q in {i for i, v in ok if i in queries}:
        vector = next(v for i, v in ok if i == q)
        found = sorted((math.sqrt(sum((b - a) ** 2 for a, b in zip(vector, v))), i) for i, v in ok if i != q and len(v) == len(vector))[:k]
        out |= {(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(found)}
    return out


def test_neighbours_are_those_of_all_distances(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "GRID_QUERIES", 8)
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, list(rows[0][1])) for i in range(40)]  # ties
    rows += [(500, None), (510, []), (520, [0.0] * 8), (530, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (560, [1.0] * 3), (570, [2.0] * 3),
             (580, [1e-30] * 8), (590, [1e20] + [0.0] * 7)]
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, vector int")
    got = neighbours.nearest(table, table.filter("vec_id % 10 = 0"), 5).collect()
    assert {(g["query_id"], g["rank"], g["vec_id"], round(g["score"], 9)) for g in got} == nearest_plain(rows, queries, 5)
    assert neighbours.nearest(table.limit(0), table.limit(0), 5).count() == 0


def test_int8_bounds_hold():
    r = np.random.default_rng(3)
    m = r.normal(size=(50, 16)) * 10.0 ** r.integers(-3, 4, (50, 1))
    values, scale, error = neighbours._quantised(m)
    assert (np.sqrt(((m - values * scale[:, None]) ** 2).sum(axis=1)) <= error).all()


def test_chain_scores_are_those_of_all_predecessors():
    r = random.Random(9)
    for _ in range(40):
        points = sorted({(r.randrange(200), r.randrange(200)) for _ in range(30)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        for chain in substrings.chains(x, y):
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))
    x, y = list(range(0, 100, 10)) + [500], list(range(300, 400, 10)) + [20]
    assert substrings.chains(x, y) == [list(range(10))]


def share_a_run(rows, n):
    held = defaultdict(set)
    for i, text, _, _ in rows:
        w = words(text)
        for k in range(len(w) - n + 1):
            held[tuple(w[k:k + n])].add(i)
    return set().union(*[s for s in held.values() if len(s) > 1] or [set()])


def test_planted_passages_are_found(spark):
    passage, fuzzy = prose(21, 60), prose(22, 120)
    rows = [r for r in ODD if r[0] not in (6,)]
    rows += [(100 + i, prose(2000 + i, 40 + i) + " " + passage + " " + prose(3000 + i, 50), "en", "s") for i in range(80)]
    rows += [(300 + i, prose(4000 + i, 30) + " " + edited(fuzzy, 0.05, i) + " " + prose(5000 + i, 70), "en", "s") for i in range(6)]
    rows += [(400 + i, prose(6000 + i, 200), "en", "s") for i in range(40)] + [(500, rows[-1][1], "en", "s"), (501, prose(6000, 200), "en", "s"), (None, prose(6001, 200), "en", "s")]
    rows += [(600, "to " * 70, "en", "s"), (601, "x y to " + "to " * 60, "en", "s")]
    got = substrings.repeated_passages(docs(spark, rows)).collect()
    texts = {r[0]: words(r[1]) for r in rows}
    hit = {g["doc_id"] for g in got} | {g["source_id"] for g in got}
    assert share_a_run(rows, 50) <= hit
    assert {300 + i for i in range(6)} <= hit
    assert not hit & {402 + i for i in range(30)}
    for g in got:
        assert g["end"] - g["start"] >= 50 and g["source_end"] - g["source_start"] >= 50 and g["end"] <= len(texts[g["doc_id"]])
        a, b = texts[g["doc_id"]][g["start"]:g["end"]], texts[g["source_id"]][g["source_start"]:g["source_end"]]
        if len(a) == len(b):
            assert sum(p == q for p, q in zip(a, b)) <= g["equal_words"] + 1 or g["equal_words"] >= 0.8 * len(a)
    exact = [g for g in got if 100 <= (g["doc_id"] or 0) < 180]
    assert all(" ".join(texts[g["doc_id"]][g["start"]:g["end"]]).find(passage) >= 0 for g in exact)
    assert substrings.repeated_passages(docs(spark, [])).count() == 0


def test_passages_of_frequent_parts_are_found(spark):
    parts = [prose(31 + i, 18) for i in range(3)]
    rows = [(i, " ".join([prose(7000 + i, 30), *parts, prose(7100 + i, 30)]), "en", "s") for i in (1, 2)]
    two = ["".join(f"{p} " for p in parts[:2]), "".join(f"{p} " for p in parts[1:]), f"{parts[0]} ", f"{parts[2]} "]
    rows += [(10 + i, f"{prose(7200 + i, 40)} {two[i % 4]}{prose(7400 + i, 40)}", "en", "s") for i in range(160)]
    got = substrings.repeated_passages(docs(spark, rows)).collect()
    assert share_a_run(rows, 50) == {1, 2}
    assert {(g["doc_id"], g["source_id"], g["start"], g["end"]) for g in got} == {(2, 1, 30, 84)}


def test_passages_with_replaced_words_are_found(spark):
    r, rows, pairs = random.Random(5), [], []
    for n in range(120):
        size, every = r.randrange(50, 81), (5, 10, 0)[n % 3]
        passage = prose(8000 + n, size).split()
        inside = range(3, size - 3)
        places = set(inside[::every]) if every else set(r.sample(inside, r.randrange(size // 10, size // 5 + 1)))
        copy = [f"e{n}x{i}" if i in places else w for i, w in enumerate(passage)]
        for side, words_ in enumerate((passage, copy)):
            rows.append((2 * n + side, " ".join([prose(20_000 + 2 * n + side, 40), *words_, prose(30_000 + 2 * n + side, 40)]), "en", "s"))
        pairs.append((2 * n + 1, 2 * n))
    texts = {i: words(t) for i, t, _, _ in rows}
    # By brute force: every pair has 50 or more words in a row with four fifths of them equal.
    for a, b in pairs:
        same = [p == q for p, q in zip(texts[a][40:], texts[b][40:])]
        assert any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + 50, len(same) - 39))
    got = {(g["doc_id"], g["source_id"]) for g in substrings.repeated_passages(docs(spark, rows)).collect()}
    missing = set(pairs) - got
    assert not missing, (len(missing), sorted(missing))


PAGES = "page_id long, url string, html string, size int, digest string, holder long"


def plain_pages(rows):
    import base64
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        best = max((j for j, _, h in rows if (h or "").encode() == data and j is not None), default=None)
        again = best is not None and (i is None or i < best)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted_rows(out)


def test_archives_come_back(spark):
    rows = [(i, f"http://a/{i}", f"<p>page é {i % 7}</p>") for i in range(60)] + [(100, None, None), (101, "u v\r\n", ""), (102, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (None, "u", "x"), (None, "u", "y" * 70_000),
                                                                                   (103, "u", "x"), (104, "u", "same"), (104, "v", "same")]
    pages = spark.createDataFrame([(*r, 1, "d", 5) for r in rows], PAGES)
    got = warc.round_trip(pages)
    assert got.filter("kind = 'gap'").count() == 0
    assert sorted_rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == plain_pages(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(n=12):
    records = []
    for i in range(n):
        html = f"<p>{i}</p>".encode() * (i + 1)
        import base64
        block = warc.HEAD.encode() + html
        records.append(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (
            i, base64.b32encode(hashlib.sha1(html).digest()), len(block)) + block + b"\r\n\r\n")
    return records


def check_salvage(data, want):
    parts = list(warc.salvage(data))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert [p[3]["page_id"] for p in parts if p[3]] == want
    return [p for p in parts if p[3] is None]


def test_damaged_archives_give_all_later_records():
    records = archive()
    check_salvage(b"".join(records), list(range(12)))
    ends = list(itertools.accumulate(map(len, records)))
    r = random.Random(3)
    for _ in range(300):
        data = bytearray(b"".join(records))
        at = r.randrange(len(data))
        data[at] ^= 1 << r.randrange(8)
        hit = bisect.bisect_right(ends, at)
        parts = [p[3]["page_id"] for p in warc.salvage(bytes(data)) if p[3]]
        assert set(range(12)) - {hit} <= set(parts)
    gaps = check_salvage(records[0] + b"junk" + records[1] + records[2][:-30] + records[3], [0, 1, 3])
    assert [g[2] for g in gaps] == ["version", "end"]
    long = records[2].replace(b"Content-Length: ", b"Content-Length: 9")
    check_salvage(records[0] + long + b"".join(records[3:]), [0, *range(3, 12)])
    assert list(warc.salvage(b"")) == []


def test_damaged_members_are_skipped():
    members = [gzip.compress(r) for r in archive(6)]
    check_salvage(b"".join(members), list(range(6)))
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    gaps = check_salvage(b"".join(members[:2]) + bytes(broken) + b"".join(members[3:]), [0, 1, 3, 4, 5])
    assert [g[2] for g in gaps] == ["member"]
    check_salvage(b"".join(members)[:-5], [0, 1, 2, 3, 4])


def test_damage_to_the_first_bytes_of_an_archive():
    records = archive()
    large = random.Random(3).randbytes(9000).hex().encode()
    block = warc.HEAD.encode() + large
    first = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    members = [gzip.compress(r) for r in [first, *records]]
    for at in range(3):
        data = bytearray(b"".join(members))
        data[at] ^= 0xFF
        gaps = check_salvage(bytes(data), list(range(12)))
        assert [(g[0], g[1]) for g in gaps] == [(0, len(members[0]))]
    body = warc.HEAD.encode() + gzip.compress(b"a body")
    packed = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:98>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    gaps = check_salvage(b"X" + packed[1:] + b"".join(records), list(range(12)))
    assert [(g[0], g[1]) for g in gaps] == [(0, len(packed))]
    check_salvage(records[0] + members[2] + records[2], [0, 1, 2])
