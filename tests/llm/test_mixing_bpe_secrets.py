import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken

from feaslens.llm import bpe, mixing, secrets
from tests.llm.helpers import ODD, docs, prose, sorted_rows, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The excess shared again by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        whole = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / whole >= cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / whole for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_its_targets(spark):
    rows = ODD + [(100 + i, prose(i, 5 + i % 40), "en", f"s{i % 5}") for i in range(200)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = targets(sizes)
    for source, target in want.items():
        own = [r for r in got if r["source"] == source]
        assert abs(own[0]["target"] - target) < 1e-6 and own[0]["source_size"] == sizes[source]
        assert abs(sum(r["taken"] for r in own) - target) <= 0.5
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted_rows(got) == sorted_rows(mixing.mix(docs(spark, rows), buckets=3).collect())


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, f"  {prose(i, 3 + i % 30)}\n end{i} ", "en", f"s{i % 3}") for i in range(90)] + [(None, "no id", "en", "s0"), (95, None, "en", "s1")]
    table = docs(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(table).collect()}
    got = mixing.mixed_documents(table).collect()
    counts = {}
    for r in got:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert dict((i, t) for i, t, _, _ in rows)[r["doc_id"]].startswith(r["text"])
    assert counts == {k: v for k, v in taken.items() if v}


def test_empty_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, None, None)])).collect()] == [0]


def test_encoding_is_that_of_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY[0], "rb"))}
    plain = tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    made = [(1000 + i, "".join(r.choice(letters) for _ in range(r.randint(0, 200))), "en", "s") for letters in ("a", "ab", "aA1 ", " \n\t", "the an", "0123456789", "é漢字x", "=-_*", "qwertyuiop")
            for i in range(60)]
    rows = ODD + made + [(5000, "".join(r.choice("abcdefgh") for _ in range(40_000)), "en", "s"), (5001, "<|endoftext|>", "en", "s")]
    got = bpe.decode(bpe.encode(docs(spark, rows), *VOCABULARY), *VOCABULARY).collect()
    want = [(i, plain.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, _, _ in rows]
    assert sorted_rows((r["doc_id"], list(r["ids"]), bytearray(r["decoded"])) for r in got) == sorted_rows(want)


def test_pieces_are_forgotten_without_changing_ids(monkeypatch):
    lines = open(VOCABULARY[0], "rb").read()
    texts = [prose(i, 300) for i in range(20)]
    whole = bpe.Codec(lines, VOCABULARY[1]).encode(texts)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 10)
    monkeypatch.setattr(bpe, "MERGED", 50)
    codec = bpe.Codec(lines, VOCABULARY[1])
    assert [i for t in texts for i in codec.encode([t])[0].tolist()] == whole[0].tolist()


def test_queue_gives_the_lowest_rank(spark):
    queue, r, want = bpe.RankQueue(50_257), random.Random(2), {}
    for i in range(3000):
        rank = r.randrange(50_257)
        queue.push(rank, bpe.np.array([i]))
        want.setdefault(rank, []).append(i)
    while want:
        rank, positions = queue.pop()
        assert rank == min(want) and positions.tolist() == want.pop(rank)
    assert not queue.buckets and not any(any(level) for level in queue.levels)


def plain_spans(text):
    out = []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    for i, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24))):
        out += [(m.start(), i + 1, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return sorted(out)


SECRETS = [
    "password = 'hunter22' and token: abc", "secret:token:abcdefg", "API_KEY==abc123456 apikey=\"x/y+z=1\"", "é😀 AKIA" + "A1" * 8 + " tail", "AKIAAKIA" + "B" * 20, "AKIA" + "A" * 15,
    "deadbeef" * 3, "deadbeef" * 3 + "g" + "0" * 24, "Secret : " + "ab12" * 8, "token=" * 3 + "zzzzzz", "PASSWD=\n123456", "ghp_" + "a1" * 18, "x" * 5000 + " token=abcdef " * 200,
]


def test_spans_are_those_of_a_plain_search(spark):
    rows = ODD + [(100 + i, t, "en", "s") for i, t in enumerate(SECRETS)] + [(200 + i, SECRETS[0], "en", "s") for i in range(30)]
    got = secrets.scan_report(docs(spark, rows)).collect()
    want = []
    for i, text, _, _ in rows:
        spans = plain_spans(text)
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((i, *[sum(k == x for _, _, x, _ in spans) for k in ("assign", "access", "hex")], hashlib.sha256(base.encode()).hexdigest()))
    assert sorted_rows((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == sorted_rows(want)
    assert any("forge:" in r["spans"] for r in got)


def test_ledger_scans_only_what_is_new(spark):
    first = docs(spark, [(1, SECRETS[0], "en", "s"), (2, "clean", "en", "s")])
    _, found, ledger = secrets.scan(first)
    assert ledger.count() == 2 * len(secrets.RULES)
    # The same blobs give no work: their findings come from the last run alone, here an empty one.
    _, again, _ = secrets.scan(first, ledger=ledger, known=found.limit(0))
    assert again.count() == 0
    later = docs(spark, [(1, SECRETS[0], "en", "s"), (3, SECRETS[6], "en", "s")])
    _, more, longer = secrets.scan(later, ledger=ledger, known=found)
    assert {r["kind"] for r in more.collect()} == {"assign", "hex"} and longer.count() == 3 * len(secrets.RULES)
    newer = [secrets.Rule(r.kind, r.version + 1, r.pattern, r.group, r.least) if r.kind == "assign" else r for r in secrets.RULES]
    _, rescan, _ = secrets.scan(first, newer, ledger=ledger, known=found.limit(0))
    assert [(r["kind"], r["version"]) for r in rescan.collect()] == [("assign", 2)]


def test_redaction_cuts_every_span(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(SECRETS)] + [(50, None, "en", "s"), (51, "", "en", "s"), (None, SECRETS[0], "en", "s")]
    got = {r["doc_id"]: r for r in secrets.redact(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and got[50]["text"] is None and got[51]["text"] == ""
    assert got[0]["text"] == "[SECRET]' and token: abc" and got[3]["text"] == "é😀 [SECRET] tail"
    assert all(r["text"] is None or not plain_spans(r["text"].replace("[SECRET]", "\n")) for r in got.values())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
