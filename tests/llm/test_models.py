import random
import zlib

import numpy as np

from feaslens.llm import fingerprints, langid, toxicity
from feaslens.llm.common import shingle_hashes, word_hashes
from tests.llm.helpers import ODD, docs, prose, shingles, words


def test_word_hashes_follow_the_words(monkeypatch):
    from feaslens.llm import common
    texts = [(t or "") for _, t, _, _ in ODD if t is None or len(t) < 60_000] + ["A b\x0bC\x1fd", "ab ab AB", "\x00 \x00\x00"]
    h, starts, begins, _ = word_hashes([t.encode() for t in texts])
    assert np.diff(begins).tolist() == [len(words(t)) for t in texts]
    names = {}
    for t, a, b in zip(texts, begins, begins[1:]):
        for w, x in zip(words(t), h[a:b].tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(common, "BLOCK", 64)
    assert (word_hashes([t.encode() for t in texts])[0] == h).all()
    s, at = shingle_hashes(h, begins, 5)
    assert [len(set(s[a:b].tolist())) for a, b in zip(at, at[1:])] == [len(shingles(t)) for t in texts]


def chain(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {r[0]: (r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)}


def test_fingerprints_of_edited_texts(spark):
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + [(100 + i, prose(i, 20 + i % 90), "en", "s") for i in range(150)] + [(300 + i, prose(5, 60), "en", "s") for i in range(3)]
    got = {r["doc_id"]: r for r in fingerprints.edited_report(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    pairs = chain(rows)
    by_text = {}
    for i, (text, following) in pairs.items():
        half, r = len(text) // 2, got[i]
        edited = text[:len(text) - half] + following[:half]
        import hashlib
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for value, other in ((r["near_edited"], edited), (r["near_next"], following)):
            a, b = shingles(text), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - want) < 0.25
    assert len({r["fingerprint"] for r in got.values()}) == len({" ".join(words(t)) for _, t, _, _ in rows if words(t)}) + 1


def test_fingerprints_with_null_and_repeated_ids(spark):
    assert fingerprints.edited_report(docs(spark, [])).count() == 0
    alone = fingerprints.edited_report(docs(spark, [(1, prose(1, 50), "en", "s")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.edited_report(docs(spark, [(None, "a b c", "en", "s"), (None, "d e f", "en", "s")])).count() == 2
    assert fingerprints.edited_report(docs(spark, ODD + [(6, "other words", "en", "s")])).count() == len(ODD) + 1


def test_near_copies_share_bands(spark):
    text = prose(3, 400)
    near = text.split()
    near[50], near[300] = "changed", "words"
    rows = [(1, text, "en", "s"), (2, " ".join(near), "en", "s"), (3, prose(4, 400), "en", "s"), (4, text, "en", "s"), (5, None, "en", "s"), (6, "", "en", "s")]
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.near_copies(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def test_machine_learns_a_pair_that_single_words_miss():
    r = random.Random(4)
    examples, labels = [], []
    for _ in range(1500):
        insult, group = r.random() < 0.5, r.random() < 0.5
        text = [prose(r.random(), 15, 300)] + ["insult"] * insult + ["people"] * group
        examples.append(" ".join(text).encode())
        labels.append(float(insult == group))  # neither word by itself says anything
    machine = toxicity.fit(toxicity.distinct_terms(examples), np.array(labels), np.ones(len(labels)))
    tests = [(b"insult people w1", 1), (b"insult w1 w5", 0), (b"people w3 w9", 0), (b"w3 w8", 1)]
    terms = toxicity._scores(machine, [t for t, _ in tests])
    assert [int(p >= 0.5) for p in terms] == [y for _, y in tests], terms


def pair_texts(seed, toxic, clean):
    """Texts with one of 20 insults and one of 20 groups if toxic, and else with an insult, a group or neither."""
    r, out = random.Random(seed), []
    for i in range(toxic + clean):
        kind = "both" if i < toxic else r.choice(["insult", "group", "none", "none"])
        more = [f"insult{chr(97 + r.randrange(20))}x"] * (kind in ("both", "insult")) + [f"zz{chr(97 + r.randrange(20))}folk"] * (kind in ("both", "group"))
        words = [f"{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(12))}" for _ in range(30)] + more
        r.shuffle(words)
        out.append((" ".join(words).replace("insult", "").encode(), float(kind == "both"), kind))
    return out


def test_machine_learns_pairs_of_many_words():
    train, test = pair_texts(1, 350, 6000), pair_texts(2, 300, 3000)
    labels = np.array([y for _, y, _ in train])
    machine = toxicity.fit(toxicity.distinct_terms([t for t, _, _ in train]), labels, np.ones(len(labels)))
    hit = toxicity._scores(machine, [t for t, _, _ in test]) >= 0.5
    share = {k: float(np.mean(hit[[i for i, t in enumerate(test) if t[2] == k]])) for k in ("both", "insult", "group", "none")}
    assert share["both"] > 0.6 and max(share[k] for k in ("insult", "group", "none")) < 0.05, share


def test_toxic_words_are_found_in_held_out_texts(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = r.random() < 0.2
        text = prose(i, 60, 500) + (" you IDIOT, " if bad else " ") + prose(-i, 20, 500)
        rows.append((i, text, "en", "s"))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(None, "idiot", "en", "s"), (1001, None, "en", "s"), (1002, "", "en", "s"), (5, rows[5][1], "en", "s")]
    table = docs(spark, rows)
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.learn(table, marks, "pmod(id, 5) = 0")
    got = toxicity.score(table, machine).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    wrong = sum((g["score"] >= 0.5) != ("IDIOT" in rows[g["doc_id"]][1]) for g in got if g["doc_id"] is not None and g["doc_id"] < 600)
    assert wrong <= 5
    assert toxicity.clean(table, machine).count() == sum(g["score"] < 0.5 for g in got)
    none = toxicity.learn(table, marks.limit(0))
    assert all(g["score"] < 1e-9 for g in toxicity.score(table, none).collect())


def longest_matches(text, sample):
    """Phrases of the greedy parse, by substring search."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


def test_automaton_parses_like_a_substring_search():
    r = random.Random(6)
    sample = "".join(r.choice("abc ") for _ in range(500))
    model = langid.Model({"x": sample})
    texts = ["".join(r.choice("abcd ") for _ in range(n)) for n in (1, 5, 60, 300)]
    counts, _ = model.phrases(texts)
    squeeze = lambda t: "".join(chr(c + 40) for c in model.coded(t))
    for text, got in zip(texts, counts[:, 0]):
        if model.coded(text).any():
            assert got == longest_matches(squeeze(text), squeeze(sample))


def tongue(name, seed, n):
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["que", "ment", "oi", "eau"]}[name]
    r = random.Random(f"{name}{seed}")
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_languages_of_held_out_texts(spark):
    rows = [(i, tongue(("aa", "bb", "cc")[i % 3], i, 5 + i % 60), ("aa", "bb", "cc")[i % 3], "s") for i in range(240)]
    rows += [(900, tongue("aa", 1, 20_000), None, "s"), (901, None, "aa", "s"), (902, "12 34 !?", "bb", "s"), (903, "", None, "s"), (None, tongue("bb", 7, 30), None, "s"), (3, rows[3][1], "aa", "s")]
    got = langid.predict(docs(spark, rows), "doc_id % 5 <> 0").collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 for g in got)
    named = {g["doc_id"]: g["lang_pred"] for g in got}
    assert [named[i] for i in (901, 902, 903)] == ["und"] * 3 and named[900] == "aa" and named[None] == "bb"
    assert np.mean([named[i] == ("aa", "bb", "cc")[i % 3] for i in range(0, 240, 5)]) > 0.95
    assert {g["lang_pred"] for g in langid.predict(docs(spark, rows[:5]), "false").collect()} == {"und"}


def test_languages_in_large_alphabets(spark):
    r = random.Random(8)
    shared = [chr(0x4E00 + i) for i in range(400)]
    own = {name: shared + [chr(first + i) for i in range(n)] for name, first, n in (("zh", 0x5800, 400), ("ja", 0x3042, 80), ("ko", 0xAC00, 600))}
    own |= {name: [chr(first + i) for i in range(30)] for name, first in (("ru", 0x430), ("el", 0x3B1), ("ka", 0x10D0), ("hy", 0x561), ("en", 0x61))}
    own["en"] = own["en"][:26]
    # Words of a language are drawn from a list: only their order in a text differs.
    lists = {name: ["".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(300)] for name, letters in own.items()}
    names = sorted(own)
    rows = [(i, " ".join(r.choice(lists[names[i % 8]]) for _ in range(30)), names[i % 8], "s") for i in range(480)]
    rows += [(10_000 + i, "12 34 !?", "ka", "s") for i in range(500)]
    model = langid.Model(langid.samples(docs(spark, rows), "true"))
    assert len({int(model.codes[ord(ch)]) for letters in own.values() for ch in letters if model.codes[ord(ch)] > 1}) == model.alphabet - 2 > 1000
    got = {g["doc_id"]: g["lang_pred"] for g in langid.predict(docs(spark, rows), "doc_id % 5 <> 0").collect()}
    assert np.mean([got[i] == names[i % 8] for i in range(0, 480, 5)]) > 0.98
    counts, _ = model.phrases([rows[0][1]])
    sample = langid.samples(docs(spark, rows), "true")[names[0]]
    assert counts[0, 0] == longest_matches("".join(map(chr, model.coded(rows[0][1]) + 0x20)), "".join(map(chr, model.coded(sample) + 0x20)))


def test_samples_take_from_all_texts():
    texts = ["a, b. " * 10_000, "c" * 30_000, "d - " * 20]
    sample = langid._even(texts, langid.SAMPLE_SYMBOLS)
    assert len(sample) <= langid.SAMPLE_SYMBOLS and sample.count("d") == 20
    assert abs(sample.count("c") - len([p for p in sample.split("\n") if "a" in p][0])) <= 1


def test_held_out_rule_is_that_of_zlib(spark):
    got = spark.sql("select id, pmod(crc32(cast(cast(id as string) as binary)), 5) = 0 as held from range(200)").collect()
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
