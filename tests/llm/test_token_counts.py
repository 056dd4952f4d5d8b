"""Token counts against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feaslens.llm import queries, token_counts
from tests.llm.helpers import ODD, docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "hello world  it's", "  ' 's 'll\n's\t\tx  ", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>", "''s don''t we'rex 'RE", "x" * 5000,
         "漢字😀 héllo    　　1२३ ² ⅷ", "   ", "\n\n a\r\n b", "=========== ------- 0000000 1234", "the " * 20_000]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.compile_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def random_texts(n):
    r = random.Random(5)
    near = "ab's tlrev'm d \n\t12é漢!?.<|>_ "
    wide = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x2ff), r.randrange(0x3000), r.randrange(0xE000, 0x20000)]))
    return ["".join(r.choice(near) for _ in range(r.randrange(60))) for _ in range(n)] + ["".join(wide() for _ in range(30)) for _ in range(n // 4)] + [r.randbytes(1500).hex()]


def test_counts_are_those_of_the_library(vocabulary, library):
    texts = TEXTS + random_texts(6000)
    assert token_counts.Counter(vocabulary).count(texts).tolist() == library(texts)


def test_windows_chunks_and_lost_answers_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(token_counts, "WINDOW", 61)
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "ANSWERS", 64)
    monkeypatch.setattr(token_counts, "FEW_LANES", 3)
    texts = [t[:3000] for t in TEXTS] + random_texts(400)
    assert token_counts.Counter(vocabulary).count(texts).tolist() == library(texts)


def test_every_code_point_has_the_class_that_the_library_gives_it(vocabulary, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(8)
    texts = ["".join("a" + chr(c) + "1" + chr(c) + "! " for c in r.sample(points, 40)) for _ in range(300)]
    assert token_counts.Counter(vocabulary).count(texts).tolist() == library(texts)


def test_prefix_scan_is_the_step_by_step_run(vocabulary):
    counter = token_counts.Counter(vocabulary)
    symbols = np.random.default_rng(3).integers(0, 9, 5000).astype(np.uint8)
    for start in range(8):
        state, want = start, []
        for s in symbols.tolist():
            want.append(bool(counter.cut[s * 8 + state]))
            state = int(counter.to[s * 8 + state])
        cuts, final = counter._cuts(symbols, start)
        assert cuts.tolist() == want and final == state


def test_odd_rows(spark, vocabulary, library):
    rows = ODD + [(20, prose(3, 200_000), "en", "s1")]
    got = token_counts.token_counts(docs(spark, rows), vocabulary, 512)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t, _, _), n in zip(rows, library([t or "" for _, t, _, _ in rows]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(docs(spark, []), vocabulary, 512).collect() == []
    named = docs(spark, ODD).withColumnsRenamed({"doc_id": "name"}).selectExpr("cast(name as string) as name", "text", "n_chars as n_tokens")
    assert token_counts.token_counts(named, vocabulary, 1, doc_id="name").filter("n_tokens > 1").count() > 5


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        token_counts.compile_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, library([r.text or "" for r in rows]))}
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op13_token_counts"](spark, sf).collect()} == want
