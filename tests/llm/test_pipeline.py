"""The stages one after the other, each against a plain version of what it should keep of its own input."""

import base64

import public_tokenizers
import tiktoken

import corpus_pipeline
from feaslens.llm import mixing, secrets, toxicity
from tests.llm.helpers import docs, sorted_rows, words
from tests.llm.test_mixing_bpe_secrets import plain_spans
from tests.llm.test_pairs import classes


def test_stages_keep_what_they_should(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [table]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf).cache())
    assert all(s.columns == table.columns for s in steps[:-1])
    rows = [[tuple(r) for r in s.collect()] for s in steps]

    machine = toxicity.learn(table, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(table, machine).collect() if r["score"] >= 0.5}
    assert sorted_rows(rows[1]) == sorted_rows(r for r in rows[0] if r[0] not in bad)

    kept = {i for i, _, c in classes([(r[0], r[1], None, None) for r in rows[1]]) if i == c}
    assert sorted_rows(rows[2]) == sorted_rows(r for r in rows[1] if r[0] in kept)

    after = {r[0]: r for r in rows[3]}
    assert set(after) == kept
    for r in rows[2]:
        clean = not plain_spans(r[1])
        assert (after[r[0]][1] == r[1]) == (clean or "[SECRET]" not in after[r[0]][1]) and after[r[0]][4] == len(after[r[0]][1])
        assert clean or "[SECRET]" in after[r[0]][1]

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(steps[3]).collect()}
    got = {}
    for r in rows[4]:
        got[r[0]] = got.get(r[0], 0) + len(words(r[1]))
    assert got == {i: t for i, t in taken.items() if t}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r[0], len(ids), ids) for r in rows[4] for ids in [plain.encode_ordinary(r[1])]]
    assert sorted_rows((i, n, list(ids)) for i, n, ids in rows[5]) == sorted_rows(want)


def test_run_gives_the_last_stage(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


def test_stages_on_odd_rows(spark, sf):
    rows = docs(spark, [(1, None, None, None), (2, "", "en", None), (3, "password=abcdef12 " + "a" * 9000, "en", "s"), (4, "one two", None, "s"), (4, "one two", None, "s")])
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    assert {r["doc_id"] for r in rows.collect()} <= {3, 4}
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_rules_are_told_apart():
    assert len({(r.kind, r.version) for r in secrets.RULES}) == len(secrets.RULES)
