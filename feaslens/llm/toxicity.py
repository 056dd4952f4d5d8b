"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text (ASCII letters in lower case, parted at every other ASCII character) and the first five bytes of longer
words, as 32-bit hashes. The machine adds a weight per term and, through factors of a few numbers per term, a weight for each pair of terms
that meet in a text, so that two terms together can say what neither says alone. It is fitted on a bounded sample of labelled rows: every term of
``LEAST_ROWS`` texts or more is kept, since one that says little by itself may matter in a pair, and begins with smaller steps the less it says; a fifth
of the sample is kept aside to tell after which round to stop.

Defined cases: a null or empty text, and one without known terms, gets the score of the bias alone; labels that are null are not learned from;
with no labels of either kind the score is 0; a label row repeated or an id labelled twice counts each time; repeated rows get one
row each; columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feaslens.llm.common import pick, pieces, utf8, word_hashes

#: Bound of the fit: labelled rows of each class, picked by hash.
SAMPLE_ROWS = 6000
LEAST_ROWS = 3
STEM = 5
FACTORS = 4
EPOCHS = 30
BATCH = 128
RATE = 0.5
#: What the sums of squared slopes begin with: chance terms then don't leap on their first sight.
FIRST = 0.1
#: Terms of a smaller chi-square (one degree of freedom), unless in so large a share of the toxic texts, begin with more, up to exp(CALM) times as much.
ASSOCIATION = 20.0
COMMON_SHARE = 0.1
CALM = 5.0
DECAY = 2e-4

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BREAKS[_a:_b] = False


@dataclass
class Machine:
    """Terms in order, a weight and the factors of each, and the bias."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts, from pairs of a term's row and the text it is in."""
        linear = np.bincount(docs, self.weights[rows], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[rows, f]
            pairs += np.bincount(docs, v, n) ** 2 - np.bincount(docs, v * v, n)
        return self.bias + linear + 0.5 * pairs

    def scores(self, rows: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(rows, docs, n), -30, 30)))


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit term hashes of several texts and where each text's terms begin; a term may come more than once."""
    words, _, begins, stems = word_hashes(texts, _BREAKS, STEM)
    both = np.empty(2 * len(words), dtype=np.uint32)
    both[0::2], both[1::2] = words >> np.uint64(32), stems >> np.uint64(32)
    return both, 2 * begins


def distinct_terms(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for a, b in pieces([len(t) for t in texts]):
        terms, begins = terms_of(texts[a:b])
        out += [np.unique(terms[i:j]) for i, j in zip(begins, begins[1:])]
    return out


def kept_terms(examples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order that the machine gets weights for, and what each one's sums of squared slopes begin with."""
    whole = np.unique(np.concatenate(examples or [np.empty(0, np.uint32)]), return_counts=True)
    terms, n = whole[0][whole[1] >= LEAST_ROWS], whole[1][whole[1] >= LEAST_ROWS].astype(np.float64)
    own, counts = np.unique(np.concatenate([e for e, y in zip(examples, labels) if y == 1] or [np.empty(0, np.uint32)]), return_counts=True)
    a = np.zeros(len(terms))
    at = np.searchsorted(terms, own)
    known = at < len(terms)
    known[known] = terms[at[known]] == own[known]
    a[at[known]] = counts[known]
    n1, total = float((labels == 1).sum()), float(len(labels))
    square = total * (a * total - n * n1) ** 2 / np.maximum(n1 * (total - n1) * n * (total - n), 1.0)
    sure = (square >= ASSOCIATION) | (a >= np.maximum(COMMON_SHARE * n1, LEAST_ROWS))
    return terms, FIRST * np.where(sure, 1.0, np.exp(CALM * (1.0 - square / ASSOCIATION)))


def fit(examples: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, adaptive steps. ``weights`` give back the share of the classes that the sample has changed."""
    random = np.random.default_rng(seed)
    aside = random.random(len(labels)) < 0.2
    both = lambda m: m.any() and labels[m].min() != labels[m].max()
    if not both(aside) or not both(~aside):
        aside[:] = False
    own = np.flatnonzero(~aside)
    terms, first = kept_terms([examples[i] for i in own], labels[own])
    w, v = np.zeros(len(terms)), random.normal(0.0, 0.01, (len(terms), FACTORS))
    if not len(labels) or labels.min() == labels.max() or not len(terms):
        return Machine(terms, w, np.zeros_like(v), 30.0 if len(labels) and labels.min() == 1 else -30.0)
    rows = []
    for e in examples:
        at = np.minimum(np.searchsorted(terms, e), len(terms) - 1)
        rows.append(at[terms[at] == e])
    rate = float((weights * labels).sum() / weights.sum())
    bias, bias_sum = float(np.log(rate / (1 - rate))), 1e-8
    w_sum, v_sum = first.copy(), np.repeat(first[:, None], FACTORS, axis=1)
    weights = weights / weights.mean()
    best: tuple[float, Machine] | None = None
    test = np.flatnonzero(aside) if aside.any() else own
    test_rows, test_docs = np.concatenate([rows[i] for i in test]), np.repeat(np.arange(len(test)), [len(rows[i]) for i in test])
    for _ in range(EPOCHS):
        order = random.permutation(own)
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            used, back = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            docs = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            vu = v[used]
            here = vu[back]
            sums = np.stack([np.bincount(docs, here[:, f], len(part)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(docs, (here * here).sum(axis=1), len(part))
            z = bias + np.bincount(docs, w[used][back], len(part)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            slope = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weights[part] / len(part)
            g_bias = float(slope.sum())
            bias_sum += g_bias * g_bias
            bias -= RATE * g_bias / bias_sum**0.5
            each = slope[docs]
            g_w = np.bincount(back, each, len(used)) + DECAY * w[used]
            w_sum[used] += g_w * g_w
            w[used] -= RATE * g_w / np.sqrt(w_sum[used])
            for f in range(FACTORS):
                g = np.bincount(back, each * (sums[docs, f] - here[:, f]), len(used)) + DECAY * vu[:, f]
                v_sum[used, f] += g * g
                v[used, f] -= 0.1 * RATE * g / np.sqrt(v_sum[used, f])
        now = Machine(terms, w.copy(), v.copy(), bias)
        p = np.clip(now.scores(test_rows, test_docs, len(test)), 1e-9, 1 - 1e-9)
        loss = -float((weights[test] * np.where(labels[test] == 1, np.log(p), np.log(1 - p))).sum())
        if best is None or loss < best[0]:
            best = (loss, now)
    machine = best[1]
    if aside.any():
        machine.bias -= _cut(machine.logits(test_rows, test_docs, len(test)), labels[test], weights[test])
    return machine


def _cut(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Where to part the classes with the least weight on the wrong side: the middle of the best gap, the gap nearest to 0 among equals."""
    order = np.argsort(z, kind="stable")
    z, y, w = z[order], labels[order], weights[order]
    wrong = np.concatenate([[0.0], np.cumsum(np.where(y == 1, w, 0.0))]) + np.concatenate([np.cumsum(np.where(y == 0, w, 0.0)[::-1])[::-1], [0.0]])
    middles = np.concatenate([[z[0] - 1.0], (z[1:] + z[:-1]) / 2, [z[-1] + 1.0]])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(middles[least[np.argmin(np.abs(middles[least]))]])


def learn(docs: DataFrame, labels: DataFrame, held_out: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most ``rows`` labelled texts of each class that ``held_out`` doesn't name, in hash order of their ids."""
    known = pick(labels, id=id_col, label=label_col).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    texts = pick(docs, id=id_col, text=text_col)
    if held_out:
        known = known.filter(~F.expr(held_out))
    totals = {r["label"]: r["count"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    picked = []
    for label in (0, 1):
        one = known.filter((F.col("label") > 0) == F.lit(bool(label))).orderBy(F.xxhash64("id", F.lit(31)), "id").limit(rows)
        picked.append(one.select("id", F.lit(label).alias("label")))
    chosen = picked[0].unionByName(picked[1])
    # At most 2 * rows pairs of two numbers, so this side can be sent to every task.
    sample = texts.join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = distinct_terms(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id").cast("string"), pa.array([t.tobytes() for t in found], pa.binary())], names=["label", "id", "terms"])

    got = sample.select("label", "id", "text").mapInArrow(run, "label int, id string, terms binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("label", "ascending"), ("terms", "ascending")])
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)
    examples = [np.frombuffer(t, np.uint32) for t in got.column("terms").to_pylist()]
    share = {label: totals.get(label, 0) / max(1, int((y == label).sum())) for label in (0, 1)}
    return fit(examples, y, np.where(y == 1, share[1], share[0]))


def _scores(model: Machine, texts: list[bytes]) -> np.ndarray:
    parts = [np.empty(0)]
    for a, b in pieces([len(t) for t in texts]):
        terms, begins = terms_of(texts[a:b])
        at = np.minimum(np.searchsorted(model.terms, terms), max(len(model.terms) - 1, 0))
        known = model.terms[at] == terms if len(model.terms) else np.zeros(len(terms), bool)
        docs = np.repeat(np.arange(b - a), np.diff(begins))[known]
        once = np.unique(docs.astype(np.uint64) << np.uint64(32) | at[known].astype(np.uint64))
        parts.append(model.scores((once & np.uint64(0xFFFFFFFF)).astype(np.int64), (once >> np.uint64(32)).astype(np.int64), b - a))
    return np.concatenate(parts)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(sent.value, utf8(batch.column("text"))))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, machine: Machine, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``limit``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, utf8(batch.column(text_col))) < limit))

    return docs.mapInArrow(run, docs.schema)
