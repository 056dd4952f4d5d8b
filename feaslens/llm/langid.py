"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is cut, from left to right, into the longest phrases that
occur in a language's sample; the language that needs the fewest phrases per letter wins. Many pieces of text are parsed at once, one automaton
step for all of them in numpy. Long texts are parsed in pieces of ``PIECE`` symbols (each cut adds at most one phrase, to every language alike).

Symbols are lower-cased letters of the samples, each its own whatever the script, everything else that is a letter as one symbol, and runs of other
characters as one gap. Transitions of the ``SYMBOLS`` most frequent symbols are in a table, those of the others in a sorted list.

Defined cases: a null text, and one without letters, is ``und`` with score 0; equal phrase counts go to the language first in
order; without any labelled text everything is ``und``; repeated rows get one row each; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feaslens.llm.common import pick, text_of

#: Bounds of the fit: labelled rows a language, picked by hash, and symbols a language taken from them.
SAMPLE_ROWS = 64
SAMPLE_SYMBOLS = 24_000
PIECE = 4096
LANES = 2048
SYMBOLS = 96
UNKNOWN, GAP = "und", 0


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def automaton(text: np.ndarray, symbols: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Transitions (states, symbols) of the suffix automaton of a sequence, -1: none, and (state, symbol, to) for symbols beyond. State 0 is the start."""
    links, lengths, edges, last = [-1], [0], [{}], 0
    for c in text.tolist():
        state = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = links[p]
        if p >= 0:
            q = edges[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[state] = q
            else:
                copy = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = links[p]
                links[q] = links[state] = copy
        last = state
    table, rare = np.full((len(links), symbols), -1, dtype=np.int32), []
    for state, out in enumerate(edges):
        for c, to in out.items():
            if c < symbols:
                table[state, c] = to
            else:
                rare.append((state, c, to))
    return table, rare


class Model:
    """Automata of all languages in one transition table, built once per worker from the samples."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters: dict[str, int] = {}
        for text in samples.values():
            for ch in text.lower():
                if ch.isalpha():
                    letters[ch] = letters.get(ch, 0) + 1
        ranked = sorted(letters, key=lambda ch: (-letters[ch], ch))
        common, others = sorted(ranked[:SYMBOLS - 2]), sorted(ranked[SYMBOLS - 2:])
        # Letters outside the samples share one symbol.
        self.codes = np.where(_letters(), 1, GAP).astype(np.int32)
        for i, ch in enumerate(common + others):
            self.codes[ord(ch)] = i + 2
        self.symbols, self.alphabet = len(common) + 2, len(ranked) + 2
        tables, rare, self.starts, at = [], [], [], 0
        for name in self.languages:
            table, more = automaton(self.coded(samples[name])[:SAMPLE_SYMBOLS], self.symbols)
            table[table >= 0] += at
            tables.append(table)
            rare += [((state + at) * self.alphabet + c, to + at) for state, c, to in more]
            self.starts.append(at)
            at += len(table)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.empty(0, np.int32)
        rare.sort()
        self.rare_keys, self.rare_to = np.array([k for k, _ in rare], dtype=np.int64), np.array([to for _, to in rare], dtype=np.int32)

    def after(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state that each symbol leads to from the states in its column; -1: none."""
        wide = np.flatnonzero(symbols >= self.symbols)
        if not len(wide):
            return self.table[states * self.symbols + symbols]
        out = self.table[states * self.symbols + np.minimum(symbols, self.symbols - 1)]
        keys = np.broadcast_to(states, out.shape)[:, wide].astype(np.int64) * self.alphabet + symbols[wide]
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        out[:, wide] = np.where(self.rare_keys[at] == keys, self.rare_to[at], -1)
        return out

    def coded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.codes[points]
        gap = codes == GAP
        return codes[~(gap & np.concatenate([[True], gap[:-1]]))] if len(codes) else codes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) phrase counts, and the number of symbols of each text that stand for letters."""
        lanes, owner, letters = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            codes = self.coded(text)
            letters[i] = np.count_nonzero(codes)
            if letters[i]:
                for at in range(0, len(codes), PIECE):
                    lanes.append(codes[at:at + PIECE])
                    owner.append(i)
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not lanes or not self.languages:
            return counts, letters
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        for at in range(0, len(order), LANES):
            part = order[at:at + LANES]
            np.add.at(counts, np.array(owner)[part], self._parse([lanes[i] for i in part]).T)
        return counts, letters


    def _parse(self, lanes: list[np.ndarray]) -> np.ndarray:
        """(languages, lanes) phrase counts; lanes come longest first."""
        lengths = np.array([len(x) for x in lanes])
        grid = np.zeros((int(lengths[0]), len(lanes)), dtype=np.int32)
        for column, codes in enumerate(lanes):
            grid[:len(codes), column] = codes
        starts = np.array(self.starts, dtype=np.int32)[:, None]
        states = np.repeat(starts, len(lanes), axis=1)
        found = np.zeros(states.shape, dtype=np.int32)
        live = len(lanes)
        for step in range(len(grid)):
            while live and lengths[live - 1] <= step:
                live -= 1
            symbol, now = grid[step, :live], states[:, :live]
            idle = now == starts  # between phrases: one begins here
            after = self.after(now, symbol)
            ended = after < 0
            found[:, :live] += idle | ended
            if ended.any():
                # The symbol begins the next phrase; one that the language never has is a phrase by itself.
                again = self.after(starts, symbol)
                after = np.where(ended, np.where(again < 0, starts, again), after)
            states[:, :live] = after
        return found


_models: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    name = hash(data)
    if name not in _models:
        _models.clear()
        _models[name] = Model(pickle.loads(data))
    return _models[name]


def samples(docs: DataFrame, learn: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Text by language of at most ``rows`` labelled rows each that fulfil ``learn``, in hash order; a few hundred kB a language at most."""
    labelled = docs.filter(learn).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Only letters teach; a row without them would use up a place.
    labelled = labelled.withColumn("text", F.substring("text", 1, SAMPLE_SYMBOLS))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64(F.col("id"), F.lit(29)))
    order = Window.partitionBy("lang").orderBy("key", "id")
    picked = labelled.select("lang", "id", "key", "text").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows)
    out: dict[str, list[str]] = {}
    for row in picked.select("lang", "place", "text").orderBy("lang", "place").collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return {name: _even(texts, SAMPLE_SYMBOLS) for name, texts in out.items()}


def _even(texts: list[str], total: int) -> str:
    """At most ``total`` characters, gaps as one each, as evenly from all texts as their lengths allow."""
    texts = [" ".join("".join(ch if ch.isalpha() else " " for ch in text.lower()).split()) for text in texts]
    left, parts = total - len(texts) + 1, []
    for i, text in enumerate(sorted(texts, key=len)):
        take = left // (len(texts) - i)
        parts.append(text[:take])
        left -= len(parts[-1])
    return "\n".join(parts)


def predict(docs: DataFrame, learn: str = "true", lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, phrases): the score is the softmin of the phrases needed per 100 letters, at the winner."""
    data = docs.sparkSession.sparkContext.broadcast(pickle.dumps(samples(docs, learn, lang_col, id_col, text_col)))
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_of())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                counts, letters = model.phrases(batch.column("text").to_pylist())
                if model.languages:
                    best = counts.argmin(axis=1)
                    rate = 100.0 * (counts - counts.min(axis=1, keepdims=True)) / np.maximum(letters, 1)[:, None]
                    score = 1.0 / np.exp(-rate).sum(axis=1)
                    known = letters > 0
                    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    score = np.where(known, score, 0.0)
                    least = np.where(known, counts.min(axis=1), 0)
                else:
                    names, score, least = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(least, pa.int64())],
                                                 names=["doc_id", "lang_pred", "score", "phrases"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, phrases bigint")
