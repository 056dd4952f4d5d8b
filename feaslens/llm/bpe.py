"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

The pieces of a batch that are not known yet lie in one array, parted by marks, as linked lists of parts. Pairs wait in buckets, one bucket per
merge rank, holding list positions. A bitmap with one bit per rank, and bitmaps over its 64-bit words above it, give the lowest waiting rank
by a few find-first-set steps; all its positions are merged at once in numpy, and entries whose pair has changed since are stale and skipped. Pieces
don't touch each other, so each sees its merges in its own order. A very long piece (a page of base64, say) costs no more a byte than short ones.

Defined cases: a null or empty text has no ids and decodes to the empty text; special tokens are not looked for; repeated rows are encoded each;
ids outside the vocabulary can't be decoded and raise; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from feaslens.llm.common import BLOCK, pick, pieces

#: Pieces whose ids a worker keeps; bytes of text encoded, merged (a longer piece alone) and decoded at a time.
KNOWN_PIECES = 300_000
AT_A_TIME = 8 * BLOCK
MERGED = BLOCK
DECODED = BLOCK
NONE = np.int32(2**31 - 1)


class RankQueue:
    """Positions by rank, the lowest rank first."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            was = level[word]
            level[word] = was | bit
            if was:
                return
            rank = word

    def pop(self) -> tuple[int, np.ndarray]:
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank * 64 + (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


class Codec:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known = _Known()
        get = self.ranks.get
        pairs: dict[int, int] = {}
        #: Ranks of tokens that are part of a token with a lower rank.
        self.upset: set[int] = set()
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
                    self.upset.update(x for x in (a, b) if x > rank)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.bytes = np.array([get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        self.mark = max(self.tokens) + 1
        self.queue = RankQueue(self.mark)
        #: Bytes of all tokens one after the other, for decoding.
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(self.mark)], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(self.mark)), dtype=np.uint8)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def _push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        some = np.flatnonzero(ranks != NONE)
        if not len(some):
            return
        order = some[np.argsort(ranks[some], kind="stable")]
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        a = 0
        for b in [*cuts.tolist(), len(ranks)]:
            self.queue.push(int(ranks[a]), positions[a:b])
            a = b

    def merge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several pieces, one after the other, and how many each piece has."""
        data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)
        ids = self.bytes[data].astype(np.int32)
        marks = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=marks[1:])
        ids[marks] = self.mark
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        live = np.ones(n, dtype=bool)
        waiting = np.full(n, NONE, dtype=np.int32)
        waiting[:-1] = self._pair_ranks(ids[:-1], ids[1:])
        self._push(waiting, np.arange(n, dtype=np.int32))
        while self.queue.buckets:
            rank, at = self.queue.pop()
            at = _distinct(at[waiting[at] == rank])  # the others are stale
            if not len(at):
                continue
            if rank in self.upset:
                # A merge may make a pair with a lower rank, which goes first: one merge a piece.
                piece = np.searchsorted(marks, at)
                first = np.concatenate([[True], piece[1:] != piece[:-1]])
                if not first.all():
                    self.queue.push(rank, at[~first])
                at = at[first]
            elif len(at) > 1:
                # In a run such as "aaaa" every other pair is merged, from the left.
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if follows.any():
                    index = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(follows, 0, index))
                    at = at[(index - start) % 2 == 0]
            right = after[at]
            ids[at] = rank
            live[right] = False
            waiting[right] = NONE
            after[at] = after[right]
            before[after[at]] = at
            changed = _distinct(np.concatenate([at, before[at]]))
            ranks = self._pair_ranks(ids[changed], ids[after[changed]])
            waiting[changed] = ranks
            self._push(ranks, changed)
        kept = np.flatnonzero(live)
        ends = np.searchsorted(kept, marks)
        whole = np.ones(len(kept), dtype=bool)
        whole[ends] = False
        return ids[kept[whole]], np.diff(ends) - 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        known = self.known
        if len(known) > KNOWN_PIECES:
            known.forget()
        numbers = [np.fromiter(map(known.__getitem__, self.split(t)), dtype=np.int32) for t in texts]
        new = [t.encode() for t in known.new]
        known.new.clear()
        for a, b in pieces([len(d) + 1 for d in new], MERGED):
            part = new[a:b]
            whole = [self.ranks.get(d, -1) for d in part]
            rest = [d for d, rank in zip(part, whole) if rank < 0]
            counts = np.ones(len(part), dtype=np.int64)
            ids = np.array(whole, dtype=np.int32)
            if rest:
                found, lengths = self.merge(rest)
                counts[ids < 0] = lengths
                ids = np.repeat(ids, counts)
                ids[ids < 0] = found
            known.add(ids, counts)
        every = np.concatenate([np.empty(0, np.int32), *numbers])
        ids, counts = gathered(known.ids, known.starts[every], known.counts[every])
        sums = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(sums[np.cumsum([0] + [len(x) for x in numbers])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of texts whose ids come one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.mark or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        data, lengths = gathered(self.flat, self.starts[ids], self.lengths[ids])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.concatenate([[0], counts]))].tolist()
        data = data.tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def _distinct(values: np.ndarray) -> np.ndarray:
    """np.unique with less ado, for the many short arrays here."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) > 1 else values


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + count], one after the other, and their counts."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(total)], counts


class _Known(dict):
    """Numbers of pieces and the ids of each number; a piece asked for the first time gets the next number and waits in ``new``."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    name = (hash(lines), pattern)
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(lines, pattern)
    return _codecs[name]


def _ranks(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent once to each executor; about a MB whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    lines = _ranks(docs, path)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for a, b in pieces(sizes, AT_A_TIME):
                ids, counts = codec.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows with ``doc_id`` and ``ids``."""
    lines = _ranks(encoded, path)
    rows = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            every = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
            for a, b in pieces(every, DECODED):
                part = batch.slice(a, b - a)
                out = codec.decode(part.column("ids").flatten().to_numpy(zero_copy_only=False), np.array(every[a:b], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
