"""Token counts from a byte-level BPE vocabulary compiled into two deterministic transducers.

The first transducer cuts a text into pre-tokens. It reads one symbol a character (the character's class and what the next two characters settle)
and has eight states. A window of text is cut into chunks; each chunk's map from entry state to exit state is built for all entry states at once,
the maps are composed by a parallel prefix scan, and then every chunk runs from its true entry state. The character classes are asked from
the tokenizer library itself, so they follow its Unicode version.

The second transducer reads the bytes of a pre-token. Its states are the beginnings of tokens: the state is the longest end of the bytes read that
begins some token, and each state names the tokens that end there. The last token of a prefix is the one of these that can follow the last token before it, and the
transition emits the change of the token count, so the sum over all bytes is the count. One token can follow another unless some part on the
right edge of the first would merge with one on the left edge of the second while both are there, by the ranks of the merges that make and
take them; answers are kept in a table of fixed size. All pre-tokens of a window step together.

Defined cases: a null or empty text has no tokens; a special string in a text is one token, as is the library's default; repeated rows are counted each;
a table without rows gives none; columns other than the named ones are not looked at. Memory is bounded by the window whatever a text's length.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feaslens.llm.common import BLOCK, pick, pieces

#: Characters a window holds, characters a chunk holds, answers kept about pairs of tokens (a power of two).
WINDOW = BLOCK // 4
CHUNK = 256
ANSWERS = 1 << 20
#: Pre-tokens that still have bytes left when fewer than this many do are finished one by one.
FEW_LANES = 24
NEVER = np.int64(1) << 40

#: Stands between texts; no text holds it.
BREAK = "\ud800"

# Character classes.
LETTER, DIGIT, OTHER, SPACE, END = range(5)
# Symbols of the first transducer: a letter, digit or other character, an apostrophe before one or two letters that it forms a piece with, white space
# inside a run or at the end of a text, the last white space before something else (a blank joins what follows), the end of a text.
S_LETTER, S_DIGIT, S_OTHER, S_SHORT, S_LONG, S_INNER, S_BLANK, S_LAST, S_END = range(9)
# Its states: inside a run of letters, digits, others, white space; after a blank that joins; at a fresh start; one or two letters before a fresh start.
LETTERS, DIGITS, OTHERS, SPACES, JOINS, FRESH, ONE, TWO = range(8)
# What may follow an apostrophe.
SHORT = "sdmt"
LONG = ("ll", "ve", "re")


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol * 8 + state."""
    to, cut = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=bool)
    for symbol, state in ((S_LETTER, LETTERS), (S_DIGIT, DIGITS), (S_OTHER, OTHERS), (S_SHORT, ONE), (S_LONG, TWO),
                          (S_INNER, SPACES), (S_BLANK, JOINS), (S_LAST, FRESH), (S_END, FRESH)):
        to[symbol] = state
    for symbol, state in ((S_LETTER, LETTERS), (S_DIGIT, DIGITS), (S_OTHER, OTHERS)):
        cut[symbol, [state, JOINS]] = False
    for symbol in (S_SHORT, S_LONG):
        to[symbol, [OTHERS, JOINS]] = OTHERS
        cut[symbol, [OTHERS, JOINS]] = False
    cut[S_INNER, SPACES] = False
    to[S_LETTER, ONE], to[S_LETTER, TWO] = FRESH, ONE
    cut[S_LETTER, [ONE, TWO]] = False
    return to.ravel(), cut.ravel()


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says, ready to be sent to tasks: tokens, merges, special strings and runs of character classes."""

    tokens: tuple[bytes, ...]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of tokens: rank and the token made
    special: tuple[str, ...]
    class_starts: np.ndarray
    class_of_run: np.ndarray


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes(tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Runs of code points of one class, as the library's pre-tokenizer parts them."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def kind(ch: str) -> int:
        joins = lambda text: len(cut(text)) == 1
        if joins("a" + ch):
            return LETTER
        if joins("1" + ch):
            return DIGIT
        return OTHER if joins("!" + ch) else SPACE

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    starts, kinds = [], []
    for _, (a, b) in cut(text):
        # A blank may lead a piece; else a piece is of one class.
        for at in ([a, a + 1] if text[a] == " " and b - a > 1 else [a]):
            starts.append(points[at])
            kinds.append(kind(text[at]))
    return np.array(starts), np.array(kinds, dtype=np.uint8)


def compile_tokenizer(path: str) -> Vocabulary:
    """Reads a byte-level BPE tokenizer of the library's JSON form; other kinds are refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or not before or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or spec["normalizer"]:
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    added = spec["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path}: special tokens that take in their surroundings")
    byte = _byte_alphabet()
    as_bytes = lambda token: bytes(byte[c] for c in token)
    ids = {token: i for i, token in enumerate(t for t in model["vocab"] if set(t) <= set(byte))}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[a], ids[b]] = rank, ids[a + b]
    starts, kinds = _classes(Tokenizer.from_file(path))
    return Vocabulary(tuple(map(as_bytes, ids)), merges, tuple(t["content"] for t in added), starts, kinds)


class Counter:
    """Both transducers of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.special = v.special
        self.classes = np.repeat(v.class_of_run, np.diff(np.append(v.class_starts, 0x110000)))
        self.classes[0xD800:0xE000] = OTHER
        self.classes[ord(BREAK)] = END
        self.to, self.cut = _cutter()
        self.longest_token = max(map(len, v.tokens))
        self._edges(v)
        self._states(v)
        self.asked = np.full(ANSWERS, -1, dtype=np.int64)
        self.answer = np.zeros(ANSWERS, dtype=bool)

    def _edges(self, v: Vocabulary) -> None:
        """The parts on the left and right edge of each token from the token down to a byte, and the rank of the merge that takes each."""
        n = len(v.tokens)
        pairs = np.array(list(v.merges), dtype=np.int64).reshape(-1, 2)
        made = np.array(list(v.merges.values()), dtype=np.int64).reshape(-1, 2)
        keys = pairs[:, 0] * n + pairs[:, 1]
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks, self.tokens = np.append(keys[order], -1), np.append(made[order, 0], NEVER), n
        self.edges = []
        for side in (1, 0):  # right edge of the first token, left edge of the second
            part, taken = np.full(n, -1), np.full(n, NEVER)
            part[made[:, 1]], taken[made[:, 1]] = pairs[:, side], made[:, 0]
            row, rank = np.arange(n), np.full(n, NEVER)
            rows, ranks = [row], [rank]
            while (row >= 0).any():
                rank = np.where(row >= 0, taken[row], NEVER)
                row = np.where(row >= 0, part[row], -1)
                rows.append(row)
                ranks.append(rank)
            rows, ranks = np.stack(rows, axis=1), np.stack(ranks, axis=1)
            self.edges.append((rows, ranks, (rows >= 0).sum(axis=1)))
        # A token that its own parts don't come together to is never made.
        whole = np.ones(n, dtype=bool)
        for (a, b), (rank, token) in sorted(v.merges.items(), key=lambda m: len(v.tokens[m[1][1]])):
            whole[token] = whole[a] and whole[b]
        both = np.flatnonzero(whole[made[:, 1]])
        whole[made[both, 1]] &= self._apart(pairs[both, 0], pairs[both, 1], made[both, 0])
        for token in np.argsort([len(t) for t in v.tokens], kind="stable")[256:]:
            x = [e[0][token, 1] for e in self.edges]
            whole[token] &= x[1] < 0 or bool(whole[x[0]] and whole[x[1]])
        self.whole = whole

    def _apart(self, first: np.ndarray, second: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens stay apart (until the merge of rank ``before``): no parts at their border merge while both are there."""
        (a, a_rank, a_size), (b, b_rank, b_size) = self.edges
        size = a_size[first] * b_size[second]
        pair = np.repeat(np.arange(len(first)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        x, y = k // b_size[second][pair], k % b_size[second][pair]
        key = a[first[pair], x] * self.tokens + b[second[pair], y]
        at = np.minimum(np.searchsorted(self.merge_keys[:-1], key), len(self.merge_keys) - 2)
        rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], NEVER)
        # Of merges of one rank the leftmost comes first.
        joins = (rank < a_rank[first[pair], x]) & (rank <= b_rank[second[pair], y]) & (rank < NEVER)
        if before is not None:
            joins &= rank < before[pair]
        out = np.ones(len(first), dtype=bool)
        out[pair[joins]] = False
        return out

    def _states(self, v: Vocabulary) -> None:
        """Next state by state * 256 + byte, and the longest token that ends in each state; for each token the next shorter one that ends it."""
        ids = {token: i for i, token in enumerate(v.tokens)}
        begins = sorted({token[:k] for token in v.tokens for k in range(len(token))}, key=len)
        name = {text: i for i, text in enumerate(begins)}
        fall = np.zeros(len(begins), dtype=np.int32)
        self.next = np.zeros(len(begins) * 256, dtype=np.int32)
        table = self.next.reshape(-1, 256)
        below: list[list[tuple[int, int]]] = [[] for _ in begins]
        for i, text in enumerate(begins[1:], 1):
            below[name[text[:-1]]].append((text[-1], i))
        for i in range(len(begins)):
            if i:
                table[i] = table[fall[i]]
            for byte, child in below[i]:
                fall[child] = table[i, byte] if i else 0
                table[i, byte] = child
        self.length = np.array([len(t) for t in v.tokens], dtype=np.int32)
        ending = lambda text: next((ids[text[k:]] for k in range(len(text)) if text[k:] in ids), -1)
        self.shorter = np.array([ending(t[1:]) for t in v.tokens], dtype=np.int32)
        # The longest token that ends at state + byte: the state's text with the byte, or what ends it.
        self.ends = np.full(len(self.next), -1, dtype=np.int32)
        ends = self.ends.reshape(-1, 256)
        for token, i in ids.items():
            ends[name[token[:-1]], token[-1]] = i
        for i in range(1, len(begins)):
            row = ends[i]
            row[row < 0] = ends[fall[i]][row < 0]

    def _follows(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether tokens can come after others, or first where ``last`` is below 0."""
        key = (last.astype(np.int64) + 1) << 20 | token
        slot = (key * np.int64(0x9E3779B1) >> 12) & (ANSWERS - 1)
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            keys, first = np.unique(key[new], return_index=True)
            at = slot[new[first]]
            self.asked[at], self.answer[at] = keys, self._afresh(last[new[first]], token[new[first]])
        out = self.answer[slot]
        lost = np.flatnonzero(self.asked[slot] != key) if len(new) else new  # another pair took the place
        if len(lost):
            out[lost] = self._afresh(last[lost], token[lost])
        return out

    def _afresh(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        ok = self.whole[token].copy()
        some = np.flatnonzero(ok & (last >= 0))
        ok[some] = self._apart(last[some], token[some])
        return ok

    def _windows(self, stream: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Code points, symbols and how many of the code points belong to each window; two further ones are looked at."""
        for a in range(0, len(stream), WINDOW):
            points = np.frombuffer(stream[a:a + WINDOW + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            n = min(WINDOW, len(stream) - a)
            kind = np.full(len(points) + 2, END, dtype=np.uint8)
            kind[:-2] = self.classes[points]
            symbols = kind[:n].copy()
            space = kind == SPACE
            after = kind[1:n + 1]
            last = space[:n] & (after != SPACE) & (after != END)
            symbols[space[:n]] = S_INNER
            symbols[last] = np.where(points[:n][last] == 0x20, S_BLANK, S_LAST)
            symbols[kind[:n] == END] = S_END
            quote = np.flatnonzero(points[:n] == ord("'"))
            if len(quote):
                ahead = np.append(points, [0, 0])
                one, two = ahead[quote + 1], ahead[quote + 2]
                symbols[quote[np.isin(one, [ord(c) for c in SHORT])]] = S_SHORT
                for x, y in LONG:
                    symbols[quote[(one == ord(x)) & (two == ord(y))]] = S_LONG
            yield points[:n], symbols, n

    def _cuts(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Where pieces start, and the state behind the window: chunk maps composed by a prefix scan."""
        n = len(symbols)
        chunks = -(-n // CHUNK)
        grid = np.zeros(chunks * CHUNK, dtype=np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T) * np.uint8(8)
        maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
        for column in grid:
            maps = self.to[column[:, None] + maps]
        step = 1
        while step < chunks:  # afterwards maps[i] leads through chunks 0 to i
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
            step *= 2
        now = np.concatenate([[np.uint8(state)], maps[:-1, state]]).astype(np.uint8)
        out = np.empty((CHUNK, chunks), dtype=bool)
        final = state
        for c, column in enumerate(grid):
            key = column + now
            out[c], now = self.cut[key], self.to[key]
            if c == (n - 1) % CHUNK:
                final = int(now[-1])
        return out.T.ravel()[:n], final

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, count: np.ndarray, state: int) -> int:
        """Fills the last token and the count of each prefix of the pieces; the first piece goes on from ``state``. The state behind the last piece.

        The arrays begin before the window, at the end of a piece that goes on.
        """
        back = len(last) - len(data)
        length = ends - np.maximum(starts, 0)
        order = np.argsort(-length, kind="stable")
        start, begin, length = starts[order], np.maximum(starts, 0)[order], length[order]
        now = np.zeros(len(start), dtype=np.int64)
        now[np.flatnonzero(order == 0)] = state
        lanes = np.searchsorted(-length, -np.arange(int(length[0]) + 1), side="left").tolist()  # how many are longer than k
        k = 0
        while lanes[k] >= FEW_LANES:
            live = lanes[k]
            at = begin[:live] + k
            key = now[:live] * 256 + data[at]
            now[:live], token = self.next[key], self.ends[key]
            todo = np.arange(live)
            while len(todo):
                mine = token[todo]
                before = at[todo] - self.length[mine]
                inside = before >= start[todo]
                place = np.where(inside, before, 0) + back
                good = self._follows(np.where(inside, last[place], -1), mine)
                done = todo[good]
                last[at[done] + back] = mine[good]
                count[at[done] + back] = np.where(inside[good], count[place[good]], 0) + 1
                todo = todo[~good]
                token[todo] = self.shorter[token[todo]]
            k += 1
        for lane in range(lanes[k]):
            s, a, first = int(now[lane]), int(begin[lane]), int(start[lane])
            for p, byte in enumerate(data[a + k:a + int(length[lane])].tolist(), a + k):
                key = s << 8 | byte
                s, token = self.next.item(key), self.ends.item(key)
                while True:
                    before = p - self.length.item(token)
                    prior = last.item(before + back) if before >= first else -1
                    asked = (prior + 1) << 20 | token
                    slot = (asked * 0x9E3779B1 >> 12) & (ANSWERS - 1)
                    good = self.answer.item(slot) if self.asked.item(slot) == asked else bool(self._follows(np.array([prior]), np.array([token]))[0])
                    if good:
                        break
                    token = self.shorter.item(token)
                last[p + back] = token
                count[p + back] = (count.item(before + back) if before >= first else 0) + 1
            now[lane] = s
        return int(now[np.flatnonzero(order == len(order) - 1)[0]])

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = [text]
            for special in self.special:
                cut = [piece for part in cut for piece in part.split(special)]
            out[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        if not parts:
            return out
        counts = np.zeros(len(parts), dtype=np.int64)
        # Of a piece that goes on into the next window: its state, its bytes so far, and the last tokens and counts at its end.
        part, cutter, state, sofar = 0, FRESH, 0, 0
        back = self.longest_token
        tail = np.zeros(back, dtype=np.int32), np.zeros(back, dtype=np.int64)
        for points, symbols, n in self._windows(BREAK.join(parts) + BREAK):
            cuts, cutter = self._cuts(symbols, cutter)
            stop = symbols == S_END
            width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
            width[stop] = 0
            begin = np.cumsum(width) - width
            data = np.frombuffer(points[~stop].tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            starts = begin[cuts & ~stop]
            if not len(starts) or starts[0] > 0:
                starts = np.append(-sofar, starts)
            else:
                state = 0
            ends = np.append(starts[1:], len(data))
            last, count = (np.concatenate([t, np.zeros(len(data), dtype=t.dtype)]) for t in tail)
            state = self._run(data, starts, ends, last, count, state)
            # What a piece adds: its count at its end, less what was there before the window.
            added = np.where(ends > np.maximum(starts, 0), count[ends - 1 + back], 0)
            added[0] -= count[back - 1] if starts[0] < 0 and ends[0] > 0 else 0
            marks = np.concatenate([[0], begin[stop], [len(data)]])
            sums = np.concatenate([[0], np.cumsum(added)])
            pieces_before = np.searchsorted(np.maximum(starts, 0), marks, side="left")
            pieces_before[0], pieces_before[-1] = 0, len(starts)
            counts[part:part + len(marks) - 1] += np.diff(sums[pieces_before])[:len(counts) - part]
            part += len(marks) - 2
            sofar = len(data) - int(starts[-1])
            tail = last[-back:], count[-back:]
            if stop[n - 1]:
                state = sofar = 0
        return out + np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


_counters: dict[str, Counter] = {}


def counter_of(key: str, vocabulary: Vocabulary) -> Counter:
    """The worker's counter for a vocabulary, kept from task to task."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of each text and whether it has more than ``limit`` tokens: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches):
        counter = counter_of(key, sent.value)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            counts = [np.empty(0, dtype=np.int64)]
            for a, b in pieces(sizes.tolist(), 4 * WINDOW):
                counts.append(counter.count(texts.slice(a, b - a).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(np.concatenate(counts))],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
