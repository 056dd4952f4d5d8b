"""Helpers shared by the operators: column picking, shared-folder tables and hashing of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feaslens.session import shared_folder

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows as a table in the folder that all executors share and reads them back: lineage is cut, the work is done once."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: further columns can't clash."""
    return docs.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, … modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 2), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def _block_hashes(data: np.ndarray, breaks: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start bytes and stem hashes of the words in one block that begins and ends outside a word."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = breaks[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    back = _power(_INVERSE, len(data) + 1)[starts]
    whole = mix64((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64) * _GOLD)
    cut = np.minimum(ends, starts + stem)
    return whole, starts, mix64((sums[cut] - sums[starts]) * back + np.uint64(stem)) if stem else whole


def word_hashes(texts: list[bytes], breaks: np.ndarray = _SPACE, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts (UTF-8, A-Z in lower case), their byte offsets, where each text's words begin, and hashes of the first ``stem`` bytes.

    ``breaks`` tells which bytes part words; white space has to be among them.

    Work goes in blocks of about one MB cut at white space, so memory stays a few times the text however long it is.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    hashes, starts, stems, at = [], [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not breaks[data[end]]:
            more = np.flatnonzero(breaks[data[end:end + BLOCK]])
            end = end + int(more[0]) if len(more) else min(end + BLOCK, len(data))
        h, s, cut = _block_hashes(data[at:end], breaks, stem)
        hashes.append(h)
        starts.append(s + at)
        stems.append(cut)
        at = end
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    first = np.searchsorted(s, begins)
    return h, s - np.repeat(begins[:-1], np.diff(first)), first, np.concatenate(stems) if stems else h


_WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64) * _GOLD) | np.uint64(1)


def shingle_hashes(words: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per text and where each text's shingles begin; a text with fewer words has one, the whole sequence."""
    counts = np.diff(begins)
    out_counts = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out_begins = np.zeros(len(begins), dtype=np.int64)
    np.cumsum(out_counts, out=out_begins[1:])
    total = int(out_begins[-1])
    if not total:
        return np.empty(0, dtype=np.uint64), out_begins
    doc = np.repeat(np.arange(len(counts)), out_counts)
    first = begins[:-1][doc] + np.arange(total) - out_begins[:-1][doc]
    padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
    length = np.minimum(counts, size)[doc]
    h = length.astype(np.uint64)
    for i in range(size):
        part = padded[first + i] * _WEIGHTS[i]
        h = h + (part if counts.min(initial=size) >= size else np.where(length > i, part, np.uint64(0)))
    return mix64(h), out_begins


def pieces(sizes: list[int], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring items with about ``limit`` in total, at least one item each."""
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= limit):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def utf8(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


SIEVE_BITS = 1 << 25


def sieve(wanted: DataFrame, name: str) -> np.ndarray:
    """A bit for each remainder that a 64-bit name in the column leaves, 4 MB whatever the data: tells which rows can't be wanted before they are shuffled."""
    place = F.pmod(F.col(name), F.lit(SIEVE_BITS))
    words = wanted.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def passes(bits: np.ndarray, name: int) -> bool:
    at = name % SIEVE_BITS
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)
