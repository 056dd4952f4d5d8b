"""Document fingerprints: MinHash over distinct runs of five words.

Shingles and their hashes are computed for whole Arrow batches in numpy; 128 universal hash functions (odd multiplier and offset modulo 2^64, upper
half kept) give the minima. A fingerprint keeps 16 bits of each minimum in hexadecimal; the share of equal places estimates Jaccard similarity.

Defined cases: a null text is an empty text, and all empty texts share the fingerprint of 'f's (likeness 1 to each other); a text with
fewer than five words is one shingle; rows with a null or a repeated id are kept, in the order of id (nulls last) and text; the single
row of a table follows itself; columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feaslens.llm import ngram_join
from feaslens.llm.common import BLOCK, mix64, partitions, pick, pieces, shingle_hashes, stored, text_of, utf8, word_hashes
from feaslens.llm.graph import components
from feaslens.operators.ordered import bucket_of

PERMUTATIONS = 128
SHINGLE = 5
#: 32 bands of 4 places: a pair at similarity 0.75 shares a band with probability 0.99999.
BAND = 4
CHUNK = 1 << 15

_A = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_B = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def minima(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(texts, permutations): the smallest value of each hash function over each text's shingles."""
    out = np.full((len(begins) - 1, PERMUTATIONS), np.uint64(0xFFFFFFFFFFFFFFFF))
    x = shingles >> np.uint64(32)
    work = np.empty(CHUNK, dtype=np.uint64)
    for at in range(0, len(x), CHUNK):
        part = x[at:at + CHUNK]
        first, last = np.searchsorted(begins, at, side="right") - 1, np.searchsorted(begins, at + len(part), side="left")
        starts = np.clip(begins[first:last] - at, 0, None)
        full = np.flatnonzero(np.minimum(begins[first + 1:last + 1] - at, len(part)) > starts)
        docs, starts, h = full + first, starts[full], work[:len(part)]
        for p in range(PERMUTATIONS):
            np.multiply(part, _A[p], out=h)
            np.add(h, _B[p], out=h)
            out[docs, p] = np.minimum(out[docs, p], np.minimum.reduceat(h, starts))
    return out


def signatures(texts: list[bytes]) -> np.ndarray:
    """16-bit places of the fingerprints, most significant byte first."""
    words, _, begins, _ = word_hashes(texts)
    return (minima(*shingle_hashes(words, begins, SHINGLE)) >> np.uint64(32)).astype(">u2")


def signatures_of(texts: list[bytes]) -> np.ndarray:
    """The same for any number of texts, in pieces of about a MB."""
    parts = [signatures(texts[a:b]) for a, b in pieces([len(t) for t in texts])]
    return np.concatenate(parts) if parts else np.empty((0, PERMUTATIONS), dtype=">u2")


def _hex(places: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in places]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = signatures_of(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_hex(places), pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def likeness(a: Column, b: Column, width: int = 4) -> Column:
    """Share of equal places of two fingerprints."""
    places = F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1))
    at = lambda c, i: F.substring(c, i * width + 1, F.lit(width))
    return F.size(F.filter(places, lambda i: at(a, i) == at(b, i))) / F.lit(PERMUTATIONS)


def in_descending_chain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in partitions that each hold one range of ids in descending order, followed by a copy of the row that comes next (``ghost``).

    Range bounds are ids of the table, so the row after a range is the one at the bound; after the smallest id comes the largest.
    """
    n = partitions(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    levels = [i / n for i in range(1, n)]
    cuts = rows.agg(F.max("doc_id").alias("top"), (F.array_sort(F.array_distinct(F.percentile_approx("doc_id", levels, 100 * n))) if levels
                                                   else F.array().cast("array<bigint>")).alias("cuts"))
    cuts = cuts.select("top", F.coalesce(F.filter("cuts", lambda c: c < F.col("top")), F.array().cast("array<bigint>")).alias("cuts"))
    # One row; the ranges are numbered by how many cuts lie below an id.
    rows = rows.crossJoin(F.broadcast(cuts)).withColumns({
        "range": F.coalesce(bucket_of(F.col("doc_id") - 1, F.col("cuts"), n), F.lit(0)), "upto": bucket_of(F.col("doc_id"), F.col("cuts"), n)})
    place = lambda at, ghost: F.struct(at.alias("range"), F.lit(ghost).alias("ghost"))
    places = F.array(place(F.col("range"), 0), F.when(F.col("upto") > F.col("range"), place(F.col("upto"), 1)), F.when(F.col("doc_id") == F.col("top"), place(F.lit(0), 1)))
    rows = rows.select("doc_id", "text", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("doc_id", "text", "p.range", "p.ghost")
    return rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64(text_of()))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next document's (descending id)."""
    rows = in_descending_chain(docs, id_col, text_col)
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def out(ids: list, texts: list[str], places: np.ndarray) -> pa.RecordBatch:
        """All rows but the last, which is only what follows."""
        edited = [_edited(t, f).encode() for t, f in zip(texts, texts[1:])]
        changed = signatures_of(edited)
        own, after = places[:-1], places[1:]
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], kind), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array(_hex(own), pa.string()), pa.array(_hex(changed), pa.string()),
            pa.array((own == changed).mean(axis=1)), pa.array((own == after).mean(axis=1))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, whose follower is not read yet
        first: tuple | None = None
        closed = False
        for batch in batches:
            ids, ghosts, texts = batch.column("doc_id").to_pylist(), batch.column("ghost").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in pieces([len(t) for t in texts], 4 * BLOCK):
                if closed:
                    break
                if ghosts[b - 1]:
                    b = a + ghosts[a:b].index(1) + 1
                    closed = True
                places = signatures_of([t.encode() for t in texts[a:b]])
                first = first or (ids[a], texts[a], places[:1])
                group = (ids[a:b], texts[a:b], places)
                if held:
                    group = (held[0] + group[0], held[1] + group[1], np.concatenate([held[2], group[2]]))
                if len(group[0]) > 1:
                    yield out(*group)
                held = (group[0][-1:], group[1][-1:], group[2][-1:])
        if held and not closed:  # ids are all null: the chain ends where it began
            yield out(held[0] + [first[0]], held[1] + [first[1]], np.concatenate([held[2], first[2]]))

    return rows.select("doc_id", "text", "ghost").mapInArrow(run, schema)


def bands(rows: DataFrame) -> DataFrame:
    """(band, sid) of every different set of shingles, from rows with ``text``: the band's number and its places as one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in pieces([len(t) for t in texts], 4 * BLOCK):
                sets = {ngram_join.digest(s): i for i, s in enumerate(ngram_join.token_sets(texts[a:b])) if len(s)}
                places = signatures_of(texts[a:b])[list(sets.values())].reshape(len(sets), PERMUTATIONS // BAND, BAND).astype(np.uint64)
                key = np.zeros(places.shape[:2], dtype=np.uint64)
                for j in range(BAND):
                    key = mix64(key + places[:, :, j] + np.uint64(1))
                key = mix64(key + np.arange(PERMUTATIONS // BAND, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.array(list(sets), dtype=np.int64), PERMUTATIONS // BAND))], names=["band", "sid"])

    return rows.select("text").mapInArrow(run, "band long, sid long").distinct()


def near_copies(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): the smallest id reachable over pairs that share a band and whose Jaccard similarity, counted on the sets, is ``percent`` or more.

    Each set is held against the first of its bands; what these links join is one cluster, and after that only pairs of different clusters in one band are left.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    sets = stored(ngram_join.documents_sets(rows, percent), "sets")
    banded = stored(bands(rows), "bands")
    lead = banded.groupBy("band").agg(F.min("sid").alias("u"), F.count("*").alias("held")).filter("held > 1").drop("held")
    shared = stored(banded.join(lead, "band"), "shared-bands")
    texts = stored(ngram_join.texts_of(rows, shared.select("sid").distinct()), "texts")
    links = stored(ngram_join.verified(shared.filter("u <> sid").select("u", F.col("sid").alias("v")).distinct(), texts, percent), "links")
    clusters = stored(components(links), "clusters")
    rooted = stored(shared.select("band", "sid").join(clusters.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    several = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
    across = stored(rooted.join(several, "band", "left_semi"), "across")
    a, b = across.alias("a"), across.alias("b")
    rest = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.sid") < F.col("b.sid"))).select(
        F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct()
    every = stored(ngram_join.verified(rest, texts, percent), "links").unionByName(clusters.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return ngram_join.classes_of(sets, components(every)).select("doc_id", "component_id")
