"""Vector code compression: product codes whose codebooks are fitted by exact Lloyd rounds over two trees.

Vectors become integers and are cut into equal parts. For each block of rows and each part position a tree of boxes is built once, halved at the
widest side, with the sum of the parts of every node, and stored as a table. In each round a small tree over the codebook's entries meets the tree of
the parts: bounds on the squared distance between two boxes rule out pairs of nodes, a node left with a single entry is assigned whole by its stored sum, and only
the parts of leaves with several entries left are compared, as integers. Tasks send sums and counts per entry; the driver holds the codebooks,
whose size is set by the parameters and the width of a vector.

Sums travel in limbs of 30 bits and numbers too large for 64-bit distances are compared as Python integers, so all rounds are exact.

Defined cases: a row whose vector is null or holds null or non-finite components is dropped; rows without id come last where the first codebook is picked, and rows with
equal ids go by their vectors; fewer rows than entries make a smaller codebook; shorter vectors, and lengths the parts don't divide, are read as if zeros
followed; an error that no bigint holds is given as the largest one; repeated rows are coded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feaslens.llm.common import pick, stored

SCALE = 256
#: Parts a leaf has at most about; components a block of rows holds at most; components compared at a time.
LEAF = 24
BLOCK_CELLS = 1 << 21
AT_A_TIME = 1 << 20
LIMB = 30
LARGEST = (1 << 63) - 1
#: Rows of one label go to so many shares when the label's error is joined back.
SHARES = 32

TREES = "ids binary, n bigint, wide boolean, parts array<binary>, orders array<binary>, boxes array<binary>"


def _levels(n: int, leaf: int) -> list[np.ndarray]:
    """First rows of the nodes of each level of a halving tree over n rows, with n itself at the end."""
    levels = [np.array([0, n])]
    while n and n >> (len(levels) - 1) > leaf:
        s = levels[-1]
        middle = (s[:-1] + s[1:]) // 2
        levels.append(np.append(np.stack([s[:-1], middle], axis=1).ravel(), n))
    return levels


def _tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows in the tree, and lowest and highest corner and sum of every node, level by level."""
    n = len(x)
    order, stats = np.arange(n), []
    levels = _levels(n, leaf)
    for depth, starts in enumerate(levels):
        y, s = x[order], starts[:-1]
        low, high = np.minimum.reduceat(y, s, axis=0), np.maximum.reduceat(y, s, axis=0)
        stats.append(np.stack([low, high, np.add.reduceat(y, s, axis=0)], axis=1))
        if depth + 1 < len(levels):
            node = np.repeat(np.arange(len(s)), np.diff(starts))
            side = np.argmax(high - low, axis=1)[node]
            order = order[np.lexsort((y[np.arange(n), side], node))]
    return order, np.concatenate(stats)


def _apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between pairs of boxes (rows of lowest and highest corners)."""
    gap = np.maximum(np.maximum(a[:, 0] - b[:, 1], b[:, 0] - a[:, 1]), 0)
    reach = np.maximum(a[:, 1] - b[:, 0], b[:, 1] - a[:, 0])
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def _runs(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal numbers."""
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(node)))


def _prune(node: np.ndarray, entry: np.ndarray, boxes: np.ndarray, entry_boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a node of parts and a node of entries that may hold a nearest entry; pairs are sorted by the node of parts."""
    least, most = _apart(boxes[node], entry_boxes[entry])
    first, count = _runs(node)
    bound = np.repeat(np.minimum.reduceat(most, first), count)
    keep = least <= bound
    return node[keep], entry[keep]


class Book:
    """A part position's codebook with the tree over its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order, stats = _tree(entries, 1)
        self.levels = _levels(len(entries), 1)
        at = np.cumsum([0] + [len(s) - 1 for s in self.levels])
        self.boxes = [stats[a:b, :2] for a, b in zip(at, at[1:])]

    def assign(self, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
        """Entry of every part (rows in tree order); and of every node assigned whole: its rows, its entry and its sum."""
        out = np.empty(len(x), dtype=np.int64)
        whole: list[tuple[int, int, int, np.ndarray]] = []
        levels = _levels(len(x), LEAF)
        at = np.cumsum([0] + [len(s) - 1 for s in levels])
        node, entry, deep = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0
        for depth, starts in enumerate(levels):
            boxes, last = stats[at[depth]:at[depth + 1]], depth + 1 == len(levels)
            node, entry = _prune(node, entry, boxes, self.boxes[deep])
            # The tree of entries is the shallower one: it goes down two levels at a time, at the leaves to its bottom.
            for _ in range(len(self.levels) if last else 2):
                if deep + 1 < len(self.levels):
                    deep += 1
                    node, entry = np.repeat(node, 2), np.stack([entry * 2, entry * 2 + 1], axis=1).ravel()
                    node, entry = _prune(node, entry, boxes, self.boxes[deep])
            first, count = _runs(node)
            if deep + 1 == len(self.levels):
                single = (count == 1) & (np.diff(self.levels[deep])[entry[first]] == 1)
                for i in first[single].tolist():
                    a, b = int(starts[node[i]]), int(starts[node[i] + 1])
                    e = int(self.order[self.levels[deep][entry[i]]])
                    out[a:b] = e
                    whole.append((a, b, e, boxes[node[i], 2]))
                keep = np.repeat(~single, count)
                node, entry = node[keep], entry[keep]
                first, count = _runs(node)
            if not len(node):
                return out, whole
            if not last:  # both halves of a node meet the same nodes of entries
                group = np.repeat(np.arange(len(first)), count)
                place = np.arange(len(node)) + first[group]
                halves = np.empty((2, 2 * len(node)), dtype=np.int64)
                for half in (0, 1):
                    halves[:, place + half * count[group]] = node * 2 + half, entry
                node, entry = halves
        self._compare(x, levels[-1], node, entry, out)
        return out, whole

    def _compare(self, x: np.ndarray, starts: np.ndarray, node: np.ndarray, entry: np.ndarray, out: np.ndarray) -> None:
        """Integer distances of the parts in uncertain leaves to the entries left for the leaf; ties go to the lower entry."""
        bottom = self.levels[-1]
        size = np.diff(bottom)[entry]
        node = np.repeat(node, size)
        step = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
        entry = self.order[np.repeat(bottom[entry], size) + step]
        by = np.lexsort((entry, node))
        node, entry = node[by], entry[by]
        first, count = _runs(node)
        rows = np.diff(starts)[node[first]]
        cells = np.cumsum(rows * count * x.shape[1])
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(cells, (cells[a - 1] if a else 0) + AT_A_TIME, side="right")))
            leaf = np.repeat(np.arange(a, b), rows[a:b])
            row = np.arange(len(leaf)) - np.repeat(np.cumsum(rows[a:b]) - rows[a:b], rows[a:b]) + starts[node[first[leaf]]]
            many = count[leaf]
            begin = np.cumsum(many) - many
            choice = np.arange(int(many.sum())) - np.repeat(begin, many) + np.repeat(first[leaf], many)
            gap = np.repeat(x[row], many, axis=0) - self.entries[entry[choice]]
            distance = (gap * gap).sum(axis=1)
            hit = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, begin), many))
            out[row] = entry[choice[hit[np.searchsorted(hit, begin)]]]
            a = b


def _integers(values: np.ndarray) -> tuple[np.ndarray, bool]:
    """floor(256 x), as 64-bit integers where squared distances of whole vectors can't overflow; else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or not scaled.size or np.abs(scaled).max() < 2.0 ** (30 - max(0, values.shape[1] - 1).bit_length() // 2):
        return scaled.astype(np.int64), False
    whole = [[int(v) * SCALE if abs(v) >= 2.0 ** 53 else int(np.floor(v * SCALE)) for v in row] for row in values.tolist()]
    return np.array(whole, dtype=object), True


def _packed(x: np.ndarray) -> bytes:
    return b"".join(int(v).to_bytes(136, "little", signed=True) for v in x.ravel()) if x.dtype == object else x.astype("<i8").tobytes()


def _unpacked(data: bytes, wide: bool, width: int) -> np.ndarray:
    if wide:
        return np.array([int.from_bytes(data[i:i + 136], "little", signed=True) for i in range(0, len(data), 136)], dtype=object).reshape(-1, width)
    return np.frombuffer(data, dtype="<i8").reshape(-1, width)


def _dense(vectors: pa.Array, length: int) -> np.ndarray:
    """Rows of the list column, filled up with zeros."""
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.float64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), length))
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _build(parts: int, length: int):
    width = length // parts

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            step = max(1, BLOCK_CELLS // max(1, length))
            for a in range(0, batch.num_rows, step):
                block = batch.slice(a, step)
                x, wide = _integers(_dense(block.column("vector"), length))
                cut = [x[:, p * width:(p + 1) * width] for p in range(parts)]
                trees = [(np.arange(len(x)), np.empty((0, 3, width), dtype=np.int64)) if wide or not width else _tree(c, LEAF) for c in cut]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_ipc(block.select(["vec_id", "label"]))], pa.binary()), pa.array([len(x)], pa.int64()), pa.array([wide]),
                    pa.array([[_packed(c[order]) for c, (order, _) in zip(cut, trees)]], pa.list_(pa.binary())),
                    pa.array([[order.astype("<i4").tobytes() for order, _ in trees]], pa.list_(pa.binary())),
                    pa.array([[stats.astype("<i8").tobytes() for _, stats in trees]], pa.list_(pa.binary()))],
                    names=["ids", "n", "wide", "parts", "orders", "boxes"])
    return run


def _plain(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Nearest entries where numbers are too large for the trees: Python integers, every entry."""
    best, book = np.zeros(len(x), dtype=np.int64), entries.tolist()
    if x.shape[1]:
        for i, row in enumerate(x.tolist()):
            best[i] = min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(row, book[e])), e))
    return best


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray]):
    """Per part position of each block: parts in tree order, their entries, nodes assigned whole and the order."""
    width = books[0].shape[1] if books else 0
    for i in range(batch.num_rows):
        wide = batch.column("wide")[i].as_py()
        blobs = {k: batch.column(k)[i].values for k in ("parts", "orders", "boxes")}
        out = []
        for p, entries in enumerate(books):
            order = np.frombuffer(blobs["orders"][p].as_buffer(), dtype="<i4")
            x = _unpacked(blobs["parts"][p].as_py(), wide, width) if width else np.empty((len(order), 0), dtype=np.int64)
            if wide or not width or entries.dtype == object:
                out.append((x, _plain(x, entries), [], order))
            else:
                stats = np.frombuffer(blobs["boxes"][p].as_buffer(), dtype="<i8").reshape(-1, 3, width)
                out.append((x, *Book(entries).assign(x, stats), order))
        yield i, out


def _limbs(value: int) -> list[int]:
    """Signed base-2^30 digits."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


SUMS = "slot int, limb int, v bigint"


def _sums(books: list[np.ndarray]):
    """Sums and counts per entry: slot = (part * entries + entry) * (width + 1) + place, the count in the last place."""
    entries, width = books[0].shape

    def run(batches):
        for batch in batches:
            for _, parts in _assigned(batch, books):
                total = np.zeros((len(parts), entries, width + 1), dtype=object)
                for p, (x, best, whole, _) in enumerate(parts):
                    open_rows = np.ones(len(x), dtype=bool)
                    for a, b, e, s in whole:
                        open_rows[a:b] = False
                        total[p, e, :width] += s.astype(object)
                        total[p, e, width] += b - a
                    rows = np.flatnonzero(open_rows)
                    rows = rows[np.argsort(best[rows], kind="stable")]
                    if len(rows):
                        names, first = np.unique(best[rows], return_index=True)
                        total[p, names, :width] += np.add.reduceat(x[rows], first, axis=0).astype(object)
                        total[p, names, width] += np.diff(np.append(first, len(rows))).astype(object)
                slots = [(slot, k, limb) for slot, value in enumerate(total.ravel().tolist()) for k, limb in enumerate(_limbs(int(value)))]
                if slots:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*slots), (pa.int32(), pa.int32(), pa.int64()))], names=["slot", "limb", "v"])
    return run


def _codes(books: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            for i, parts in _assigned(batch, books):
                ids = pa.ipc.open_stream(batch.column("ids")[i].as_buffer()).read_all().combine_chunks().to_batches()[0]
                codes = np.zeros((ids.num_rows, len(parts)), dtype=np.uint8)
                error = np.zeros(ids.num_rows, dtype=object)
                for p, (x, best, _, order) in enumerate(parts):
                    codes[order, p] = best
                    gap = x - books[p][best]
                    error[order] += (gap * gap).sum(axis=1).astype(object)
                text = codes.tobytes().hex()
                n = 2 * len(parts)
                yield pa.RecordBatch.from_arrays([
                    ids.column("vec_id"), ids.column("label"), pa.array([text[k * n:(k + 1) * n] for k in range(ids.num_rows)]),
                    pa.array([min(int(e), LARGEST) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def _next(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Entries moved to the floor of the mean of their parts."""
    entries, width = books[0].shape
    total = [0] * (len(books) * entries * (width + 1))
    for slot, limb, v in sums.groupBy("slot", "limb").agg(F.sum("v").alias("v")).collect():  # entries x (vector length + parts) x limbs at most
        total[slot] += v << (LIMB * limb)
    out = []
    for p, book in enumerate(books):
        rows = []
        for e in range(entries):
            *s, n = total[(p * entries + e) * (width + 1):(p * entries + e + 1) * (width + 1)]
            rows.append([v // n for v in s] if n else [int(v) for v in book[e]])
        out.append(_narrow(rows, width))
    return out


def _narrow(rows: list[list[int]], width: int) -> np.ndarray:
    """As 64-bit integers where distances can't overflow, as in the blocks."""
    small = all(abs(v) < 1 << (30 - max(0, width - 1).bit_length() // 2) for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), width)


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept row."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has to fit two hex digits")
    kept = pick(rows, vec_id=vec_id, vector=vector, label=label).filter(
        "vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    spark = rows.sparkSession
    length = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    length = -(-length // parts) * parts
    width = length // parts
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    filled = [_integers(np.array([[*map(float, r.vector), *[0.0] * (length - len(r.vector))]]).reshape(1, length))[0][0] for r in first]
    books = [_narrow([[int(v) for v in row[p * width:(p + 1) * width]] for row in filled], width) for p in range(parts)]
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    if first:
        trees = stored(kept.mapInArrow(_build(parts, length), TREES), "code-trees")
        for _ in range(rounds):
            books = _next(books, trees.select("wide", "parts", "orders", "boxes").mapInArrow(_sums(books), SUMS))
        schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"
        coded = stored(trees.mapInArrow(_codes(books), schema), "codes")
    else:
        coded = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    numbers = ",".join(str(int(v)) for book in books for row in book for v in row)
    largest = F.lit(LARGEST).cast("decimal(38,0)")
    errors = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("bigint").alias("label_error"))
    shares = errors.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    dealt = coded.withColumn("share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int"))
    joined = dealt.join(shares, dealt["label"].eqNullSafe(shares["_label"]) & (dealt["share"] == shares["_share"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))


COMPRESS_SQL = """
with recursive v as (
  select row_number() over () as n, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::hugeint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as (select n, p, list_slice(e, p * (len(e) // 16) + 1, (p + 1) * (len(e) // 16)) as x from v, (select unnest(range(16)) as p)),
first as (select n, row_number() over (order by vec_id, e) - 1 as entry from v qualify entry < 64),
b0 as (select p, entry, x as y from parts join first using (n)),
""" + ",\n".join(f"""a{i} as (
  select n, p, min({{'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': entry}}) as best
  from parts join b{i} using (p) group by n, p)""" + (f""",
m{i} as (
  select p, entry, i, floor_div.q as y from (
    select p, best.entry as entry, i, sum(x[i]) as s, count(*) as c from a{i} join parts using (n, p), (select unnest(range(1, 257)) as i) where i <= len(x) group by all) t,
    lateral (select case when s >= 0 then s // c else -((-s + c - 1) // c) end as q) floor_div),
b{i + 1} as (
  select p, entry, coalesce(z.y, b{i}.y) as y from b{i} left join (select p, entry, list(y order by i) as y from m{i} group by all) z using (p, entry))""" if i < 2 else "")
    for i in range(3)) + """,
coded as (
  select vec_id, label, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error
  from a2 join v using (n) group by n, vec_id, label),
books as (select sha256(string_agg(array_to_string(y, ','), ',' order by p, entry)) as codebooks_sha256 from b2),
labels as (select label, sum(error)::bigint as label_error from coded group by label)
select vec_id, code, error, label_error, codebooks_sha256 from coded c join labels l on c.label is not distinct from l.label, books
"""
