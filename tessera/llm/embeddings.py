"""Embedding near-dedup by an epsilon grid order join.

On unit vectors, cosine >= c is a distance of at most epsilon = sqrt(2 - 2c).
Vectors are projected on leading principal directions and sorted by their grid
cells of width epsilon, which cuts each label into blocks that are intervals of
the sequence.  Intervals of ``FAN`` blocks, of ``FAN`` such intervals and so on
have boxes, too.  The join starts with each label's whole sequence against
itself and descends: of each pair of intervals whose boxes are no further apart
than epsilon the pairs of parts are looked at, all others are skipped unseen.
Only boxes move until single blocks are left; then each pair of intervals of
blocks gets those vectors that are still wanted, and the recursion goes on
inside: intervals are halved, distant halves skipped, and leaves compared
exactly in double precision.

Equal vectors of a label are one class and are compared once.  A join returns
for each class its number of links and a local spanning forest, never pairs.
The basis is fitted to a bounded sample; it only affects what can be skipped.

Vectors that are null, zero or hold null or non-finite components, and rows with
a null label or vec_id, link with nothing and are kept; the component of a row
without a vec_id is null.  Vectors of different lengths do not link.  Repeated
rows link.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import components, local_forest

SAMPLE = 4096
LEADING = 8
FAN = 8


def classes(vectors: DataFrame) -> DataFrame:
    """label, embedding, class_id (least vec_id) and n of the distinct comparable vectors."""
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.coalesce(fit, F.lit(False))).groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of one length, none of them null, in the precision they have."""
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(found: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, an orthonormal basis of leading directions, from a bounded sample."""
    rows = found.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("embedding").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(list(r[0]))
    out = {}
    for d, x in by.items():
        u = unit(np.array(x, np.float64))
        _, v = np.linalg.eigh((u - u.mean(0)).T @ (u - u.mean(0)))
        out[d] = v[:, ::-1][:, :LEADING]
    return out


def _projected(u: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    d = u.shape[1]
    p = u @ basis[d] if d in basis else u[:, :LEADING]
    return np.pad(p, ((0, 0), (0, LEADING - p.shape[1])))


def precision(found: DataFrame) -> str:
    return "<f4" if found.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def blocks(found: DataFrame, epsilon: float, block_rows: int) -> DataFrame:
    """Intervals of the sequence in epsilon grid order: block, label, dim, box, and members."""
    basis = principal(found)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = pc.list_value_length(table.column("embedding")).to_numpy()
            for d in np.unique(sizes).tolist():
                part = table.filter(pa.array(sizes == d))
                x = _matrix(part.column("embedding"))
                grid = np.floor(_projected(unit(x), basis) / epsilon).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("label").combine_chunks(), pa.array(np.full(len(x), d, np.int32)), pa.array(grid.tolist(), pa.list_(pa.int64())), part.column("class_id").combine_chunks(), part.column("n").combine_chunks(), pa.array([r.astype(kind).tobytes() for r in x], pa.binary())], names=["label", "dim", "cell", "class_id", "n", "vector"])

    label = found.schema["label"].dataType.simpleString()
    kind = precision(found)
    seq = found.select("label", "embedding", "class_id", "n").mapInArrow(cells, f"label {label}, dim int, cell array<long>, class_id long, n long, vector binary")
    parts = max(1, found.count() // (8 * block_rows))
    key = ["label", "dim", "cell", "class_id"]  # class_id splits a cell that many share
    seq = seq.repartitionByRange(parts, *key).sortWithinPartitions(*key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = 0, []
        part = TaskContext.get().partitionId() << 32

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal k
            k += 1
            x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(rows.num_rows, -1)
            p = _projected(unit(x), basis)
            one = lambda c: rows.column(c)[0].as_py()
            return pa.RecordBatch.from_pydict({"block": [part + k], "label": rows.column("label").slice(0, 1).combine_chunks(), "dim": pa.array([one("dim")], pa.int32()), "low": [p.min(0).tolist()], "high": [p.max(0).tolist()], "ids": [rows.column("class_id").to_numpy().astype("<i8").tobytes()], "n": [rows.column("n").to_numpy().astype("<i8").tobytes()], "vectors": [x.tobytes()]})

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block_rows:
                rest = pa.Table.from_batches(held)
                held = []
                while rest.num_rows:
                    run = _run(rest)
                    if run == rest.num_rows and rest.num_rows < block_rows:
                        break
                    take = min(run, block_rows)
                    yield block(rest.slice(0, take))
                    rest = rest.slice(take)
                held = rest.to_batches()
        rest = pa.Table.from_batches(held) if held else None
        while rest is not None and rest.num_rows:
            take = min(_run(rest), block_rows)
            yield block(rest.slice(0, take))
            rest = rest.slice(take)

    return checkpoint(seq.mapInArrow(cut, f"block long, label {label}, dim int, low array<double>, high array<double>, ids binary, n binary, vectors binary"))


def _run(table: pa.Table) -> int:
    """Leading rows with the label and length of the first."""
    label, dim = table.column("label").to_pylist(), table.column("dim").to_numpy()
    other = np.flatnonzero((dim != dim[0]) | np.array([x != label[0] for x in label]))
    return int(other[0]) if len(other) else table.num_rows


class _Side:
    """Blocks of one interval, in the order of the sequence."""

    def __init__(self, rows: list[dict], kind: str) -> None:
        rows = sorted(rows, key=lambda r: r["block"])
        self.ids, self.n = (np.frombuffer(b"".join(r[c] for r in rows), "<i8") for c in ("ids", "n"))
        self.u = unit(np.frombuffer(b"".join(r["vectors"] for r in rows), kind).reshape(len(self.ids), -1))


def _join(a: _Side, b: _Side, ra: slice, rb: slice, same: bool, epsilon: float, cosine: float, out: list, leaf: int = 128) -> None:
    """Recursive join of two intervals; same: both are of one block, each pair is met once."""
    x, y = a.u[ra], b.u[rb]
    gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
    if (gap * gap).sum() > (epsilon * 1.000001) ** 2:
        return
    if len(x) <= leaf and len(y) <= leaf:
        i, j = np.nonzero(x @ y.T >= cosine)
        if same and ra == rb:
            i, j = i[i < j], j[i < j]
        out.append((i + ra.start, j + rb.start))
        return
    halves = lambda r, n: [r] if n <= leaf else [slice(r.start, r.start + n // 2), slice(r.start + n // 2, r.stop)]
    for p in halves(ra, len(x)):
        for q in halves(rb, len(y)):
            if not same or p.start <= q.start:
                _join(a, b, p, q, same, epsilon, cosine, out, leaf)


def close(epsilon: float) -> Column:
    """Whether the boxes (low, high) and (low2, high2) are at most epsilon apart."""
    gaps = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= (epsilon * 1.000001) ** 2


def near_blocks(table: DataFrame, epsilon: float) -> DataFrame:
    """(a, b, up, up2) of all pairs of blocks whose boxes are near, and the intervals of blocks that they lie in.

    An interval of level k is a part of the sequence over FAN ** (k - 1) ranges
    of the sort; level 0 are the blocks.
    """
    meta = table.select("block", F.xxhash64("label", "dim").alias("kind"), F.shiftright("block", 32).alias("range"), "low", "high")
    top = meta.agg(F.max("range")).first()[0] or 0
    height = 1
    while top >> (3 * (height - 1)):  # FAN is 2 ** 3
        height += 1

    def interval(level: int) -> Column:
        return F.xxhash64("kind", F.shiftright("range", 3 * (level - 1)), F.lit(level))

    def level(k: int) -> DataFrame:
        node = F.col("block") if k == 0 else interval(k)
        up = interval(k + 1) if k < height else F.lit(0).cast("long")
        each = meta.select(node.alias("node"), up.alias("up"), "low", "high", F.col("range" if k else "block").alias("first"))
        if k == 0:
            return each
        ends = [F.array(*[f(F.col(c)[i]) for i in range(LEADING)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
        return each.groupBy("node", "up").agg(F.min("first").alias("first"), *ends)

    pairs = level(height).select(F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(height - 1, -1, -1):
        part = level(k).select("node", "up", "first", "low", "high")
        left = pairs.join(part, F.col("a") == F.col("up")).select("b", F.col("node").alias("x"), F.col("up").alias("up1"), "first", "low", "high")
        right = part.select(F.col("node").alias("y"), F.col("up").alias("up2"), F.col("first").alias("first2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = left.join(right, (F.col("b") == F.col("up2")) & ((F.col("up1") != F.col("up2")) | (F.col("first") <= F.col("first2"))) & close(epsilon))
        pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("up1").alias("up"), "up2")
        pairs = checkpoint(pairs.select("a", "b")) if k else pairs
    return pairs


def linked(found: DataFrame, cosine: float, block_rows: int = 512) -> DataFrame:
    """(id, links, other): a class's links of one join, and an edge of a spanning forest or null."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) or 1e-9
    kind = precision(found)
    table = blocks(found, epsilon, block_rows)
    pairs = near_blocks(table, epsilon)
    wanted = pairs.select("up", "up2", F.explode(F.array(F.struct(F.col("a").alias("w"), F.lit(True).alias("left")), F.struct(F.col("b").alias("w"), F.lit(False).alias("left")))).alias("w"))
    wanted = wanted.groupBy("up", "up2", "w.w").agg(F.max("w.left").alias("left"))  # a block is on both sides only of an interval with itself
    loaded = wanted.join(table.select("block", "ids", "n", "vectors"), F.col("w") == F.col("block")).drop("w")

    def join(group: pa.Table) -> pa.Table:
        same = group.column("up")[0].as_py() == group.column("up2")[0].as_py()
        rows = group.select(["block", "left", "ids", "n", "vectors"]).to_pylist()
        a = _Side(rows if same else [r for r in rows if r["left"]], kind)
        b = a if same else _Side([r for r in rows if not r["left"]], kind)
        got: list = []
        _join(a, b, slice(0, len(a.ids)), slice(0, len(b.ids)), same, epsilon, cosine, got)
        i = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in got]])
        j = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in got]])
        every, at = np.unique(np.concatenate([a.ids, b.ids]), return_inverse=True)
        links = np.concatenate([np.bincount(i, b.n[j], len(a.ids)), np.bincount(j, a.n[i], len(b.ids))])
        total = np.bincount(at, links, len(every)).astype(np.int64)
        node, root = local_forest(a.ids[i], b.ids[j])
        some = total > 0
        return pa.table({"id": np.concatenate([every[some], node]), "links": np.concatenate([total[some], np.zeros(len(node), np.int64)]), "other": pa.array([None] * int(some.sum()) + root.tolist(), pa.int64())})

    return loaded.groupBy("up", "up2").applyInArrow(join, "id long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    found = checkpoint(classes(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").where("vec_id is not null")))
    joined = checkpoint(linked(found, cosine))
    links = joined.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(joined.where("other is not null"), "id", "other").withColumnRenamed("node", "k")
    each = found.join(links, F.col("class_id") == F.col("id"), "left").join(roots, F.col("class_id") == F.col("k"), "left")
    each = each.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    rows = vectors.select("vec_id", "label", "embedding").join(each, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
