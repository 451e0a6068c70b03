"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits if and only if some value lies within
h bits of both.  Every distinct fingerprint emits all values of its ball of
radius h; those who share a value are linked, and the triangle inequality
proves the link.  The shuffle is on the leading bits of the values: a
fingerprint goes once to each bucket that its ball reaches, with the bits that
it may still flip, and the rest of the ball is unfolded there.  A bucket's
values number about the same at every input size, as more input means more
leading bits.

Within a value all are linked with its least fingerprint, and within a bucket
only a spanning forest leaves, so a group costs rows in proportion to its size
and no link between groups is lost.  Components are found over distinct
fingerprints; equal texts have met before as one.

Null, empty or blank texts have fingerprint zero and link like any other.
Repeated rows link; the component is the smallest doc_id reached.  Rows with a
null doc_id link, too; their component is the smallest id of the others, null
where there is none.  An empty table gives no rows.  Other columns are not
looked at by the query, and may have any names in the pipeline's stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, SPACE, as_buffer, by_bytes, checkpoint, fresh, mixed, quoted, settled, span_hashes, window_hashes, word_hashes, words
from .graph import components, local_forest


def fingerprint(words: list[bytes], k: int) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64."""
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_buffer(batch.column(1))
            raw, at = LOWER[data].tobytes(), offsets.tolist()
            fps = [fingerprint(raw[a:b].split(), k) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, fp long")


def flips(bits: int, most: int, shift: int = 0) -> list[tuple[int, int]]:
    """(mask, bits flipped) of all sets of at most ``most`` of the given bits."""
    return [(sum(1 << (b + shift) for b in c), n) for n in range(most + 1) for c in combinations(range(bits), n)]


def links(fps: DataFrame, radius: int = 4, bucket_values: int = 1 << 20) -> DataFrame:
    """(a, b): a spanning forest, within buckets, of all fingerprints at most ``radius`` bits apart.

    fps has one column fp of distinct values.  The radius must be even.
    """
    if radius % 2:
        raise ValueError("the radius must be even: it is met in the middle")
    half = radius // 2
    ball = sum(math.comb(64, i) for i in range(half + 1))
    lead = max(1, min(32, math.ceil(math.log2(max(1, fps.count()) * ball / bucket_values))))
    masks = flips(lead, half, 64 - lead)
    top = [int(np.uint64(m).view(np.int64)) for m, _ in masks]
    low = [np.array([m for m, _ in flips(64 - lead, half - used)], np.uint64) for used in range(half + 1)]
    reach = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).cast("byte").alias("used")) for m, (_, n) in zip(top, masks, strict=True)])).alias("r")
    routed = fps.select("fp", reach).select(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("r.mask")), 64 - lead).alias("bucket"), "fp", F.col("r.used").alias("used"))
    body = np.uint64((1 << (64 - lead)) - 1)

    def meet(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        used = table.column("used").to_numpy()
        values, owner = [], []
        for n in range(half + 1):
            own = fp[used == n]
            values.append(((own & body)[:, None] ^ low[n][None, :]).ravel())
            owner.append(np.repeat(own, len(low[n])))
        value, owner_ = np.concatenate(values), np.concatenate(owner)
        del values, owner
        order = np.argsort(value)
        value = value[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(value)))
        shared = size > 1
        first, size = first[shared], size[shared]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        members = owner_[order[np.repeat(first, size) + inner]].view(np.int64)
        least = np.minimum.reduceat(members, np.cumsum(size) - size) if len(size) else members
        a, b = np.repeat(least, size), members
        apart = a != b
        gap = np.unpackbits((a[apart] ^ b[apart]).view(np.uint8).reshape(-1, 8), axis=1).sum(1)
        assert (gap <= radius).all()
        node, root = local_forest(a[apart], b[apart])
        return pa.table({"a": root, "b": node})

    return routed.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = checkpoint(fingerprints(docs, doc_id, text, k))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), radius))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    return rows.join(of_class, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies at a similarity of word shingles ---------------------------

_ODD = 0x9E3779B97F4A7C15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each lower-cased text's k-word shingles.

    Fewer than k words are one shingle; no words are the set {0}.
    """
    starts, ends, bounds = words(data, offsets, ~SPACE)
    hashes = word_hashes(data, starts, ends)
    windows, at = window_hashes(hashes, bounds, k)
    cut = np.searchsorted(at, bounds)
    for d in range(len(offsets) - 1):
        own = hashes[bounds[d] : bounds[d + 1]]
        if len(own) >= k:
            yield np.unique(windows[cut[d] : cut[d + 1]])
        elif len(own):
            yield span_hashes(own, np.array([0]), np.array([len(own)]))
        else:
            yield np.zeros(1, np.uint64)


def _each_set(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, offsets = as_buffer(batch.column(1))
    for i, j in by_bytes(offsets, 1 << 20):
        yield from shingle_sets(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], k)


def sketch(hashes: np.ndarray, longs: int) -> bytes:
    """64 * longs majority bits over a set of hashes, each from its own remixing."""
    odd = mixed(np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
    ones = np.zeros(64 * longs, np.int64)
    for i in range(0, len(hashes), 255):  # a byte counts up to 255
        x = mixed(hashes[i : i + 255, None] * odd)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed long."""
    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def table_plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits, tables): bits follow the log of the input, tables follow the recall at ``similarity``.

    Sets of equal size and Jaccard J have cosine 2J / (1 + J), so a bit differs
    with probability acos(cosine) / pi; a table finds a pair within 2 bits.
    """
    bits = min(56, max(32, math.ceil(math.log2(max(2, n))) + 10))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    hit = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(3))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) if similarity < 1 else 1


def candidates(classes: DataFrame, n: int, bits: int, tables: int, bucket_values: int = 1 << 20, block: int = 1024, routed: int = 128) -> DataFrame:
    """(cloud, node, root): groups of nodes in which every candidate pair is together at least once.

    classes has node, sketch and prefix.  Table t is bits [t * bits, (t + 1) *
    bits) of the sketch; nodes within 2 bits share a value of their balls of
    radius 1.  Small sets also meet at the shingles of their prefix.  Sharing a
    value proves no link, so nobody stands for others: all who are joined by
    shared values in a bucket are a cloud, a row for each member, with its root.
    A cloud above ``block`` members has no number: it is not worth holding all
    its sketches against each other, its members go on together.

    More input means more leading bits, and a row for each of them and each
    table.  Tables are taken in passes of about ``routed`` rows a node; the rows
    of a pass are removed before the next, so that their disk does not grow
    faster than the input.
    """
    lead = max(1, min(24, math.ceil(math.log2(max(1, n) * (bits + 1) / bucket_values))))
    low = bits - lead
    step = max(1, routed // (lead + 1))

    def route(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[pa.RecordBatch]:
        stop = min(tables, start + step)
        power = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        masks = np.array([0, *[1 << i for i in range(lead)]], np.uint64)
        names = ["part", "fp", "used", "node"]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                node = batch.column(0).to_numpy()
                raw, _ = as_buffer(batch.column(1).cast(pa.large_binary()))
                on = np.unpackbits(raw.reshape(len(node), -1), axis=1)[:, bits * start : bits * stop]
                fp = (on.reshape(len(node), stop - start, bits) * power).sum(2, dtype=np.uint64)
                bucket = (fp >> np.uint64(low))[:, :, None] ^ masks
                shape = bucket.shape
                part = (np.arange(start, stop, dtype=np.int64)[None, :, None] << 32) + bucket.astype(np.int64)
                spread = lambda x: np.broadcast_to(x, shape).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), pa.array(spread(fp[:, :, None]).view(np.int64)), pa.array(spread(masks != 0)), pa.array(spread(node[:, None, None]))], names=names)
                if start:  # prefixes go with the first pass
                    continue
                blobs = batch.column(2).to_pylist()
                key = np.frombuffer(b"".join(blobs), np.uint64)
                owner = np.repeat(node, [len(x) // 8 for x in blobs])
                part = (tables << 32) + (key >> np.uint64(64 - lead)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), bool)), pa.array(owner)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        used = table.column("used").to_numpy().astype(bool)
        node = table.column("node").to_numpy()
        order = np.lexsort((node, fp))
        fp, used, node = fp[order], used[order], node[order]
        a, b = _chained(fp, node)
        if table.column("part")[0].as_py() >> 32 < tables:
            new = np.append(True, fp[1:] != fp[:-1])
            fp, used, node = fp[new], used[new], node[new]
            width = max(1, int(len(node)).bit_length())
            body, owner = fp & np.uint64((1 << low) - 1), np.arange(len(node), dtype=np.uint64)
            if low + width > 64:
                raise ValueError("a bucket holds too many fingerprints to be packed")
            flip = np.array([0, *[1 << i for i in range(low)]], np.uint64)
            near = ((body[~used, None] ^ flip) << np.uint64(width)) | owner[~used, None]
            packed = np.sort(np.concatenate([near.ravel(), (body[used] << np.uint64(width)) | owner[used]]))
            c, d = _chained(packed >> np.uint64(width), node[(packed & np.uint64((1 << width) - 1)).astype(np.int64)])
            a, b = np.append(a, c), np.append(b, d)
        return _clouds(*local_forest(a, b), block)

    passes = [partial(route, start=start) for start in range(0, tables, step)]
    found = [classes.select("node", "sketch", "prefix").mapInArrow(f, "part long, fp long, used boolean, node long").groupBy("part").applyInArrow(meet, "cloud long, node long, root long").distinct() for f in passes]
    return found[0] if len(found) == 1 else reduce(DataFrame.union, [settled(x) for x in found]).distinct()


def _chained(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of equal values: (member before, member)."""
    rest = np.flatnonzero(value[1:] == value[:-1]) + 1
    return node[rest - 1], node[rest]


def _clouds(node: np.ndarray, root: np.ndarray, block: int) -> pa.Table:
    """cloud, node and root of a forest's groups; a cloud is numbered after its members, so that equal ones are one."""
    roots = np.unique(root)
    member, of = np.concatenate([roots, node]), np.concatenate([roots, root])
    order = np.lexsort((member, of))
    member, of = member[order], of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(of)))
    name = mixed(np.add.reduceat(mixed(member.view(np.uint64)), first)).view(np.int64) if len(of) else np.zeros(0, np.int64)
    return pa.table({"cloud": pa.array(np.repeat(name, size), mask=np.repeat(size > block, size)), "node": member, "root": of})


def _grown(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root), places of 0 to n - 1: a spanning forest of all pairs that are near.

    near(i, rest) says who of rest is near i.  Each is held once against all
    who have not been reached, so pairs within a group are all that is skipped.
    """
    left, members, roots = np.arange(n), [], []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = near(queue.pop(), left)
            if hit.any():
                members.append(left[hit])
                roots.append(np.full(len(members[-1]), root))
                queue.extend(members[-1].tolist())
                left = left[~hit]
    return (np.concatenate(members), np.concatenate(roots)) if members else (left[:0], left[:0])


def _runs(key: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each key's rows."""
    order = np.argsort(key, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(key[order])) + 1)


def alike(sketches: np.ndarray, size: np.ndarray, similarity: float, most: float, loose: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest, of places, of all pairs that may reach the similarity: by their sizes and the share of differing bits.

    ``most`` bounds the share; where a set is small, ``loose`` does.
    """
    longs = sketches.shape[1]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        s = size[rest]
        less = np.minimum(s, size[i])
        out = less >= similarity * np.maximum(s, size[i]) - 1e-9
        at = np.flatnonzero(out)
        differ = np.bitwise_count(sketches[rest[at]] ^ sketches[i]).sum(1, dtype=np.int64)
        out[at] = differ <= 64 * longs * np.where(less[at] < SMALL, loose, most)
        return out

    return _grown(len(size), near)


def near_one(one: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have at least the similarity with one; all are sorted."""
    size = np.array([len(x) for x in sets], np.int64)
    if not len(size):
        return np.zeros(0, bool)
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(size) - size)
    return both >= similarity * (size + len(one) - both)


def verified(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest, of places, of all pairs of sets whose Jaccard similarity is at least ``similarity``."""
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    end = np.cumsum(size)
    own = np.zeros(int(ids.max()) + 1, bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        s = size[rest]
        out = np.minimum(s, size[i]) >= similarity * np.maximum(s, size[i]) - 1e-9
        if out.any():
            mine = ids[end[i] - size[i] : end[i]]
            own[mine] = True
            total = np.append(0, np.cumsum(own[ids], dtype=np.int64))
            own[mine] = False
            both = total[end[rest]] - total[end[rest] - s]
            out &= both >= similarity * (s + size[i] - both)
        return out

    return _grown(len(sets), near)


#: Below so many shingles ties of the majority bits bend the estimate, and prefixes are short.
SMALL = 40


def prefixed(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, prefix) of (node, small), the hashes of small sets: those that the fewest sets have, ties by the hash.

    Two sets of the similarity, both in that order, share one of their prefixes.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in blobs])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.frombuffer(b"".join(blobs), np.int64))], names=["node", "h"])

    every = sets.mapInArrow(each, "node long, h long")
    often = every.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("c"))
    ordered = every.join(often, F.col("h") == F.col("g")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h")))["h"].alias("o"))  # below SMALL entries
    length = F.size("o") - F.ceil(similarity * F.size("o") - 1e-9).cast("int") + 1
    return ordered.select("node", F.unhex(F.array_join(F.transform(F.slice("o", F.lit(1), length), lambda h: F.lpad(F.hex(h), 16, "0")), "")).alias("prefix"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, recall: float = 0.97, block: int = 256) -> DataFrame:
    """doc_id and component_id of every row: groups linked at a Jaccard similarity of k-word shingles.

    One 64-bit fingerprint is too coarse for a similarity of 0.8 (about 10 bits
    differ), so a document has several shorter ones and pairs within 2 bits in
    any of them are candidates.  Sets below SMALL shingles are candidates at a
    shared shingle of their prefix also, which misses none; a prefix holds the
    rarest shingles, so a passage that many share makes no candidates.  All bits together
    estimate a pair's similarity: who is three standard errors below the
    threshold (much further for small sets) is not held closer.  The others
    form clusters, in which every pair of groups is decided on the shingle sets
    themselves; the estimate alone links none.

    A cluster above ``block`` sets is first held against a few pivots, a row for
    each set; those that link with the best of them need no look at each other.
    The others are held against all: blocks of them meet blocks of the cluster,
    so rows are the cluster's sets times the blocks of others.  Equal sets are
    one node.  Null, empty and blank texts are equal sets; repeated rows link.
    Rows with a null doc_id are rows like others, and the smallest id is null
    where they are in a group.  ``recall`` is that of a pair right at the threshold.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("x")).alias("doc_id"), F.col(text).alias("text"))
    found = _near_copies(texts, f"struct<id:{kind},x:bigint>", k, similarity, recall, block)
    return found.select(F.col("doc_id.id").alias("doc_id"), F.col("component_id.id").alias("component_id"))


def _near_copies(texts: DataFrame, kind: str, k: int, similarity: float, recall: float, block: int) -> DataFrame:
    """near_copies() for a doc_id (never null) and a text."""
    n = texts.count()
    bits, tables = table_plan(n, similarity, recall)
    longs = -(-bits * tables // 64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(set_id(h), sketch(h, longs), len(h), h.tobytes() if len(h) < SMALL else b"") for h in _each_set(batch, k)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[c] for x in made], t) for c, t in enumerate(kinds)]], names=["doc_id", "node", "sketch", "size", "small"])

    rows = checkpoint(texts.mapInArrow(scan, f"doc_id {kind}, node long, sketch binary, size long, small binary"))
    classes = settled(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("sketch", "size", "small")]))
    prefixes = prefixed(classes.where("size < " + str(SMALL)).select("node", "small"), similarity).withColumnRenamed("node", "n")
    classes = settled(classes.drop("small").join(prefixes, F.col("node") == F.col("n"), "left").drop("n").withColumn("prefix", F.coalesce("prefix", F.lit(b""))))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    error = 2 / (2 - 2 * similarity / (1 + similarity)) ** 2 * math.pi * math.sin(math.pi * p) * math.sqrt(p * (1 - p) / (64 * longs))
    least = max(0.0, similarity - 3 * error)
    most = math.acos(2 * least / (1 + least)) / math.pi
    loose = max(most, min(0.35, p + 0.15))

    def compare(table: pa.Table) -> pa.Table:
        node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
        raw, _ = as_buffer(table.column("sketch").cast(pa.large_binary()))
        sketches = raw.reshape(len(node), -1).copy().view(np.uint64)
        found = [(node[at[x]], node[at[y]]) for at in _runs(table.column("cloud").to_numpy()) for x, y in [alike(sketches[at], size[at], similarity, most, loose)]]
        forest = local_forest(*[np.concatenate(x) for x in zip(*found, strict=True)])
        return pa.table({"a": forest[0], "b": forest[1]})

    met = settled(candidates(classes, n, bits, tables))
    near = met.where("cloud is not null").join(classes.select("node", "sketch", "size"), "node")
    near = near.withColumn("task", F.pmod("cloud", F.lit(max(16, n // 2000)))).groupBy("task").applyInArrow(compare, "a long, b long")
    forest = components(settled(near.union(met.where("cloud is null").select("node", "root"))))
    cluster = settled(classes.select("node", "least", "size").join(forest.select(F.col("node").alias("n"), "root").union(forest.select("root", "root").distinct()), F.col("node") == F.col("n")).drop("n"))
    joined = components(settled(_linked(texts, cluster, k, similarity, block))).select(F.col("node").alias("n"), "root")
    found = classes.select("node", "least").join(joined, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = found.select(F.col("node").alias("n"), "root").join(named, "root")
    return rows.join(of_node, F.col("node") == F.col("n")).select("doc_id", "component_id")


PIVOTS = 4


def _linked(texts: DataFrame, cluster: DataFrame, k: int, similarity: float, block: int) -> DataFrame:
    """(a, b): a forest of the links within clusters, decided on the shingle sets.

    cluster has node, least (a doc_id that has the set), size and root.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in _each_set(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array([set_id(h)]), pa.array([h.tobytes()], pa.binary())], names=["n", "s"])

    def blocks(count: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(count) / block), F.ceil(F.col(size) / (1024 * block))).cast("int")

    wanted = cluster.select(F.col("least").alias("doc_id"))
    full = texts.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "n long, s binary").join(cluster.select("node"), F.col("n") == F.col("node"), "left_semi").dropDuplicates(["n"])
    pick = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node"))["node"] for i in range(PIVOTS)]
    per = cluster.groupBy("root").agg(F.count("*").alias("all"), F.sum("size").alias("whole"), F.array_distinct(F.array(*pick)).alias("pivots"))
    per = settled(per.select(F.col("root").alias("r"), blocks("all", "whole").alias("blocks"), "pivots"))
    links = None
    known = cluster.sparkSession.createDataFrame([], "linked long")
    if per.where("blocks > 1").head(1):
        full = settled(full)
        big = per.where("blocks > 1").withColumn("parts", F.ceil(F.col("blocks") / 8).cast("int"))
        own = cluster.join(big, F.col("root") == F.col("r")).select("root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(False).alias("pivot"))
        each = big.select(F.col("r").alias("root"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivots").select("root", "part", F.explode("pivots").alias("node"), F.lit(True).alias("pivot"))
        stars = own.union(each).join(full, F.col("node") == F.col("n")).drop("n").withColumn("unit", F.xxhash64("root", "part"))

        def star(table: pa.Table) -> pa.Table:
            node, pivot, blobs = table.column("node").to_numpy(), table.column("pivot").to_numpy(), table.column("s")
            a, b = [node[:0]], [node[:0]]
            for i in np.flatnonzero(pivot).tolist():
                rest = np.flatnonzero(~pivot & (node != node[i]))
                near = near_one(np.frombuffer(blobs[i].as_py(), np.uint64), [np.frombuffer(blobs[j].as_py(), np.uint64) for j in rest.tolist()], similarity)
                b.append(node[rest[near]])
                a.append(np.full(len(b[-1]), node[i]))
            return pa.table({"root": np.full(sum(map(len, a)), table.column("root")[0].as_py()), "a": np.concatenate(a), "b": np.concatenate(b)})

        links = settled(stars.groupBy("unit").applyInArrow(star, "root long, a long, b long"))
        best = links.groupBy("root", "a").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("a", F.struct("c", "a")).alias("p"))
        known = best.select(F.col("p").alias("linked")).union(links.join(best.select("p"), F.col("a") == F.col("p")).select("b"))
    rest = cluster.join(known, F.col("node") == F.col("linked"), "left")
    per_rest = rest.where("linked is null").groupBy("root").agg(F.count("*").alias("some"), F.sum("size").alias("part"))
    dealt = rest.join(per_rest.select(F.col("root").alias("q"), blocks("some", "part").alias("others")), F.col("root") == F.col("q")).join(per.select("r", "blocks"), F.col("root") == F.col("r"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    as_any = F.transform(upto("others"), lambda i: F.struct(i.alias("i"), place("blocks").alias("j")))
    as_other = F.when(F.col("linked").isNull(), F.transform(upto("blocks"), lambda j: F.struct(place("others").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    dealt = dealt.withColumn("u", F.explode(F.array_union(as_any, as_other))).select("node", "size", F.xxhash64("root", "u.i", "u.j").alias("unit"))
    dealt = settled(dealt)
    units = max(16, (dealt.agg(F.sum("size")).first()[0] or 0) >> 19)

    def verify(table: pa.Table) -> pa.Table:
        node, blobs = table.column("node").to_numpy(), table.column("s")
        found = [(node[at[x]], node[at[y]]) for at in _runs(table.column("unit").to_numpy()) for x, y in [verified([np.frombuffer(blobs[i].as_py(), np.uint64) for i in at.tolist()], similarity)]]
        forest = local_forest(*[np.concatenate(x) for x in zip(*found, strict=True)])
        return pa.table({"a": forest[0], "b": forest[1]})

    out = dealt.join(full, F.col("node") == F.col("n")).select("unit", "node", "s", F.pmod("unit", F.lit(units)).alias("task")).groupBy("task").applyInArrow(verify, "a long, b long")
    return out if links is None else out.union(links.select("a", "b"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, recall: float = 0.97, block: int = 256) -> DataFrame:
    """One document, all columns, of each group of near copies: the one with the smallest doc_id.

    A null doc_id is smallest.  Texts are told apart by doc_id and a hash, so
    several texts under one doc_id are documents of their own; rows that agree
    in both are cut to one.
    """
    row, id_, x, kept = fresh(docs, "__row", "__id", "__x", "__kept")
    key = F.struct(F.col(quoted(doc_id)).alias("id"), F.xxhash64(F.col(quoted(text))).alias("x"))
    found = _near_copies(docs.select(key.alias("doc_id"), F.col(quoted(text)).alias("text")), f"struct<id:{docs.schema[doc_id].dataType.simpleString()},x:bigint>", k, similarity, recall, block)
    keep = found.where("doc_id = component_id").select(F.lit(None).cast(docs.schema).alias(row), F.col("doc_id.id").alias(id_), F.col("doc_id.x").alias(x), F.lit(True).alias(kept))
    rows = docs.select(F.struct("*").alias(row), F.col(quoted(doc_id)).alias(id_), F.xxhash64(F.col(quoted(text))).alias(x), F.lit(False).alias(kept))
    # a union, not a join and then a cut to one: whole texts are shuffled once
    once = rows.union(keep).groupBy(id_, x).agg(F.first(row, ignorenulls=True).alias(row), F.max(kept).alias(kept))
    return once.where(F.col(kept)).select(f"{row}.*")
