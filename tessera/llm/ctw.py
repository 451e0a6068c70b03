"""Language-model scoring by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, joined by single spaces and closed by an
end symbol.  Each byte is coded as binary decisions down a Huffman tree of the
training part's byte counts (Volf 2002), which needs fewer decisions than eight
bits; each of its nodes has its own context tree over the preceding bytes.
Every context node holds a Krichevsky-Trofimov estimate, and the weighted
probability P_w = 1/2 P_kt + 1/2 prod P_w(children) mixes all depths (Willems,
Shtarkov, Tjalkens 1995).  After training the tree is fixed: a decision's
probability is the mixture along its path with the trained weights, ending at
the deepest context in which that decision has been seen.

The tree has the same depth at every size of the input and stays distributed:

1. Tasks count the contexts and words of the training part; sums are shuffled.
2. Contexts are dealt to parts by their two latest bytes, so a part holds whole
   subtrees.  Each part weights its subtrees bottom-up and hands the sums of its
   roots up; the levels above (a context of at most one byte: no more than 256
   contexts of 255 decisions each) are mixed on the driver and broadcast.
3. Documents are dealt into blocks.  A block asks the parts for each of its
   distinct (context, byte) and words once; a part mixes its subtrees top-down
   and answers with log probabilities and counts; the answers go back.

There are at most ``MOST_PARTS`` parts of either kind, so a block's questions
are a bounded number of rows; the blocks that one part answers at a time are
bounded by slices, each with a copy of the part's counts.

A null text is empty: one end token.  Repeated rows count as often as they are.
A null doc_id is in the training part.  An empty table gives no rows.  Other
columns of docs are not looked at.  Words meet by a 64-bit hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, as_buffer, bucket_cuts, bucket_of, by_bytes, checkpoint, crc_mod, distinct, in_blocks, packed, places, text_bytes, unpacked, word_hashes, words

END = 255  # never a byte of UTF-8
#: Parts of the contexts, and as many of the words, at most.
MOST_PARTS = 4096
_SPREAD = 2654435761


def stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, positions that are coded, where each text's begin): every text starts in a context of end symbols."""
    clean = [b" ".join(t.lower().split()) for t in texts]
    pad = b"\xff" * depth
    x = np.frombuffer(pad + b"".join(t + pad for t in clean), np.uint8)
    n = np.array([len(t) + 1 for t in clean], np.int64)
    first = np.cumsum(n) - n
    coded = np.arange(n.sum()) + np.repeat(depth + np.arange(len(n)) * (depth - 1), n)
    return x, coded, first


def _chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = as_buffer(texts)
    raw, at = data.tobytes(), offsets.tolist()
    for i, j in by_bytes(offsets, most):
        yield i, j, [raw[at[k] : at[k + 1]] for k in range(i, j)]


def gram_codes(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Context and byte in one number: the latest context byte leads, the coded byte ends."""
    code = np.zeros(len(at), np.uint64)
    for d in range(1, depth + 1):
        code = (code << np.uint64(8)) | x[at - d]
    return (code << np.uint64(8)) | x[at]


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


class Tally:
    """Counts of keys in bounded memory: what grows beyond ``hold`` keys is handed on and begun anew."""

    def __init__(self, hold: int = 4_000_000) -> None:
        self.hold, self.keys, self.counts, self.held, self.least = hold, [], [], 0, 1 << 20

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys.append(keys[first])
        self.counts.append(np.diff(np.append(first, len(keys))))
        self.held += len(first)
        if self.held > 2 * self.least:
            one = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [one[0]], [one[1]], len(one[0])
            self.least = max(1 << 20, self.held)
            if self.held > self.hold:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.keys:
            yield merged(self.keys, self.counts)
        self.keys, self.counts, self.held, self.least = [], [], 0, 1 << 20


class Layout:
    """Which part holds a context or a word: contexts are parts 0 to contexts - 1, words the others."""

    def __init__(self, depth: int, contexts: int, words: int) -> None:
        if not 1 <= depth <= 7:
            raise ValueError("the depth must be 1 to 7 bytes")
        self.depth, self.lead, self.contexts, self.words = depth, min(2, depth), contexts, words

    def of_codes(self, code: np.ndarray) -> np.ndarray:
        latest = code >> np.uint64(8 * (self.depth + 1 - self.lead))
        return ((latest * np.uint64(_SPREAD) >> np.uint64(16)) % np.uint64(self.contexts)).astype(np.int64)

    def of_words(self, h: np.ndarray) -> np.ndarray:
        return self.contexts + bucket_of(h, self.words)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words begin)."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets, ~SPACE)
    return word_hashes(low, starts, ends), bounds


def key_counts(docs: DataFrame, text: str, layout: Layout) -> DataFrame:
    """(part, key, n): how often each byte follows each context and each word occurs, over all rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = Tally(), Tally()

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]], part: object) -> Iterator[pa.RecordBatch]:
            for key, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(part(key).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["part", "key", "n"])

        for batch in batches:
            data, offsets = as_buffer(batch.column(0))
            for i, j in by_bytes(offsets, 1 << 20):
                yield from out(seen.add(_word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]), layout.of_words)
            for _, _, texts in _chunks(batch.column(0)):
                x, at, _ = stream(texts, layout.depth)
                yield from out(codes.add(gram_codes(x, at, layout.depth)), layout.of_codes)
        yield from out(seen.rest(), layout.of_words)
        yield from out(codes.rest(), layout.of_codes)

    grams = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(scan, "part int, key long, n long")
    return grams.groupBy("part", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series at x + 7."""
    shift = np.ones_like(x)
    for i in range(7):
        shift *= x + i
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def huffman(weights: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(symbols of positive weight in the order of the tree's leaves, its inner nodes as ranges (low, mid, high))."""
    heap = [(w, s, s) for s, w in enumerate(weights.tolist()) if w > 0]
    heapq.heapify(heap)
    while len(heap) > 1:
        (v, i, x), (w, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (v + w, min(i, j), (x, y)))
    leaves: list[int] = []
    splits: list[tuple[int, int, int]] = []

    def walk(node: int | tuple) -> None:
        if isinstance(node, int):
            leaves.append(node)
            return
        low = len(leaves)
        walk(node[0])
        mid = len(leaves)
        walk(node[1])
        splits.append((low, mid, len(leaves)))

    walk(heap[0][2])
    return np.array(leaves), splits


class Coder:
    """Bytes as paths of binary decisions; a byte that has not been seen is an escape."""

    def __init__(self, counts: np.ndarray) -> None:
        """counts: how often each byte is in the training part; the end symbol counts once more."""
        symbols, splits = huffman(counts + (np.arange(256) == END))
        a = len(symbols)
        place = np.full(256, a, np.int64)
        place[symbols] = np.arange(a)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(a)]
        for decision, (low, mid, high) in enumerate(splits):
            for s in range(low, high):
                paths[s].append((decision, int(s >= mid)))
        by_byte = [paths[p] if p < a else [] for p in place.tolist()]
        self.decisions = len(splits)
        self.size = np.array([len(p) for p in by_byte])
        self.first = np.cumsum(self.size) - self.size
        flat = [x for p in by_byte for x in p]
        self.decision, self.bit = np.array([x[0] for x in flat], np.uint64), np.array([x[1] for x in flat], bool)
        # bytes not seen share one escape at the root, as if seen once
        escape = 1 / (counts.sum() + 2) if a < 256 else 0.0
        self.base = np.where(place < a, np.log10(1 - escape), np.log10(escape / max(1, 256 - a) or 1))

    def pairs(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the given bytes, decision, bit) of all decisions on their paths."""
        n = self.size[byte]
        which = np.repeat(np.arange(len(byte)), n)
        at = np.repeat(self.first[byte] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return which, self.decision[at], self.bit[at]


def _up(key: np.ndarray) -> np.ndarray:
    """The same decision in the context that is one byte shorter."""
    return (key >> np.uint64(16) << np.uint64(8)) | (key & np.uint64(255))


class Level:
    """The (context, decision) nodes of one depth, sorted, with their counts."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.key, self.zeros, self.ones = key, zeros, ones
        self.below = np.zeros(len(key))
        self.whole = self.weight = None
        self.parent = np.zeros(0, np.int64)

    @classmethod
    def summed(cls, key: np.ndarray, *values: np.ndarray) -> tuple[Level, np.ndarray]:
        distinct, at = np.unique(key, return_inverse=True)
        return cls(distinct, *[np.bincount(at, v, len(distinct)) for v in values[:2]]), at

    def weigh(self, leaf: bool) -> None:
        """log P_w of each node, and the share of its own estimate in it."""
        kt = _lgamma(self.zeros + 0.5) + _lgamma(self.ones + 0.5) - _lgamma(self.zeros + self.ones + 1) - np.log(np.pi)
        self.whole = kt if leaf else np.log(0.5) + np.logaddexp(kt, self.below)
        self.weight = np.ones(len(kt)) if leaf else np.exp(np.log(0.5) + kt - self.whole)

    def above(self) -> Level:
        """The level of the contexts that are one byte shorter."""
        up, self.parent = Level.summed(_up(self.key), self.zeros, self.ones)
        up.below = np.bincount(self.parent, self.whole, len(up.key))
        return up

    def mixed(self, gathered: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of a 1 if the path ends here, what is gathered and left for the level below)."""
        k = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        return gathered + left * k, gathered + left * self.weight * k, left * (1 - self.weight)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def _subtrees(code: np.ndarray, count: np.ndarray, coder: Coder, layout: Layout) -> list[Level]:
    """The levels from the leading contexts down to the full depth, weighted bottom-up."""
    which, decision, bit = coder.pairs((code & np.uint64(255)).astype(np.int64))
    key = (code >> np.uint64(8) << np.uint64(8))[which] | decision
    n = count[which].astype(np.float64)
    level, _ = Level.summed(key, np.where(bit, 0.0, n), np.where(bit, n, 0.0))
    level.weigh(leaf=True)
    out = [level]
    for _ in range(layout.depth - layout.lead):
        level = level.above()
        level.weigh(leaf=False)
        out.insert(0, level)
    return out


class Top:
    """The levels above the parts: mixed on the driver, of bounded size."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, layout: Layout) -> None:
        level = Level(key, zeros, ones)
        level.below = below
        self.levels = [level]
        level.weigh(leaf=False)
        for _ in range(layout.lead - 1):
            level = level.above()
            level.weigh(leaf=False)
            self.levels.insert(0, level)
        self.final = []
        for d, level in enumerate(self.levels):
            if d:
                up = self.levels[d].parent
                state = (self.gathered[up], self.left[up])
            else:
                state = (np.zeros(len(level.key)), np.ones(len(level.key)))
            final, self.gathered, self.left = level.mixed(*state)
            self.final.append(final)

    def chances(self, key: np.ndarray, depth: int) -> np.ndarray:
        """The probability of a 1 at the deepest of these levels that holds the decision; keys are of contexts of ``depth`` bytes."""
        out = np.full(len(key), 0.5)
        keys = [key]
        for _ in range(depth):
            keys.insert(0, _up(keys[0]))
        for level, final, own in zip(self.levels, self.final, keys, strict=False):
            at = level.find(own)
            out = np.where(at >= 0, final[np.maximum(at, 0)] if len(final) else out, out)
        return out


def logs(asked: np.ndarray, code: np.ndarray, count: np.ndarray, coder: Coder, top: Top, layout: Layout) -> np.ndarray:
    """log10 probability of the byte after the context, for each asked code; code and count are those of the part."""
    byte = (asked & np.uint64(255)).astype(np.int64)
    which, decision, bit = coder.pairs(byte)
    keys = [(asked >> np.uint64(8) << np.uint64(8))[which] | decision]
    for _ in range(layout.depth - layout.lead):
        keys.insert(0, _up(keys[0]))
    chance = top.chances(_up(keys[0]), layout.lead - 1)
    if len(code):
        gathered = left = None
        for d, level in enumerate(_subtrees(code, count, coder, layout)):
            if d:
                state = gathered[level.parent], left[level.parent]
            else:
                at = top.levels[-1].find(_up(level.key))
                state = top.gathered[at], top.left[at]
            final, gathered, left = level.mixed(*state)
            at = level.find(keys[d])
            chance = np.where(at >= 0, final[np.maximum(at, 0)], chance)
    return coder.base[byte] + np.bincount(which, np.log10(np.where(bit, chance, 1 - chance)), len(asked))


def train(counts: DataFrame, byte_counts: np.ndarray, layout: Layout) -> tuple[Coder, Top]:
    """The code of bytes and the levels above the parts.  No training text at all gives the uniform model."""
    coder = Coder(byte_counts)

    def roots(table: pa.Table) -> pa.Table:
        up = _subtrees(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy(), coder, layout)[0].above()
        return pa.table({"key": up.key.view(np.int64), "zeros": up.zeros, "ones": up.ones, "below": up.below})

    found = counts.where(F.col("part") < layout.contexts).groupBy("part").applyInArrow(roots, "key long, zeros double, ones double, below double")
    # at most 256 contexts of 255 decisions
    got = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow().sort_by("key")
    return coder, Top(got.column("key").to_numpy().view(np.uint64), *[got.column(c).to_numpy() for c in ("zeros", "ones", "below")], layout)


def report(docs: DataFrame, training: Column | None = None, depth: int = 5, block_bytes: int = 4 << 20, part_bytes: int = 8 << 20, blocks_per_slice: int = 4096) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    bits_per_byte is the code length of the text over its bytes, the end symbol
    counted as one.  training: which rows to learn from; by default those whose
    crc32(doc_id) mod 7 is not 2.  The depth is what is asked for, at every size.
    """
    training = crc_mod("doc_id", 7) != 2 if training is None else training
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    size = text_bytes(rows)
    parts = min(MOST_PARTS, max(1, size // part_bytes))
    layout = Layout(depth, parts, parts)
    counts = checkpoint(key_counts(rows.where("training"), "text", layout))
    word = F.col("part") >= layout.contexts
    stats = counts.groupBy(F.when(word, F.lit(-1)).otherwise(F.col("key").bitwiseAND(255)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()  # 257 rows at most
    byte_counts = np.zeros(256)
    byte_counts[[r.b for r in stats if r.b >= 0]] = [r.n for r in stats if r.b >= 0]
    ends = int(byte_counts[END])
    total, distinct_words = next(((r.n, r.d) for r in stats if r.b < 0), (0, 0))
    total, distinct_words = total + ends, distinct_words + (ends > 0)
    coder, top = train(counts, byte_counts, layout)
    dealt = in_blocks(rows, ["doc_id", "text"], "text", block_bytes, size)
    slices = max(1, -(-size // (block_bytes * blocks_per_slice)))

    def ask(table: pa.Table) -> pa.Table:
        own = table.column("block")[0].as_py()
        codes, at = _block_codes(table, layout)
        seen, cuts = _block_words(table, layout)[:2]
        keys = packed(codes, at, "<u8") + packed(seen, cuts, "<u8")
        some = [i for i, k in enumerate(keys) if k]
        return pa.table({"part": pa.array(some, pa.int32()), "slice": pa.array([own % slices] * len(some), pa.int32()), "block": pa.array([own] * len(some), pa.int64()), "keys": pa.array([keys[i] for i in some], pa.binary())})

    def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
        blobs = asked.column("keys").to_pylist()
        if not blobs:
            return pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "found": pa.array([], pa.binary())})
        asked_ = unpacked(blobs, "<u8")
        wanted = distinct(asked_)
        at = places(wanted, asked_)
        order = np.argsort(model.column("key").to_numpy().view(np.uint64))
        key, n = model.column("key").to_numpy().view(np.uint64)[order], model.column("n").to_numpy()[order]
        if asked.column("part")[0].as_py() < layout.contexts:
            found, kind = logs(wanted, key, n, coder, top, layout), "<f4"
        else:
            place, kind = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1)), "<i8"
            found = np.where(key[place] == wanted, n[place], 0) if len(key) else np.zeros(len(wanted), np.int64)
        cuts = np.cumsum([0, *[len(b) // 8 for b in blobs]])
        return pa.table({"block": asked.column("block"), "part": asked.column("part"), "found": pa.array(packed(found[at], cuts, kind), pa.binary())})

    def judge(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        part, found = answers.column("part").to_numpy(), answers.column("found").to_pylist()
        many = int((part < layout.contexts).sum())
        codes, _ = _block_codes(docs_, layout)
        log = unpacked(found[:many], "<f4").astype(np.float64)
        order = np.argsort(codes)
        codes, log = codes[order], log[order]
        seen, _, hashes, bounds = _block_words(docs_, layout)
        count = unpacked(found[many:], "<i8")
        c = count[places(seen, hashes)] if len(hashes) else np.zeros(0, np.int64)
        per_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        n_tokens = np.diff(bounds) + 1
        known = per_doc(c > 0) + (ends > 0)
        base = per_doc(np.log10(c + 1.0)) + np.log10(ends + 1.0) - n_tokens * np.log10(total + distinct_words + 1.0)
        score, coded = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, _, texts in _chunks(docs_.column("text").combine_chunks()):
            x, at, first = stream(texts, layout.depth)
            score.append(np.add.reduceat(log[places(codes, gram_codes(x, at, layout.depth))], first))
            coded.append(np.diff(np.append(first, len(at))))
        score, coded = np.concatenate(score), np.concatenate(coded)
        return pa.table({"doc_id": docs_.column("doc_id"), "held_out": pa.array([not t for t in docs_.column("training").to_pylist()], pa.bool_()), "n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(n_tokens), total), "base_score": base, "score": score, "bits_per_byte": -score / np.log10(2) / np.maximum(coded, 1)})

    asked = dealt.groupBy("block").applyInArrow(ask, "part int, slice int, block long, keys binary")
    model = counts.select("part", "key", "n", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    answers = asked.groupBy("part", "slice").cogroup(model.groupBy("part", "slice")).applyInArrow(answer, "block long, part int, found binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _block_codes(table: pa.Table, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes of a block's texts by part, where each part's begin)."""
    found = [np.zeros(0, np.uint64)]
    for _, _, texts in _chunks(table.column("text").combine_chunks()):
        x, at, _ = stream(texts, layout.depth)
        found.append(distinct(gram_codes(x, at, layout.depth)))
    codes = distinct(np.concatenate(found))
    part = layout.of_codes(codes)
    order = np.argsort(part, kind="stable")
    return codes[order], np.searchsorted(part[order], np.arange(layout.contexts + 1))


def _block_words(table: pa.Table, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes of a block's texts, where each part's begin, every word's hash, where each text's words begin)."""
    data, offsets = as_buffer(table.column("text"))
    hashes, bounds = _word_hashes(data, offsets)
    seen = distinct(hashes)
    return seen, bucket_cuts(seen, layout.words), hashes, bounds
