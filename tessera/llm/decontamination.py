"""Benchmark decontamination by suffix arrays over the training text.

The training documents are cut into shards of bounded size where they lie, with
no shuffle.  Each shard gets a suffix array over its words (prefix doubling);
every suffix of every test item is binary-searched in it, which gives the
longest verbatim match, and the interval of all places where a window of the
item occurs.  Words outside the test vocabulary cannot be matched, so they end
a suffix and start none; stretches of vocabulary words shorter than every window
are left out.

The test items are broadcast in blocks of bounded size: each block is one more
pass that adds to the spans found so far, so the items may grow.

A block's memory is in proportion to its words, however long its items are: a
suffix is a place in the words and is compared there.

Null or empty texts have no words and are clean; items without words find
nothing; repeated item_ids count once; repeated documents are judged each.
Items without an id are searched for like others, but are not among the items
named.  A null doc_id is an id like others, an empty table of documents gives no
rows, an empty benchmark finds nothing, and other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_buffer, by_bytes, ddl, fresh, quoted, word_hashes, words

#: [a-z0-9] and everything beyond ASCII, after lower-casing.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


class SuffixArray:
    """Suffixes of integer words; 0 ends a suffix."""

    def __init__(self, ids: np.ndarray, longest: int) -> None:
        self.ids, self.longest = ids, longest
        stop = np.flatnonzero(ids == 0)
        nxt = np.append(stop, len(ids))
        start = np.flatnonzero(ids)
        #: words until the suffix ends
        run = np.zeros(len(ids) + 1, np.int64)
        run[start] = nxt[np.searchsorted(nxt, start)] - start
        self.run = run
        rank = np.zeros(len(ids) + 1, np.int64)
        first = ids[start]
        order = np.argsort(first.astype(np.uint16) if len(first) and first.max() < 1 << 16 else first, kind="stable")
        sa = start[order]
        head = self._heads(ids[sa])
        rank[sa] = head + 1
        depth = 1
        while depth < longest and len(sa):
            size = np.bincount(head, minlength=len(sa))[head]
            tied = np.flatnonzero((size > 1))
            pos = sa[tied]
            more = run[pos] > depth
            # groups whose suffixes have all ended stay as they are
            live = np.zeros(len(sa), bool)
            live[head[tied[more]]] = True
            keep = live[head[tied]]
            tied, pos, more = tied[keep], pos[keep], more[keep]
            if not len(tied):
                break
            key = np.where(more, rank[np.minimum(pos + depth, len(ids))], 0)
            group = head[tied]
            order = np.lexsort((key, group))
            pos, key, group = pos[order], key[order], group[order]
            sa[tied] = pos
            new = np.ones(len(tied), bool)
            new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            head[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            rank[pos] = head[tied] + 1
            depth *= 2
        self.sa = sa

    @staticmethod
    def _heads(key: np.ndarray) -> np.ndarray:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))

    def compared(self, at: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(how many words the suffixes share with the queries, -1, 0 or 1 as a suffix is less, begins with the query, or is greater)."""
        pos, size = self.sa[at], self.run[self.sa[at]]
        shared, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        open_, step = np.arange(len(at)), 8
        while len(open_):  # ever longer stretches of those that have agreed so far
            cols = shared[open_, None] + np.arange(step)
            x = np.where(cols < size[open_, None], self.ids[np.minimum(pos[open_, None] + cols, len(self.ids) - 1)], 0)
            y = np.where(cols < queries.size[open_, None], queries.words[np.minimum(queries.start[open_, None] + cols, len(queries.words) - 1)], 0)
            ended = cols >= queries.size[open_, None]  # beyond the query's end nothing differs
            stop = (x != y) | ended
            first, any_, i = stop.argmax(1), stop.any(1), np.arange(len(open_))
            sign[open_] = np.where(any_ & ~ended[i, first], np.sign(x[i, first] - y[i, first]), 0)
            shared[open_] += np.where(any_, first, step)
            open_, step = open_[~any_], min(2 * step, 4096)
        return shared, sign

    def search(self, queries: Queries, after: bool = False) -> np.ndarray:
        """For each query: how many suffixes come before it.

        after: suffixes that begin with the query count as before it, too.
        """
        n = len(queries.start)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.sa), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            _, sign = self.compared(mid, queries.some(open_))
            less = (sign < 0) | (after & (sign == 0))
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    def longest_matches(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of each query's longest prefix that occurs."""
        n = len(queries.start)
        best, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if len(self.sa):
            at = self.search(queries)
            for near in (at - 1, at):  # the longest common prefix is with a neighbour in order
                ok = np.clip(near, 0, len(self.sa) - 1)
                shared, _ = self.compared(ok, queries)
                length = np.where((near >= 0) & (near < len(self.sa)), shared, 0)
                better = length > best
                best, where = np.where(better, length, best), np.where(better, self.sa[ok], where)
        return best, where


@dataclass
class Queries:
    """Stretches of one array of words."""

    words: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def some(self, at: np.ndarray) -> Queries:
        return Queries(self.words, self.start[at], self.size[at])


class Items:
    """A block of test items: vocabulary, suffixes and windows, in memory in proportion to its words."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int) -> None:
        data, offsets = as_buffer(pa.array([x or "" for x in texts], pa.string()))
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets, INSIDE)
        hashes = word_hashes(data, starts, ends)
        self.names = ids
        self.vocabulary, flat = np.unique(hashes, return_inverse=True)
        flat = flat + 1
        total = np.diff(bounds)
        self.longest = int(total.max(initial=0))
        item = np.repeat(np.arange(len(texts)), total)
        at = np.arange(len(item))
        left = bounds[1:][item] - at if len(item) else at
        self.suffixes = Queries(flat, at, left)
        whole = (total[item] < window) & (left == total[item]) if len(item) else np.zeros(0, bool)
        self.window_suffix = np.flatnonzero((left >= window) | whole)
        self.window_item, self.window_len = item[self.window_suffix], np.minimum(window, left[self.window_suffix])
        self.windows = Queries(flat, self.window_suffix, self.window_len)
        #: the suffixes of all items of a name
        self.suffixes_of: dict[str | None, np.ndarray] = {}
        for i, name in enumerate(ids):
            own = np.arange(bounds[i], bounds[i + 1])
            self.suffixes_of[name] = np.append(self.suffixes_of[name], own) if name in self.suffixes_of else own

    def shard(self, hashes: np.ndarray, bounds: np.ndarray) -> SuffixArray:
        """The suffix array of a shard's documents; word w of document d is at w + d."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        # a 0 after each document keeps matches inside one
        spaced = np.zeros(len(hashes) + len(bounds), np.int64)
        spaced[np.arange(len(hashes)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = known
        # stretches of known words too short for any window are left out
        edge = np.flatnonzero(np.diff(np.concatenate([[False], spaced != 0, [False]]).view(np.int8)))
        first, size = edge[::2], edge[1::2] - edge[::2]
        first, size = first[size >= self.window_len.min()], size[size >= self.window_len.min()]
        held = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        kept = np.zeros(len(spaced), np.int64)
        kept[held] = spaced[held]
        return SuffixArray(kept, self.longest)

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, item) of all places of windows in a shard; (words, place) of each suffix's longest match."""
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.window_suffix):
            return none, none, none, np.zeros(len(self.suffixes.start), np.int64), none
        array = self.shard(hashes, bounds)
        length, place = array.longest_matches(self.suffixes)
        back = lambda p: p - np.searchsorted(bounds[1:] + np.arange(len(bounds) - 1), p, "left")
        # a window occurs if the longest match of the suffix it begins covers it
        chosen = np.flatnonzero(length[self.window_suffix] >= self.window_len)
        low, high = array.search(self.windows.some(chosen)), array.search(self.windows.some(chosen), after=True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = back(array.sa[low[which] + inner]) if len(which) else none
        return found, self.window_len[chosen][which], self.window_item[chosen][which], length, np.where(length > 0, back(np.maximum(place, 0)), -1)


def _blocks(bench: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """Test items in blocks of bounded size, one block on the driver at a time."""
    rows = bench.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        got = part.collect()
        yield [r.i for r in got], [r.t for r in got]


FOUND = ("n_words", "spans", "items", "longest")


def find_contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = 8 << 20, block_bytes: int = 4 << 20, found: str = "found") -> DataFrame:
    """The documents with a struct ``found``: ``n_words``, ``spans`` [(first word, words)] that test windows hit, merged, ``items`` found and ``longest`` (item_id, words, first word).

    ``longest`` is the document's longest verbatim match with an item whose
    window occurs in it, null if none does.
    """
    names_ = dict(zip(FOUND, fresh(docs, *(f"__{n}" for n in FOUND)), strict=True))
    kinds = {"n_words": "long", "spans": "array<long>", "items": "array<string>", "longest": "struct<item_id:string,n_words:long,first_word:long>"}
    base = list(docs.columns)
    none = {"n_words": F.lit(0), "spans": F.array(), "items": F.array(), "longest": F.lit(None)}
    out = docs.select("*", *[none[n].cast(kinds[n]).alias(names_[n]) for n in FOUND])
    added = ", ".join(f"{names_[n]} {kinds[n]}" for n in FOUND)
    carried = [names_[n] for n in ("spans", "items", "longest")]
    for ids, texts in _blocks(bench, item_id, item_text, block_bytes):
        items = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, window))

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = as_buffer(batch.column(batch.schema.get_field_index(text)))
                old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in carried]
                n_words, spans, names, longest = [], [], [], []
                for i, j in by_bytes(offsets, shard_bytes):
                    part, offs = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                    starts, ends, bounds = words(part, offs, INSIDE)
                    hashes = word_hashes(part, starts, ends)
                    place, length, item, *_ = items.value.find(hashes, bounds)
                    n_words += np.diff(bounds).tolist()
                    hit = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(hit, place, 1)
                    np.add.at(hit, place + length, -1)
                    on = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
                    doc_of = np.searchsorted(bounds, place, "right") - 1
                    by_doc: dict[int, list[int]] = {}
                    for k, d in enumerate(doc_of.tolist()):
                        by_doc.setdefault(d, []).append(k)
                    for d in range(j - i):
                        s, here_, best = list(old[0][i + d]), list(old[1][i + d]), old[2][i + d]
                        if d in by_doc:
                            own = np.concatenate([[False], on[bounds[d] + 1 : bounds[d + 1] + 1], [False]])
                            edges = np.flatnonzero(own[1:] != own[:-1])
                            s += np.stack([edges[::2], edges[1::2] - edges[::2]], 1).ravel().tolist()
                            here = {items.value.names[item[k]] for k in by_doc[d]}
                            here_ += sorted(here - {None})
                            one = _longest(items.value, hashes[bounds[d] : bounds[d + 1]], here)
                            best = one if best is None or one["n_words"] > best["n_words"] else best
                        spans.append(s)
                        names.append(here_)
                        longest.append(best)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in base]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("first_word", pa.int64())]))],
                    names=[*base, *names_.values()],
                )

        out = out.mapInArrow(scan, f"{ddl(docs)}, {added}")
    return out.select(*[F.col(quoted(c)) for c in base], F.struct(*[F.col(names_[n]).alias(n) for n in FOUND]).alias(found))


def _longest(items: Items, hashes: np.ndarray, named: set[str | None]) -> dict:
    """The longest match of one document's words with the named items; the first of equals.

    Only the suffixes of these items are searched for.
    """
    array = items.shard(hashes, np.array([0, len(hashes)]))
    found = []
    for name in named:
        own = items.suffixes.some(items.suffixes_of[name])
        length, _ = array.longest_matches(own)
        n = int(length.max())
        best = np.flatnonzero(length == n)
        best = Queries(own.words, own.start[best], length[best])
        low, high = array.search(best), array.search(best, after=True)
        found.append((n, -min(int(array.sa[i:j].min()) for i, j in zip(low, high, strict=True)), name is not None, name or ""))
    n, at, known, item = max(found)
    return {"item_id": item if known else None, "n_words": n, "first_word": -at}


def report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match (0 words at -1 if there is none) of every document."""
    found = find_contamination(docs.select("doc_id", "text"), bench, **options).select("doc_id", "found.*")
    # spans of one block are disjoint; several blocks' may overlap
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int")), lambda i: F.struct(F.get("spans", (2 * i).cast("int")).alias("a"), F.get("spans", (2 * i + 1).cast("int")).alias("n"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["a"] + s["n"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0).cast("long"), s["a"] + s["n"] - F.greatest(acc["end"], s["a"]))).alias("hit"))
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, zero, step)["hit"])
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("longest.item_id").alias("longest_item"),
        F.coalesce("longest.n_words", F.lit(0)).alias("longest_words"),
        F.coalesce("longest.first_word", F.lit(-1)).alias("longest_at"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents, all columns, in which no test window occurs."""
    (own,) = fresh(docs, "__found")
    return find_contamination(docs, bench, found=own, **options).where(F.size(F.col(own)["spans"]) == 0).drop(own)
