"""Substring dedup by suffix automata of reference passages.

A word goes if a window of ``window`` words that covers it also starts in a
document with a smaller doc_id.  The reference that a document must be matched
with is all earlier documents, which is no bounded broadcast; so the reference
is cut to what repeats and each shard of it goes only where it is needed:

1. Documents lie in blocks of bounded size.  A window's anchor is the least hash
   of its short word sequences; equal windows have equal anchors.  Blocks ask
   hashed buckets which of their anchors lie in more than one document.
2. The windows with such an anchor are asked in the same way: a bucket learns
   which recur and which document has each first.
3. That first document's block cuts the passages that others repeat and sends
   each to the blocks that repeat it: their reference shards.
4. A block builds the suffix automaton of its shard, passages in the order of
   doc_id, so that a state knows the first document of its words.  The block's
   documents stream through it; where the matching statistic reaches the window
   length and the first document is an earlier one, the window is removed.

Blocks deal out rows by doc_id and text, so one doc_id may be in several.
Hashes only choose which passages are sent; what is removed is matched word by
word.  A block sends each hash once, so a passage in a third of all documents
is a row per block.  Null and blank texts have no words; rows with equal doc_id
are no reason to remove each other; a null doc_id comes after all others and
is kept against none of its kind.  An empty table gives no rows.  Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_buffer, bucket_of, by_bytes, in_blocks, packed, unpacked, window_hashes, word_hashes, words

ANCHOR_WORDS = 6
_LAST = np.iinfo(np.int64).max


class Automaton:
    """A suffix automaton of several word sequences; each state keeps the label under which its words came first."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [_LAST]

    def _state(self, length: int, link: int, moves: dict, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: object) -> int:
        """The state for p's words and one more, where q also holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, label: int) -> None:
        """Labels must come in ascending order."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            q = nxt[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
                continue
            new = self._state(length[last] + 1, 0, {}, label)
            p = last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, nxt[p][word], word)
            last = new

    def matches(self, sequence: list, window: int, label: int) -> list[int]:
        """Where windows end that also lie under a smaller label."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        out = []
        for i, word in enumerate(sequence):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                while length[link[state]] >= window:  # the state of the last window words, which is all that counts
                    state = link[state]
                    matched = length[state]
                if first[state] < label:
                    out.append(i)
        return out


class _Block:
    """A block's documents: windows, their hashes and anchors, chunk by chunk."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.ids = table.column("doc_id").fill_null(_LAST).to_numpy().astype(np.int64)
        data, offsets = as_buffer(table.column("text"))
        hashes, anchors, docs = [], [], []
        k = min(ANCHOR_WORDS, window)
        for i, j in by_bytes(offsets, 1 << 21):
            part = data[offsets[i] : offsets[j]]
            starts, ends, bounds = words(part, offsets[i : j + 1] - offsets[i], ~SPACE)
            h = word_hashes(part, starts, ends)
            win, at = window_hashes(h, bounds, window)
            gram = np.full(len(h) + 1, np.iinfo(np.uint64).max, np.uint64)
            short, first = window_hashes(h, bounds, k)
            gram[first] = short
            least = gram[at]
            for s in range(1, window - k + 1):
                np.minimum(least, gram[at + s], out=least)
            hashes.append(win)
            anchors.append(least)
            docs.append(np.searchsorted(bounds, at, "right") - 1 + i)
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        self.hashes, self.anchors, self.docs = join(hashes, np.uint64), join(anchors, np.uint64), join(docs, np.int64)


def _asked(block: int, hashes: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """Each distinct hash with the least and the greatest doc_id that has it here."""
    order = np.argsort(hashes, kind="stable")
    h, ids = hashes[order], ids[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(ids, first) if len(first) else ids
    high = np.maximum.reduceat(ids, first) if len(first) else ids
    h = h[first]
    own = bucket_of(h, buckets)
    some = np.unique(own)  # empty buckets cost nothing
    cuts = np.append(np.searchsorted(own, some), len(h))
    return pa.table({"block": np.full(len(some), block), "bucket": some.astype(np.int32), "hashes": pa.array(packed(h, cuts, "<u8"), pa.binary()), "low": pa.array(packed(low, cuts, "<i8"), pa.binary()), "high": pa.array(packed((low != high), cuts, "u1"), pa.binary())})


ASKED = "block long, bucket int, hashes binary, low binary, high binary"


def _gathered(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(which row, hash group, least doc_id of the group, whether it lies in several documents) of all entries of a bucket."""
    h = unpacked(table.column("hashes").to_pylist(), "<u8")
    low = unpacked(table.column("low").to_pylist(), "<i8")
    several = unpacked(table.column("high").to_pylist(), "u1")
    n = np.array([len(x) // 8 for x in table.column("hashes").to_pylist()], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    distinct, group = np.unique(h, return_inverse=True)
    least, most = np.full(len(distinct), _LAST), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, group, low)
    np.maximum.at(most, group, low)
    many = least != most
    np.logical_or.at(many, group, several > 0)
    return h, low, row, group, least, many


def _passages(docs: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(documents in blocks, reference passages by the block that needs them)."""
    dealt = in_blocks(docs.select("doc_id", "text"), ["doc_id", "text"], "text", block_bytes)
    buckets = max(1, -(-docs.count() // 1500))

    def ask_anchors(table: pa.Table) -> pa.Table:
        b = _Block(table, window)
        return _asked(table.column("block")[0].as_py(), b.anchors, b.ids[b.docs], buckets)

    def answer_anchors(table: pa.Table) -> pa.Table:
        h, _, row, group, _, many = _gathered(table)
        keep = many[group]
        rows = table.num_rows
        cuts = np.searchsorted(row[keep], np.arange(rows + 1))
        return pa.table({"block": table.column("block"), "hashes": pa.array(packed(h[keep], cuts, "<u8"), pa.binary())})

    def ask_windows(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        block = (docs_ if docs_.num_rows else answers).column("block")[0].as_py()
        b = _Block(docs_, window)
        repeated = np.sort(unpacked(answers.column("hashes").to_pylist(), "<u8"))
        at = np.minimum(np.searchsorted(repeated, b.anchors), max(len(repeated) - 1, 0))
        keep = repeated[at] == b.anchors if len(repeated) else np.zeros(len(b.anchors), bool)
        return _asked(block, b.hashes[keep], b.ids[b.docs[keep]], buckets)

    def answer_windows(table: pa.Table) -> pa.Table:
        h, low, row, group, least, many = _gathered(table)
        block = table.column("block").to_numpy()[row]
        owner = np.zeros(len(least), np.int64)
        owner[group[low == least[group]]] = block[low == least[group]]
        keep = many[group]
        h, first, to, need = h[keep], least[group][keep], owner[group][keep], block[keep]
        order = np.argsort(to, kind="stable")
        targets, at = np.unique(to[order], return_index=True)
        cuts = np.append(at, len(order))
        return pa.table({"block": targets, "hashes": pa.array(packed(h[order], cuts, "<u8"), pa.binary()), "first": pa.array(packed(first[order], cuts, "<i8"), pa.binary()), "need": pa.array(packed(need[order], cuts, "<i8"), pa.binary())})

    def send(docs_: pa.Table, asked: pa.Table) -> pa.Table:
        h, first, need = (unpacked(asked.column(c).to_pylist(), k) for c, k in (("hashes", "<u8"), ("first", "<i8"), ("need", "<i8")))
        out: dict[str, list] = {"block": [], "first": [], "passage": []}
        if len(h) and docs_.num_rows:
            wanted = np.isin(np.arange(docs_.num_rows), np.flatnonzero(np.isin(docs_.column("doc_id").fill_null(_LAST).to_numpy(), np.unique(first))))
            own = docs_.filter(pa.array(wanted))
            b = _Block(own, window)
            data, offsets = as_buffer(own.column("text"))
            order = np.lexsort((first, h))
            h, first, need = h[order], first[order], need[order]
            begin = np.flatnonzero(np.append(True, b.docs[1:] != b.docs[:-1])) if len(b.docs) else []
            for s, e in zip(begin, np.append(begin[1:], len(b.docs)), strict=True):
                d = int(b.docs[s])
                tokens = None
                lo, hi = np.searchsorted(h, b.hashes[s:e], "left"), np.searchsorted(h, b.hashes[s:e], "right")
                n = hi - lo
                at = np.repeat(np.arange(e - s), n)
                entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                mine = first[entry] == b.ids[d]
                at, to = at[mine], need[entry[mine]]
                order = np.lexsort((at, to))
                at, to = at[order], to[order]
                cut = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (at[1:] > at[:-1] + 1))) if len(at) else []
                for i, j in zip(cut, np.append(cut[1:], len(at)), strict=True):
                    tokens = tokens or data[offsets[d] : offsets[d + 1]].tobytes().split()
                    out["block"].append(int(to[i]))
                    out["first"].append(int(b.ids[d]))
                    out["passage"].append(b" ".join(tokens[at[i] : at[j - 1] + window]))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "first": pa.array(out["first"], pa.int64()), "passage": pa.array(out["passage"], pa.binary())})

    repeated = dealt.groupBy("block").applyInArrow(ask_anchors, ASKED).groupBy("bucket").applyInArrow(answer_anchors, "block long, hashes binary")
    asked = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(ask_windows, ASKED)
    recurring = asked.groupBy("bucket").applyInArrow(answer_windows, "block long, hashes binary, first binary, need binary")
    sent = dealt.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(send, "block long, first long, passage binary")
    return dealt, sent


def _stream(window: int, finish: Callable[[pa.Table, list[list[bytes]], list[np.ndarray]], pa.Table]) -> Callable:
    def stream(docs_: pa.Table, passages: pa.Table) -> pa.Table:
        automaton = Automaton()
        last = None
        for label, passage in sorted(zip(passages.column("first").to_pylist(), passages.column("passage").to_pylist(), strict=True)):
            if (label, passage) != last:
                automaton.add(passage.split(), label)
            last = (label, passage)
        data, offsets = as_buffer(docs_.column("text"))
        raw, ids = data.tobytes(), docs_.column("doc_id").fill_null(_LAST).to_pylist()
        tokens, gone = [], []
        for i, label in enumerate(ids):
            own = raw[offsets[i] : offsets[i + 1]].split()
            change = np.zeros(len(own) + 1, np.int64)
            if len(own) >= window and len(automaton.next) > 1:
                ends = np.array(automaton.matches(own, window, label), np.int64)
                np.add.at(change, ends - window + 1, 1)
                np.add.at(change, ends + 1, -1)
            tokens.append(own)
            gone.append(np.cumsum(change[:-1]) > 0)
        return finish(docs_, tokens, gone)

    return stream


def report(docs: DataFrame, window: int = 13, block_bytes: int = 3 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    dealt, sent = _passages(docs, window, block_bytes)

    def finish(docs_: pa.Table, tokens: list[list[bytes]], gone: list[np.ndarray]) -> pa.Table:
        kept = [hashlib.sha256(b" ".join([w for w, g in zip(t, x.tolist(), strict=True) if not g] if x.any() else t)).hexdigest() for t, x in zip(tokens, gone, strict=True)]
        return pa.table({"doc_id": docs_.column("doc_id"), "n_words": pa.array([len(t) for t in tokens], pa.int64()), "n_removed": pa.array([int(x.sum()) for x in gone], pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_stream(window, finish), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def removed_spans(docs: DataFrame, window: int = 50, block_bytes: int = 3 << 20) -> DataFrame:
    """doc_id and the maximal spans (first word, words) that repeat earlier documents, flat; only documents with some."""
    dealt, sent = _passages(docs, window, block_bytes)

    def finish(docs_: pa.Table, tokens: list[list[bytes]], gone: list[np.ndarray]) -> pa.Table:
        edges = [np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8))) for x in gone]
        spans = [np.stack([e[::2], e[1::2] - e[::2]], 1).ravel().tolist() for e in edges]
        return pa.table({"doc_id": docs_.column("doc_id"), "spans": pa.array(spans, pa.list_(pa.int64()))}).filter(pa.array([bool(s) for s in spans]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_stream(window, finish), f"doc_id {kind}, spans array<long>")
