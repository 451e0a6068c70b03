"""Context-tree weighting against a plain recursion, and the word baseline against counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ctw

rng = random.Random(3)
TEXTS = [None, "", " \t ", "abra cadabra", "abra cadabra", "ABRA", "bar " * 200, "caba", "é ß", *["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 120))) for _ in range(60)]]


def plain(texts, depth):
    """P(byte | context) of a fixed tree trained on texts, by recursion over dicts."""
    seen = Counter()
    for t in texts:
        x = b"\xff" * depth + b" ".join(t.lower().encode().split()) + b"\xff"
        for i in range(depth, len(x)):
            seen[x[i - depth : i], x[i]] += 1
    byte = np.zeros(256)
    for (_, b), n in seen.items():
        byte[b] += n
    symbols, splits = ctw.huffman(byte + (np.arange(256) == ctw.END))
    place = {int(s): i for i, s in enumerate(symbols)}
    nodes = [{} for _ in splits]  # per decision: context suffix -> [zeros, ones]
    for (context, b), n in seen.items():
        for j, (low, mid, high) in enumerate(splits):
            if low <= place[b] < high:
                for d in range(depth + 1):
                    nodes[j].setdefault(context[depth - d :], [0, 0])[place[b] >= mid] += n
    lg = math.lgamma
    kt = lambda z, o: lg(z + 0.5) + lg(o + 0.5) - lg(z + o + 1) - math.log(math.pi)
    whole = [{} for _ in splits]
    for j, table in enumerate(nodes):
        for c in sorted(table, key=len, reverse=True):
            own = kt(*table[c])
            whole[j][c] = own if len(c) == depth else math.log(0.5) + np.logaddexp(own, sum(w for k, w in whole[j].items() if len(k) == len(c) + 1 and k[1:] == c))

    def one(j, context):
        left, out = 1.0, 0.0
        for d in range(depth + 1):
            c = context[depth - d :]
            if c not in nodes[j]:
                return last
            z, o = nodes[j][c]
            k = (o + 0.5) / (z + o + 1)
            last = out + left * k
            share = 1.0 if d == depth else math.exp(math.log(0.5) + kt(z, o) - whole[j][c])
            out, left = out + left * share * k, left * (1 - share)
        return last

    def log(context, b):
        a = len(symbols)
        escape = 1 / (byte.sum() + 2) if a < 256 else 0.0
        if b not in place:
            return math.log10(escape / (256 - a))
        p = math.log10(1 - escape)
        for j, (low, mid, high) in enumerate(splits):
            if low <= place[b] < high:
                q = one(j, context)
                p += math.log10(q if place[b] >= mid else 1 - q)
        return p

    return log


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_scores_match_a_plain_recursion(spark, depth):
    docs = spark.createDataFrame([(None if i == 9 else i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, part string").repartition(3)
    train = [t or "" for i, t in enumerate(TEXTS) if i == 9 or zlib.crc32(str(i).encode()) % 7 != 2]
    log = plain(train, depth)
    count = Counter(w for t in train for w in t.lower().split())
    n, v = sum(count.values()) + len(train), len(count) + 1
    for options in ({}, {"block_bytes": 300, "part_bytes": 500, "blocks_per_slice": 3}):
        got = {-1 if r.doc_id is None else r.doc_id: r for r in ctw.report(docs, depth=depth, **options).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            r = got[-1 if i == 9 else i]
            w = (t or "").lower().split()
            x = b"\xff" * depth + " ".join(w).encode() + b"\xff"
            want = sum(log(x[k - depth : k], x[k]) for k in range(depth, len(x)))
            assert r.score == pytest.approx(want, rel=1e-5), t
            assert r.bits_per_byte == pytest.approx(-want * math.log2(10) / (len(x) - depth), rel=1e-5)
            base = sum(math.log10((count[y] + 1) / (n + v + 1)) for y in w) + math.log10((len(train) + 1) / (n + v + 1))
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(y in count for y in w) + 1, n)
            assert r.base_score == pytest.approx(base) and r.held_out == (i != 9 and zlib.crc32(str(i).encode()) % 7 == 2)


def test_probabilities_sum_to_one():
    layout = ctw.Layout(3, 1, 1)
    x, at, _ = ctw.stream([b"abracadabra", b"", b"banana"], 3)
    code, n = np.unique(ctw.gram_codes(x, at, 3), return_counts=True)
    coder = ctw.Coder(np.bincount((code & np.uint64(255)).astype(int), n, 256))
    up = ctw._subtrees(code, n, coder, layout)[0].above()
    top = ctw.Top(up.key, up.zeros, up.ones, up.below, layout)
    for context in (b"bra", b"zra", b"zzz", b"\xff\xff\xff"):
        latest = int.from_bytes(context[::-1], "big") << 8
        asked = np.uint64(latest) + np.arange(256, dtype=np.uint64)
        assert (10 ** ctw.logs(asked, code, n, coder, top, layout)).sum() == pytest.approx(1)


def test_nothing_to_learn_from_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert ctw.report(docs.limit(0)).count() == 0
    got = ctw.report(docs, training=F.lit(False)).collect()
    assert {(r.doc_id, r.n_known, r.train_tokens) for r in got} == {(1, 0, 0), (2, 0, 0)} and len(got) == 3
    assert all(r.score < 0 for r in got)
    one, two = ctw.report(docs, training=F.lit(True)), ctw.report(docs.union(docs.where("doc_id = 1")), training=F.lit(True))
    assert max(r.score for r in two.where("doc_id = 1").collect()) > max(r.score for r in one.where("doc_id = 1").collect())
