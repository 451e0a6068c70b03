"""Mixing against a plain account of blocks, draws and permutations."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

rng = random.Random(7)


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(300):
        source = None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}"
        rows.append((i, None if i == 3 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 40, 90]))), source, "x", i, None))
    rows += [(300, "long " * 5000, "s1", "x", 0, None), (None, "no id here", "s2", "x", 0, None), *[rows[10]] * 4, (10, rows[10][1], "s6", "y", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, d string, x long, cuts string").repartition(5)


def targets(size):
    """By source: water-filling, worked out step by step."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(size.values()), set(names), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * size[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * size[s]
            left -= out[s]
            open_.remove(s)
        if not open_:
            return out


@pytest.mark.parametrize("shards", [1, 7])
def test_taken_is_what_blocks_and_draws_say(docs, shards):
    block = 16
    sized = mixing.checkpoint(mixing.sizes(docs).select(F.monotonically_increasing_id().alias("row"), "*"))
    planned = mixing.plan(sized, block)
    size = Counter()
    for r in sized.collect():
        size[r.source] += r["size"]
    plan = {r.source: r for r in planned.collect()}
    for s, t in targets(size).items():
        assert plan[s].target == pytest.approx(t) and plan[s].blocks == -(-size[s] // block)
    slots = mixing.slots(planned, shards, chunk=64).collect()
    times = Counter((s.rank, s.block) for s in slots)
    for p in plan.values():
        n = [times[p.rank, b] for b in range(p.blocks)]
        assert sum(n) == p.slots and (not n or max(n) - min(n) <= 1) and all(x <= 3 for x in n)
    draws = {(r.rank, r.shard): r.n for r in mixing.drawn(planned, shards, chunk=64).collect()}
    assert draws == Counter((s.rank, s.shard) for s in slots)
    cut = mixing.pieces(sized.select("row", "source", "size"), planned, block).collect()
    laid = Counter()
    for c in cut:
        laid[c.rank, c.block] += c.n_words
    for p in plan.values():  # the pieces fill all blocks
        assert [laid[p.rank, b] for b in range(p.blocks)] == [min(block, size[p.source] - b * block) for b in range(p.blocks)]
    want = Counter()
    for c in cut:
        want[c.row] += c.n_words * times[c.rank, c.block]
    rows = {r.row: r for r in sized.collect()}
    got = mixing.taken(docs, block, shards)
    key = lambda r: (r[0] is None, *[x if x is not None else -1 for x in r])
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got.collect()), key=key) == sorted(((r.doc_id, r["size"], want[k]) for k, r in rows.items()), key=key)
    assert {(r.first_shard, r.last_shard) for r in got.collect() if r.taken} >= {(0, shards - 1)}
    assert sorted(got.collect(), key=key) == sorted(mixing.taken(docs, block, shards).collect(), key=key)


def test_every_source_and_word_of_the_mix_comes_from_its_document(docs):
    block = 16
    planned = {r.source: r for r in mixing.plan(mixing.sizes(docs).withColumn("row", F.lit(0)), block).collect()}
    out = mixing.mix(docs, block, shards=5)
    assert out.columns == docs.columns
    rows = out.collect()
    words = Counter()
    for r in rows:
        words[r.source] += len(tokens(r.text))
    for s, p in planned.items():
        assert abs(words[s] - p.target) <= 3 * block + 0.02 * p.target, s
    texts = {}
    for r in docs.collect():
        texts.setdefault((r.doc_id, r.source, r.d, r.x), set()).add(" ".join(tokens(r.text)))
    assert all(any(" ".join(tokens(r.text)) in t for t in texts[r.doc_id, r.source, r.d, r.x]) for r in rows)
    assert {r.shard_ for r in mixing.mix(docs, block, 5, shard="shard_").collect()} == set(range(5))


def test_one_document_in_two_sources_is_in_both(spark):
    docs = spark.createDataFrame([(1, "a b c", "s1"), (1, "a b c", "s2")], "doc_id long, text string, source string")
    assert {r.source for r in mixing.mix(docs, 2).collect()} == {"s1", "s2"}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.taken(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], docs.schema)
    assert {(r.doc_id, r.taken) for r in mixing.taken(blank).collect()} == {(1, 0), (2, 0)} and mixing.mix(blank).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 97):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), 3).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
