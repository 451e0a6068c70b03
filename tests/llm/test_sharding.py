"""The hash tree against a plain descent, its movements, and the slots."""

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding
from tessera.llm.sharding import Node


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def draw(key, path, weight):
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    u = (signed(xxhash.xxh64_intdigest(path.encode(), seed)) % (1 << 52) + 0.5) / (1 << 52)
    return -math.log(u) / weight


def plain(key, node, path=""):
    if not node.children:
        return node.name
    best = min((c for c in node.children if c.open), key=lambda c: draw(key, f"{path}/{c.name}", c.weight))
    return plain(key, best, f"{path}/{best.name}")


def places(spark, tree, n=4000):
    return {r.id: r.shard for r in sharding.shard(spark.range(n), "id", tree).collect()}


def tree(a=1.0, b=1.0, inner=2.0, right=1.0):
    return Node(0, 1.0, (Node(0, inner, (Node(0, 1.0, (Node(0, a), Node(1, b))), Node(1, 3.0, (Node(2), Node(3))))), Node(1, right, (Node(0, 1.0, (Node(4), Node(5, 0.0))),))))


def test_descent_matches_a_plain_one(spark):
    for t in (tree(), tree(a=4, inner=0.5), sharding.balanced_tree(16), sharding.balanced_tree(3)):
        got = places(spark, t, 500)
        assert got == {i: plain(str(i), t) for i in range(500)}


def test_shares_follow_the_weights_of_every_level(spark):
    n = Counter(places(spark, tree(a=3.0)).values())
    want = {0: 2 / 3 / 4 * 3 / 4, 1: 2 / 3 / 4 / 4, 2: 2 / 3 * 3 / 4 / 2, 3: 2 / 3 * 3 / 4 / 2, 4: 1 / 3}
    assert set(n) == set(want) and all(n[s] / 4000 == pytest.approx(p, abs=0.03) for s, p in want.items())
    assert all(x == pytest.approx(250, abs=60) for x in Counter(places(spark, sharding.balanced_tree(16)).values()).values())


def test_movement_is_confined_to_what_changed(spark):
    old = places(spark, tree())
    new = places(spark, tree(a=2.5))  # a shard's weight: within its rack, and only into it
    moved = {(old[i], new[i]) for i in old if old[i] != new[i]}
    assert moved == {(1, 0)}
    new = places(spark, tree(right=4.0))  # a region's weight: from the other region into this one
    moved = {(old[i], new[i]) for i in old if old[i] != new[i]}
    assert moved and {b for _, b in moved} == {4}
    for n in range(1, 21):
        a, b = places(spark, sharding.balanced_tree(n), 400), places(spark, sharding.balanced_tree(n + 1), 400)
        assert {b[i] for i in a if a[i] != b[i]} <= {n}
    with pytest.raises(ValueError):
        sharding.descend(F.lit(1), Node(0, 1.0, (Node(1, 0.0),)))


def test_documents_have_gapless_slots(spark):
    rows = [(i, f"text {i} é", "a", "b") for i in range(200)] + [(None, None, "a", "b"), (None, "", "a", "b"), (7, "other", "a", "b")] + [(9, "equal", "x", "y")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, __part string").repartition(4)
    got = sharding.shard_documents(docs).collect()
    text = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == text
    assert all(r.shard == plain("null" if r.doc_id is None else str(r.doc_id), sharding.balanced_tree(16)) and r.grown_shard in (r.shard, 16) and r.law == "key" for r in got)
    whole = sharding.shard_whole(docs)
    assert whole.columns == [*docs.columns, "size", "text_crc32", "shard_", "slot"]
    few = sharding.with_slots(sharding.shard(docs, "doc_id", sharding.balanced_tree(2), "s"), "s", ["doc_id", "text"], rows_per_task=20)
    for out, name in ((got, "shard"), (whole.collect(), "shard_"), (few.collect(), "s")):
        by = {}
        for r in out:
            by.setdefault(r[name], []).append(r.slot)
        assert len(out) == len(rows) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0
