"""Prefixes of small sets: no pair is missed, and a passage that many share makes no candidates."""

import random

import numpy as np

from tessera.llm import simhash


def test_a_shared_passage_makes_no_cluster(spark, monkeypatch, tmp_path):
    r = random.Random(21)
    passage = [f"p{i}" for i in range(9)]
    rows = [(i, " ".join([*passage, *(f"{r.getrandbits(40):x}" for _ in range(14))])) for i in range(3500)]
    copy = rows[7][1].split()
    rows.append((5000, " ".join([*copy[:-1], "other"])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    sizes, linked = [], simhash._linked

    def watched(texts, cluster, *rest):
        sizes.append(cluster.count())
        return linked(texts, cluster, *rest)

    monkeypatch.setattr(simhash, "_linked", watched)
    found = {x.doc_id: x.component_id for x in simhash.near_copies(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    assert found == {i: i for i, _ in rows} | {5000: 7}
    assert sizes[0] < 100  # over 1,024 were one cluster when a prefix held the least hashes


def test_prefixes_miss_no_pair(spark):
    r = np.random.default_rng(22)
    pool = r.integers(1, 1 << 63, 60, dtype=np.int64)
    sets = {0: {1}, 1: {1}, 2: {1, 2, 3, 4}, 3: {1, 2, 3, 4, 5}}
    for i in range(4, 300):
        sets[i] = set(r.choice(pool, r.integers(1, 39), replace=False).tolist())
        if i % 2:
            sets[i] = set(list(sets[i - 1])[: max(1, len(sets[i - 1]) - i % 4)])
    frame = spark.createDataFrame([(n, np.sort(np.array(sorted(h), np.int64)).tobytes()) for n, h in sets.items()], "node long, small binary")
    got = {x.node: {bytes(x.prefix[i : i + 8]) for i in range(0, len(x.prefix), 8)} for x in simhash.prefixed(frame, 0.8).collect()}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert len(got) == len(sets) and len(close) > 50
    assert all(got[a] & got[b] for a, b in close)
