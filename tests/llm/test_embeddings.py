"""The epsilon grid order join against all pairs."""

import numpy as np
import pytest

from tessera.llm import embeddings


def check(spark, rows, kind="float", cosine=0.98):
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], f"vec_id long, embedding array<{kind}>, label int, `id` string, `n` int").repartition(3)
    f = np.float32 if kind == "float" else np.float64
    ok = [i for i, x in enumerate(rows) if x[1] and x[0] is not None and x[2] is not None and None not in x[1] and np.isfinite(f(x[1])).all() and np.any(f(x[1]))]
    u = {i: f(rows[i][1]).astype(float) / np.linalg.norm(f(rows[i][1]).astype(float)) for i in ok}
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ok):
        for j in ok[:k]:
            if rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in ok:
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    want = [(x[0], links[i], least.get(top(i), x[0]), x[0] is None or least.get(top(i), x[0]) == x[0]) for i, x in enumerate(rows)]
    key = lambda r: str(r)
    assert sorted(map(tuple, embeddings.near_duplicates(df, cosine).collect()), key=key) == sorted(want, key=key)
    return df


@pytest.mark.parametrize("kind", ["float", "double"])
def test_rows_of_every_kind(spark, kind):
    r = np.random.default_rng(2)
    base = r.standard_normal((20, 16))
    vecs = [base[i % 20] + 0.02 * r.standard_normal(16) * (i % 3) for i in range(120)]
    rows = [(i, [float(x) for x in np.float32(v)], i % 2) for i, v in enumerate(vecs)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 0), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (208, [], 0), (209, [float("inf")] * 16, 0), (None, rows[0][1], 0), rows[3], rows[3]]
    df = check(spark, rows, kind)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_many_small_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 12)) * np.array([3, 2, 1.5] + [0.3] * 9)
    rows = [(i, [float(x) for x in np.float32(centres[r.integers(40)] * r.uniform(0.5, 2) + 0.08 * r.standard_normal(12))], int(i % 9 == 0)) for i in range(1500)]
    whole = embeddings.linked
    monkeypatch.setattr(embeddings, "linked", lambda found, cosine: whole(found, cosine, block_rows=8))
    check(spark, rows, cosine=0.99)


def test_block_pairs_grow_about_in_proportion(spark):
    r = np.random.default_rng(4)
    for k in (40, 160, 480):  # blocks of one label
        x = np.stack([r.uniform(-1, 1, 64 * k), r.uniform(-1, 1, 64 * k)], 1)
        rows = [(i, [1.0, *map(float, v)], 1) for i, v in enumerate(x)]
        found = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        assert k <= embeddings.near_blocks(embeddings.blocks(found, 0.02, 64), 0.02).count() <= 12 * k
