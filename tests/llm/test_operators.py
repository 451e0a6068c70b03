"""Small fixtures against brute force, with nulls, blanks, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import revisits, simhash, substring, toxicity

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(40)]
LONG = " ".join(rng.choice(WORDS) for _ in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(30))
TEXTS = [None, "", " \t\n ", "one two three", "one two three", "ONE two three", PASSAGE, f"start {PASSAGE} end", f"other {PASSAGE} tail {PASSAGE}", LONG, LONG + " more", "é ß x1 " * 20]


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 4 == 0 else f"src{i % 3}", 0, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_simhash_matches_brute_force(docs, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {}
    for i, t in enumerate(TEXTS):
        w = tokens(low(t))
        sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{fps[i]:016x}"
    root = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r.component_id for i, r in got.items()} == root
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_repeats_and_null_ids(spark, docs):
    null = spark.createDataFrame([(None, TEXTS[7]), (None, "a text that no other row has at all")], "doc_id long, text string")
    rows = docs.select("doc_id", "text", F.lit(1).alias("fp"), F.lit(2).alias("root"))
    more = rows.union(rows.where("doc_id in (1, 7)")).unionByName(null, allowMissingColumns=True)
    got = simhash.near_duplicates(more).collect()
    one = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert len(got) == len(TEXTS) + 4
    assert all((r.fingerprint, r.component_id) == one[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted((r.component_id or -1) for r in got if r.doc_id is None) == sorted([-1, one[7][1]])


def test_ball_links_hold_for_random_fingerprints(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.int64)
    flip = lambda x: int(np.bitwise_xor.reduce(np.append(x, np.int64(1) << r.choice(63, r.integers(1, 6), replace=False).astype(np.int64))))
    fps = sorted({int(x) for x in base} | {flip(x) for x in base for _ in range(3)})
    from tessera.llm.graph import components

    found = {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket_values=1 << 12)).collect()}
    root = {x: x for x in fps}
    for _ in range(6):
        for x in fps:
            for y in fps:
                if (x ^ y).bit_count() <= 4:
                    root[x] = root[y] = min(root[x], root[y])
    assert {x: found.get(x, x) for x in fps} == root


def test_substring_matches_brute_force(docs, empty):
    first = {}
    for i, t in enumerate(TEXTS):
        w = tokens(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    null = docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.union(docs.where("doc_id in (6, 8)")).union(null)
    for size in (1 << 22, 200):
        found = substring.report(rows, block_bytes=size).collect()
        assert len(found) == len(TEXTS) + 3 and len({r for r in found if r.doc_id in (6, 8)}) == 2
        assert [r.n_removed for r in found if r.doc_id is None] == [32]
        got = {r.doc_id: r for r in found}
        for i, t in enumerate(TEXTS):
            w = tokens(t)
            gone = [False] * len(w)
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
            kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.report(empty).count() == 0


def test_revisits_across_time_spans(spark):
    h = {"Content-Type": "text/html", "Expires": "0"}
    rows = [(1, "http://www.a.com/x", 10, "response", "t1", None, "d1", h), (2, "https://a.com/x/", 20, "response", "t2", None, "d2", h), (3, "http://a.com/x", 20, "revisit", "t1", None, None, {"expires": "9", "Content-Length": "0"}), (4, "http://A.com/x#f", 30, "revisit", "t1", None, None, None), (5, "http://b.com", 30, "revisit", "t", None, None, None), (6, None, 1, "revisit", None, None, None, None), (7, "http://a.com/x", 40, "revisit", None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert (got[3].status, got[3].response_id, got[3].payload) == ("resolved", 1, "d1")
    assert got[3].headers == {"Content-Type": "text/html", "expires": "9"}
    assert [got[i].status for i in (4, 5, 6, 7)] == ["mismatch", "no_response", "no_response", "unproven"]
    assert revisits.resolve(df.limit(0)).count() == 0
    twice = revisits.resolve(df.union(df)).groupBy("record_id", "status", "response_id").count().collect()
    assert all(r["count"] == 2 for r in twice) and len(twice) == len(got)
    held = F.col("record_id")
    one = revisits.as_of(df.where("url is not null"), "kind", "at", F.col("etag") == "t1", held, "record_id")
    many = revisits.as_of(df.where("url is not null"), "kind", "at", F.col("etag") == "t1", held, "record_id", rows_per_span=1)
    key = lambda d: sorted((r.record_id, r.latest or 0) for r in d.collect())
    assert key(one) == key(many)


def test_a_hot_url_over_many_spans(spark):
    r = random.Random(8)
    rows = [(i, None if r.random() < 0.02 else "http://hot.com" if r.random() < 0.6 else f"http://h{r.randrange(9)}.com", None if r.random() < 0.02 else r.randrange(300), r.choice(["response", "revisit", "revisit"])) for i in range(800)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string").repartition(5)
    for per_span in (10, 100, 10_000):
        got = revisits.as_of(df.where("url is not null and at is not null"), "url", "at", F.col("kind") == "response", F.struct("record_id", "at"), "record_id", rows_per_span=per_span)
        for x in got.where("kind = 'revisit'").collect():
            want = max(((t, i) for i, u, t, k in rows if u == x.url and k == "response" and t is not None and t < x["at"]), default=None)
            assert (None if x.latest is None else (x.latest["at"], x.latest.record_id)) == want


def test_ports_follow_the_scheme(spark):
    urls = ["http://www.A.com:80/x/", "https://a.com:443/x", "http://a.com:443/x", "https://a.com:80/x", "a.com:80/x", "HTTP://a.com:80/x?utm_source=1&b=2#f", None, ""]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(revisits.canonical(F.col("u")).alias("c")).collect()]
    assert got == ["a.com/x", "a.com/x", "a.com:443/x", "a.com:80/x", "a.com:80/x", "a.com/x?b=2", None, ""]


def test_toxicity_gradients_and_learning():
    r = np.random.default_rng(0)
    net = toxicity.Network(np.sort(r.integers(0, 1 << 60, 5).astype(np.uint64)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    known, grams, first = np.array([0, 1, 2]), np.array([5, 9, 5, 7]), np.array([0, 1, 3])
    index, y = np.array([[0, 1, 2, 1], [2, 0, 0, 1]]), np.array([1.0, 0.0])

    def loss():
        p = toxicity.sigmoid(net.forward(net.project(net.inputs(known, grams, first)), index)[0])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    rows, g = net.gradients(known, grams, first, index, y)
    for k in ("word", "char", "Wf", "Uf", "cf", "Wb", "Ub", "Wa", "ba", "va", "wo"):
        at = tuple(0 for _ in g[k].shape)
        place = (rows[k][0], *at[1:]) if k in rows else at
        old = net.p[k][place]
        net.p[k][place] = old + 1e-4
        up = loss()
        net.p[k][place] = old - 1e-4
        down = loss()
        net.p[k][place] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_toxicity_learns_and_scores_blanks(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(WORDS) for _ in range(40)) for _ in range(80)]
    labels = [i % 2 for i in range(80)]
    texts = [t + " nasty" * 3 if y else t for t, y in zip(texts, labels, strict=True)]
    net = toxicity.train(texts, np.array(labels), rounds=3, min_steps=150)
    df = spark.createDataFrame([(1, " ".join(WORDS)), (2, " ".join(WORDS) + " so nasty nasty " + " ".join(WORDS)), (3, None), (4, "...")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(df, net).collect()}
    assert got[1] < 0.5 < got[2] and got[3] == got[4] == 0.0


def test_near_copies_match_brute_force(spark, docs, empty):
    r = random.Random(9)
    texts = list(TEXTS)
    for _ in range(25):
        base = [f"v{r.randrange(5000)}" for _ in range(r.randrange(60, 400))]
        for edits in (0, 1, 2, 3, 6):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"e{r.randrange(5000)}"
            texts.append(" ".join(copy))
    frame = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, node long")
    sets = []
    for t in texts:
        w = tokens(low(t))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame).collect()}
    assert sum(got[i] == x for i, x in enumerate(root)) >= 0.97 * len(root)
    assert all(got[i] in (x, i) or root[got[i]] == x for i, x in enumerate(root))  # no link that is not there
    kept = simhash.dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({*got.values()})
    assert simhash.near_copies(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_near_copies_in_a_crowd_match_brute_force(spark):
    r = random.Random(4)
    core = [f"c{i}" for i in range(320)]
    texts = []
    for g in range(220):  # a crowd a little below the threshold, with pairs a little above it
        base = list(core)
        for i in r.sample(range(320), 5):
            base[i] = f"g{g}x{i}"
        for m in range(2):
            one = list(base)
            for i in r.sample(range(320), 3):
                one[i] = f"g{g}m{m}x{i}"
            texts.append(" ".join(one))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = [top(i) for i in range(len(texts))]
    assert 50 < len(set(want)) < len(want)  # neither all alone nor all one
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.component_id for x in simhash.near_copies(frame, block=64).orderBy("doc_id").collect()]
    assert got == want


def test_dedup_of_ids_that_are_null_or_shared(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a, 1), (None, b, 1), (None, b, 1), (5, a + " more", 1), (7, c, 1), (7, c + " more", 2), (7, "quite another text", 3), (8, None, 1), (9, "", 1)]
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, `__x` int"))
    assert kept.columns == ["doc_id", "text", "__x"]
    got = sorted(((r.doc_id or 0), r.text or "") for r in kept.collect())
    assert got[:2] == [(0, a), (0, b)] and (7, "quite another text") in got and (8, "") in got and len(got) == 5


def test_near_copies_of_few_words(spark):
    texts = []
    for g in range(100):  # 4 shingles in 5: a similarity of 0.8
        words = [f"s{g}w{i}" for i in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame).collect()}
    assert got == {i: i - i % 2 for i in range(200)}
