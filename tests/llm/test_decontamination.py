"""Benchmark windows and longest matches against brute force."""

import hashlib
import random
import re

import numpy as np

from tessera.llm import decontamination

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(40)]
LONG = " ".join(rng.choice(WORDS) for _ in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(30))
TEXTS = [None, "", " \t\n ", "one two three", "one two three", "ONE two three", PASSAGE, f"start {PASSAGE} end", f"other {PASSAGE} tail {PASSAGE}", LONG, LONG + " more", "é ß x1 " * 20, "two three one two three four", " ".join(PASSAGE.split()[:9])]
ITEMS = [(1, PASSAGE), (2, "one two three"), (3, None), (4, ""), (5, " ".join(LONG.split()[5:25])), (6, "nowhere to be found at all in these texts we hope so"), (7, "É ß x1 é ß x1 é ß x1 é ß x1 é"), (1, "two three"), (None, " ".join(LONG.split()[100:140])), (None, "tail p0")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(text, items, window=10):
    w, hit, named, best = found(text), set(), set(), None
    for name, item in items:
        x = found(item)
        k = min(window, len(x))
        places = [(i, j) for j in range(len(x) - k + 1) for i in range(len(w) - k + 1) if k and w[i : i + k] == x[j : j + k]]
        for i, _ in places:
            hit |= set(range(i, i + k))
            named.add(name)
    for name, item in items:
        x = found(item)
        if name in named:
            run = {}
            for i in range(len(w)):
                run = {j: (run.get(j - 1, 0) + 1) for j in range(len(x)) if w[i] == x[j]}
                for n in run.values():
                    one = (n, -(i - n + 1), name is not None, str(name or ""))
                    best = one if best is None or one > best else best
    ids = sorted({str(n) for n in named if n is not None})
    longest = (None, 0, -1) if best is None else (best[3] if best[2] else None, best[0], -best[1])
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), *longest


def test_report_matches_brute_force(spark):
    docs = spark.createDataFrame([(None if i == 6 else i, t, "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, __items string, found int").repartition(3)
    docs = docs.union(docs.where("doc_id = 7"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = [plain(t, ITEMS) for t in TEXTS]
    for options in ({}, {"block_bytes": 60}, {"shard_bytes": 50}):
        rows = decontamination.report(docs, bench, **options).collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            assert tuple(r)[1:] == want[6 if r.doc_id is None else r.doc_id], r
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w[4]]
    assert decontamination.report(docs.limit(0), bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(TEXTS) + 1


def test_a_very_long_item_takes_memory_in_proportion(spark):
    many = [f"t{rng.randrange(3000)}" for _ in range(50_000)]
    items = decontamination.Items([None, "long"], ["a b c", " ".join(many)], 10)
    assert sum(x.nbytes for q in (items.suffixes, items.windows) for x in (q.words, q.start, q.size)) < 10_000_000
    docs = spark.createDataFrame([(1, "x " + " ".join(many[20_000:40_000]) + " y"), (2, " ".join(many[:9]))], "doc_id long, text string")
    bench = spark.createDataFrame([("long", " ".join(many))], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.longest_words, r.longest_at) for r in decontamination.report(docs, bench).collect()}
    assert got == {1: (20_000, 20_000, 1), 2: (0, 0, -1)}


def test_suffixes_are_in_order():
    ids = np.array([3, 1, 2, 1, 2, 0, 1, 2, 1, 0, 2, 2, 2, 2, 0])
    array = decontamination.SuffixArray(ids, 20)
    text = lambda p: ids[p : p + array.run[p]].tolist()
    assert [text(p) for p in array.sa] == sorted(text(p) for p in np.flatnonzero(ids))
