"""The template tree against a plain one over lists, on random lines with repeated rows."""

import random
import re
from collections import defaultdict

from tessera.llm import templates

rng = random.Random(11)


def plain(docs, min_lines=3, share=0.5):
    """{(doc_id, text): sorted numbers of the lines that go}."""
    docs = list(dict.fromkeys(docs))

    def recurs(found):
        return {k for k, v in found.items() if len(v) >= min_lines and len({d for d, _ in v}) > 1}

    split, leaves = {}, defaultdict(list)
    for d, (_, text) in enumerate(docs):
        for i, line in enumerate((text or "").split("\n")):
            t = [w for w in re.split(r"[ \t\r\f\x0b]+", line) if w]
            if t:
                lead = tuple("<*>" if re.search("[0-9]", w) else w for w in [*t, "", "", ""][:3])
                split[d, i] = (len(t), lead), t
                leaves[len(t), lead].append((d, i))
    held = recurs(leaves)
    places, shaped = defaultdict(list), defaultdict(list)
    for at, (leaf, t) in split.items():
        if leaf in held:
            for j, w in enumerate(t):
                places[leaf, j, w].append(at)
    fixed = recurs(places)
    for at, (leaf, t) in split.items():
        constant = tuple((j, w) for j, w in enumerate(t) if (leaf, j, w) in fixed)
        if leaf in held and len(constant) >= share * len(t) and constant:
            shaped[leaf, constant].append(at)
    good = recurs(shaped)
    gone = defaultdict(list)
    for k in good:
        for d, i in shaped[k]:
            gone[docs[d]].append(i)
    return {d: sorted(gone[d]) for d in docs}


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, `row` string, line int").repartition(3)
    want = plain(docs)
    got = templates.report(df).collect()
    n = lambda t: sum(bool(x.strip(" \t\r\f\x0b")) for x in (t or "").split("\n"))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in got), key=key) == sorted(((i, n(t), len(want[i, t]), want[i, t]) for i, t in docs), key=key)
    left = lambda i, t: t if not want[i, t] else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i, t])
    out = templates.drop_lines(df)
    assert out.columns == df.columns
    text = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=text) == sorted(((i, left(i, t)) for i, t in docs), key=text)


def test_random_lines_match_a_plain_tree(spark):
    def line():
        k = rng.random()
        if k < 0.3:
            return f"user {rng.randrange(99)} logged in from {rng.choice('abc')} {rng.randrange(9)}"
        if k < 0.5:
            return rng.choice(["All rights reserved by us", "terms apply", "", " \t", "x"])
        return " ".join(rng.choice(["red", "blue", "a1", "b2", "the", "of"]) for _ in range(rng.randrange(1, 7)))

    docs = [(None if i % 17 == 0 else i % 30, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "long " * 3000)]
    check(spark, docs + docs[:20] + docs[:5])


def test_repeated_rows_change_nothing(spark):
    shared = [(i, f"shared boiler plate line number {i}\nown {chr(97 + i) * 5}") for i in range(3)]
    check(spark, shared)
    check(spark, [*shared, shared[1]])
    own = [(i, f"all of these tokens {' '.join(chr(97 + i) + str(j) for j in range(9))}") for i in range(4)]
    check(spark, own)
    check(spark, own * 2)
    assert plain(own * 2) == plain(own) and plain([*shared, shared[1]]) == plain(shared)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert templates.report(df).count() == 0 and templates.drop_lines(df).count() == 0
