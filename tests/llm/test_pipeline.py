"""The pipeline on the small test tables, and on a folder whose every decision is known."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import sharding

from .test_sharding import plain

rng = random.Random(21)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, d string, x int, cuts string, shard string"


def prose(n):
    return " ".join(f"v{rng.randrange(200)}" for _ in range(n))


def check(rows, columns, docs):
    by = {}
    for r in rows:
        by.setdefault(r[columns["shard"]], []).append(r.slot)
        assert r[columns["size"]] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert r[columns["shard"]] == plain("null" if r.doc_id is None else str(r.doc_id), sharding.balanced_tree(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_pipeline_runs_and_shards_every_piece(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    rows = out.collect()
    assert rows
    check(rows, {"shard": "shard", "size": "size"}, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "mixing", "sharding"]
    assert {(r.doc_id, r.lang, r.source) for r in rows} <= {(r.doc_id, r.lang, r.source) for r in docs.collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    leak = " ".join(f"bench{i}" for i in range(12))
    rows, kinds = [], {}

    def add(doc_id, text, source, kind):
        rows.append((doc_id, text, "en", source, 0, "d", 1, "c", "old"))
        kinds[len(rows) - 1] = kind

    for i in [*range(60), *range(1000, 1300)]:
        add(i, prose(80), ["a", "b", None][i % 3], "clean")
    for i in [*range(60, 120), *range(2000, 2100)]:
        add(i, prose(40) + " vile scum" * 4, "a", "toxic")
    for i in range(120, 130):
        add(i, f"{prose(30)} {leak} {prose(30)}", "b", "leak")
    for i in range(130, 140):
        add(i, rows[i - 130][1] + " and one more word", "b", "copy")
    add(None, prose(80), "b", "clean")
    add(7, prose(80), "b", "clean")  # another text under a used id
    rows.append(rows[5])
    kinds[len(rows) - 1] = "copy"
    for t in (None, "", "  "):
        add(200 + len(rows), t, "a", "blank")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kinds[k] == "toxic")) for k, (i, *_) in enumerate(rows[:520])], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("q", leak), (None, None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, kinds


def test_each_stage_decides_as_planted(spark, folder):
    at, rows, kinds = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    text = {i: r[1] for i, r in enumerate(rows)}
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, at)
    assert clean.columns == docs.columns
    left = Counter(r.text for r in clean.collect())
    want = Counter(t for i, t in text.items() if kinds[i] != "toxic")
    assert sum((left - want).values()) <= 3 and sum((want - left).values()) <= 0.1 * len(rows)  # a learned model
    clean = spark.createDataFrame([r for i, r in enumerate(rows) if kinds[i] != "toxic"], docs.schema)
    once = steps["simhash_dedup"](spark, clean, at)
    assert once.columns == docs.columns
    got = Counter(r.text for r in once.collect())
    assert got == Counter({t: 1 for i, t in text.items() if kinds[i] in ("clean", "leak")} | {None: 1})  # one of the blank ones
    once = spark.createDataFrame(once.collect(), docs.schema)
    safe = steps["decontamination"](spark, once, at)
    assert Counter(r.text for r in safe.collect()) == Counter({t: 1 for i, t in text.items() if kinds[i] == "clean"} | {None: 1})


def test_the_whole_keeps_every_column_and_source(spark, folder):
    at, rows, kinds = folder
    out = corpus_pipeline.run(spark, at)
    assert out.columns == [*[f.split()[0] for f in DOCS.split(", ")], "size", "text_crc32", "shard_", "slot"]
    got = out.collect()
    check(got, {"shard": "shard_", "size": "size"}, rows)
    assert {r.source for r in got} == {"a", "b", None} and {(r.d, r.x, r.cuts, r.shard) for r in got} == {("d", 1, "c", "old")}
    text = " ".join(r.text for r in got)
    assert text.count("vile scum vile") <= 20 and "bench3" not in text


def test_no_documents(spark, folder, tmp_path):
    at, _, _ = folder
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
