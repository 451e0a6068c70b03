"""What the toxicity query learns from, and its results on rows of every kind."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity

rng = random.Random(2)
WORDS = [f"w{i}" for i in range(60)]
FAST = {"toxic": 60, "clean": 120}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) + (" vile scum" * 3 if i % 3 == 0 else "") for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, `toxic` string, `__score` double")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_report_learns_and_leaves_the_held_out_fold_alone(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.report(docs, labels, **FAST).collect()}
    assert all(r.held_out == held_out(i) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    right = [r.predicted == int(i % 3 == 0) for i, r in got.items() if r.held_out]
    assert sum(right) >= 0.9 * len(right)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r for r in toxicity.report(docs, turned, **FAST).collect()}
    assert again == got  # labels of the held-out fold change nothing


def test_rows_of_every_kind(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(None, "vile scum vile scum", None, None), (900, None, "", 0.0), (901, "", "", 0.0), (902, "... !", "", 0.0), (903, "vile scum " * 30_000, "", 0.0), (3, "vile scum", "", 0.0)], docs.schema)
    odd_labels = spark.createDataFrame([(None, 1, 1), (900, None, 1), (904, 1, 1), (905, 1, None)], labels.schema)
    rows = docs.union(odd).union(docs.limit(5))
    got = toxicity.report(rows, labels.union(odd_labels).union(labels), **FAST).collect()
    assert len(got) == 211
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[900] == by[901] == by[902] == [0.0] and by[903][0] > 0.7 and by[None][0] > 0.5
    kept = toxicity.reject(rows, labels, **FAST)
    assert kept.columns == docs.columns and 903 not in {r.doc_id for r in kept.collect()}


def test_tables_without_rows_or_without_both_labels(corpus):
    docs, labels = corpus
    assert toxicity.report(docs.limit(0), labels).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert toxicity.report(docs, none, **FAST).where("predicted = 1").count() == 0


def test_the_sample_is_bounded_in_documents_and_bytes(corpus):
    docs, labels = corpus
    thrice = docs.union(docs).union(docs)
    texts, y = toxicity.training_sample(thrice, labels, 10, 20, 1 << 20)
    assert len(texts) == 30 and y.sum() == 10
    texts, _ = toxicity.training_sample(thrice, labels, 10, 20, 1000)
    assert 0 < sum(len(t) for t in texts) <= 1000
