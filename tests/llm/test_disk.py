"""What the near-copy stage leaves on disk while it runs, and its passes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash


def shuffled(spark):
    """{file: bytes} of the shuffle files that lie on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    r = random.Random(12)
    rows = []
    for i in range(600):
        base = [f"{r.getrandbits(40):x}" for _ in range(150)]
        rows += [(2 * i, " ".join(base), "a"), (2 * i + 1, " ".join([*base[:-1], "other"] if i % 3 else base[::-1]), "b")]
    at = str(tmp_path_factory.mktemp("disk"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{at}/docs")
    return spark.read.parquet(f"{at}/docs")


def test_dedup_removes_the_shuffles_of_its_steps(spark, frame):
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    out = simhash.dedup(frame)
    for _ in range(50):  # files are removed in the background
        left = sum(n for f, n in shuffled(spark).items() if f not in before)
        if left < 0.25 * size:
            break
        time.sleep(0.2)
    assert left < 0.25 * size
    before = shuffled(spark)
    kept = {r.doc_id for r in out.collect()}
    assert kept == {2 * i for i in range(600)} | {2 * i + 1 for i in range(0, 600, 3)}
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < 1.5 * size  # whole texts go once
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_passes_give_the_candidates_of_one(spark):
    r = random.Random(13)
    rows = []
    for _ in range(400):
        near = bytearray(r.randbytes(40))
        rows += [(r.getrandbits(62), bytes(near)), (r.getrandbits(62), bytes([near[0] ^ 1, *near[1:]]))]
    rows = [(n, s, r.randbytes(8) if k % 5 else b"together") for k, (n, s) in enumerate(rows)]
    classes = spark.createDataFrame(rows, "node long, sketch binary, prefix binary").repartition(3)
    one, many = ({tuple(x) for x in simhash.candidates(classes, 800, 32, 10, bucket_values=4096, routed=m).collect()} for m in (1000, 25))
    assert one == many and len({n for _, n, _ in one}) >= 800
