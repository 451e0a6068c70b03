import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import Dataset
from tessera.tools import BatchLoader, CatCol, ContCol, DatasetGen, DatasetInspector, PowerLawDistro, UniformDistro


def test_generated_columns_follow_their_distribution(spark):
    for d in (UniformDistro(), PowerLawDistro(1.5)):
        df = DatasetGen(d, seed=3).create_df(spark, 4000, {"conts": [ContCol("x", "double", 1, 50)], "cats": [CatCol("c", cardinality=10, multi_min=1, multi_max=3, width=2)]})
        assert df.columns == ["x", "c_0", "c_1"]
        assert d.verify(np.array([r.x for r in df.collect()]), 1, 50) > 0.9
        low, high = df.select(F.min(F.size("c_0")), F.max(F.size("c_0"))).first()
        assert (low, high) == (1, 3)


def test_inspector(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "bb")], "x double, c string")
    got = DatasetInspector().inspect(Dataset(df), {"conts": ["x"], "cats": ["c"]})
    assert got["num_rows"] == 2 and got["conts"]["x"]["per_nan"] == 50 and got["cats"]["c"]["cardinality"] == 2


def test_batches(spark):
    df = spark.range(25).select("id", (F.col("id") % 2).alias("y"))
    loader = BatchLoader(Dataset(df), 10, cats=["id"], labels=["y"], drop_last=True)
    sizes = [len(x["id"]) for x, _ in loader]
    assert sizes == [10, 10] and len(loader) == 2
    parts = [np.concatenate([x["id"] for x, _ in BatchLoader(Dataset(df), 10, cats=["id"], global_size=2, global_rank=r)]) for r in (0, 1)]
    assert sorted(np.concatenate(parts)) == list(range(25))


def test_files_of_different_schemas_are_rejected_on_request(spark, tmp_path):
    from tessera import Dataset

    a, b, c = (str(tmp_path / x) for x in "abc")
    spark.createDataFrame([(1, "x")], "i int, s string").write.parquet(a)
    spark.createDataFrame([(2, "y")], "i int, s string").write.parquet(b)
    spark.createDataFrame([(2,)], "i int").write.parquet(c)
    assert Dataset([a, b], check_schema=True).num_rows == 2
    with pytest.raises(ValueError, match="differ"):
        Dataset([a, c], check_schema=True)
    with pytest.warns(UserWarning, match="maxPartitionBytes"):
        Dataset(a, part_size="128MB")


def test_npy_of_ids_and_vectors(spark, tmp_path):
    from tessera import Dataset

    ds = Dataset(spark.createDataFrame([(1, [0.5, 2.0]), (2, [1.0, 4.0])], "i int, v array<double>").coalesce(1))
    assert ds.to_npy(str(tmp_path / "m.npy")).tolist() == [[1, 0.5, 2], [2, 1, 4]]
    with pytest.raises(ValueError, match="more than 1"):
        ds.to_npy(str(tmp_path / "m.npy"), max_rows=1)


def test_a_saved_graph_may_not_import_what_it_likes(spark, tmp_path):
    import json

    from tessera import Workflow, ops
    from tessera.operators.base import SerializationError

    path = str(tmp_path / "w")
    df = spark.createDataFrame([(1,)], "i int")
    Workflow(["i"] >> ops.Rename(postfix="_x")).fit(df).save(path)
    graph = json.loads(spark.read.text(f"{path}/graph.json", wholetext=True).first()[0])
    for n in graph["nodes"]:
        if n.get("op") == "Rename":
            n["params"] = {"f": "this:main", "postfix": None, "name": None}
    spark.createDataFrame([(json.dumps(graph),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/graph.json")
    with pytest.raises(SerializationError, match="trusted"):
        Workflow.load(path)


def test_features_say_what_a_model_is_fed(spark, tmp_path):
    from tessera.tools.features import Bucketized, Crossed, Fed, Hashed, Identity, Numeric, Vocabulary, feature_workflow

    (tmp_path / "words.txt").write_text("red\nblue\n")
    df = spark.createDataFrame([(1, 0.5, "blue", 3, "a"), (2, 7.0, "green", 4, "b"), (3, None, None, 0, None)], "y int, x double, c string, k int, h string")
    features = [Bucketized("x", (1.0, 5.0), embedding=8), Vocabulary("c", file=str(tmp_path / "words.txt")), Identity("k", 5), Hashed("h", 11), Crossed(("c", "h"), 13), Numeric("x")]
    workflow, fed = feature_workflow(features, label="y")
    assert fed == [Fed("x"), Fed("x_buckets", 3, 8), Fed("c", 5), Fed("k", 5), Fed("h", 11), Fed("c_X_h", 13)]
    out = {r.y: r for r in workflow.fit_transform(Dataset(df)).df.collect()}
    assert [out[i].c for i in (1, 2, 3)] == [4, 2, 1] and [out[i].x_buckets for i in (1, 2)] == [0, 2] and out[3].x is None
    assert out[3].h is None and out[3].c_X_h is None and all(0 <= out[i].c_X_h < 13 and 0 <= out[i].h < 11 for i in (1, 2))
    assert [out[i].k for i in (1, 2, 3)] == [3, 4, 0]
    for bad in ([Vocabulary("c")], [Numeric("x"), Numeric("x")], []):
        with pytest.raises(ValueError):
            feature_workflow(bad)
