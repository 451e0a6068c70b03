import math

import pytest
from pyspark.sql import functions as F

from tessera import ColumnSelector, Dataset, Subgraph, Workflow, get_embedding_sizes, ops
from tessera.schema import ColumnSchema, Schema, Tags

NAN = float("nan")


def run(node, df):
    return Workflow(node).fit_transform(Dataset(df)).df


def col(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_fill_keeps_null_and_nan_apart_from_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, NAN)], "i int, x double")
    out = run(["i"] + (["x"] >> ops.FillMissing(5, add_binary_cols=True)), df)
    assert col(out, "x", "i") == [1.0, 5.0, 5.0]
    assert col(out, "x_filled", "i") == [False, True, True]
    assert col(run(["i"] + (["x"] >> ops.FillMedian()), df), "x", "i") == [1.0, 1.0, 1.0]


def test_medians_are_exact_in_two_passes(spark):
    import random
    import statistics

    from tessera.operators.stat import medians

    rng = random.Random(4)
    for n in (1, 2, 501, 1000):
        rows = [(rng.gauss(0, 1), float(rng.randrange(5)), None, rng.choice([None, 1.0, 2.0])) for _ in range(n)]
        df = spark.createDataFrame(rows, "a double, b double, c double, d double")
        got = medians(df, {c: F.col(c) for c in "abcd"}, accuracy=20)
        want = {c: [r[i] for r in rows if r[i] is not None] for i, c in enumerate("abcd")}
        assert got == {c: statistics.median(v) if v else None for c, v in want.items()}


def test_clip_and_log_at_the_edges(spark):
    df = spark.createDataFrame([(1, -1.0), (2, -2.0), (3, NAN), (4, None), (5, 0.0)], "i int, x double")
    log = col(run(["i"] + (["x"] >> ops.LogOp()), df), "x", "i")
    assert log[0] == -math.inf and math.isnan(log[1]) and math.isnan(log[2]) and log[3] is None and log[4] == 0
    clipped = col(run(["i"] + (["x"] >> ops.Clip(-1, 1)), df), "x", "i")
    assert clipped[1] == -1 and math.isnan(clipped[2]) and clipped[3] is None
    with pytest.raises(ValueError):
        ops.Clip()


@pytest.mark.parametrize(("bounds", "want"), [([0, 10], [0, 1, 2, 2, 2]), ([10, 0], [2, 1, 0, 0, 0])])
def test_bucketize(spark, bounds, want):
    df = spark.createDataFrame([(1, -1.0), (2, 5.0), (3, 10.0), (4, NAN), (5, None)], "i int, x double")
    assert col(run(["i"] + (["x"] >> ops.Bucketize(bounds)), df), "x", "i") == want


@pytest.mark.parametrize(("args", "want"), [((2,), [[1, 2], [4], []]), ((-2,), [[2, 3], [4], []]), ((1, 3), [[2, 3], [], []]), ((-3, -1), [[1, 2], [], []])])
def test_list_slice(spark, args, want):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, [])], "i int, x array<int>")
    assert col(run(["i"] + (["x"] >> ops.ListSlice(*args)), df), "x", "i") == want


def test_list_slice_pads(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, None)], "i int, x array<int>")
    assert col(run(["i"] + (["x"] >> ops.ListSlice(2, pad=True)), df), "x", "i") == [[1, 2], [4, 0], None]


def test_normalize_constant_lists_and_missing(spark):
    df = spark.createDataFrame([(1, 10.0, [1.0, 3.0], NAN), (2, 10.0, [], None)], "i int, a double, l array<double>, n double")
    out = run(["i"] + (["a", "l", "n"] >> ops.Normalize()), df)
    assert col(out, "a", "i") == [0.0, 0.0]
    assert [round(x, 4) for x in col(out, "l", "i")[0]] == [-0.7071, 0.7071] and col(out, "l", "i")[1] == []
    low = run(["i"] + (["a"] >> ops.NormalizeMinMax()), df)
    assert col(low, "a", "i") == [0.5, 0.5]


def baskets(spark):
    return spark.createDataFrame([(1, ["pear", "plum", "pear"]), (2, ["fig"]), (3, ["plum", "pear"]), (4, []), (5, None), (6, ["fig", None, "kiwi"])], "i int, fruit array<string>")


#: pear 3 times, fig and plum twice, kiwi once
ENCODED = [[3, 5, 3], [4], [5, 3], [], None, [4, 1, 6]]


def test_categorify_lists(spark):
    assert col(run(["i"] + (["fruit"] >> ops.Categorify()), baskets(spark)), "fruit", "i") == ENCODED
    freq = run(["i"] + (["fruit"] >> ops.Categorify(freq_threshold=3)), baskets(spark))
    assert col(freq, "fruit", "i") == [[3, 2, 3], [2], [2, 3], [], None, [2, 1, 2]]


def test_categorify_joint_and_combo(spark):
    df = spark.createDataFrame([(1, "oslo", "rome"), (2, "rome", "oslo"), (3, "rome", "lima"), (4, "oslo", "rome"), (5, None, "lima")], "i int, home string, away string")
    joint = run(["i"] + ([["home", "away"]] >> ops.Categorify()), df)
    # rome 4 times, oslo 3 times, lima twice
    assert col(joint, "home", "i") == [4, 3, 3, 4, 1] and col(joint, "away", "i") == [3, 4, 5, 3, 5]
    combo = run(["i"] + ([["home", "away"]] >> ops.Categorify(encode_type="combo")), df)
    # (oslo, rome) twice, then by home, null first, and away
    assert col(combo, "home_away", "i") == [3, 6, 5, 3, 4]


def test_categorify_of_several_types_and_options_in_one_node(spark):
    df = spark.createDataFrame([(1, "a", 7, 1.5, ["a"]), (2, "a", 7, NAN, ["b", "b"]), (3, "b", 9, None, None), (4, None, None, 1.5, [])], "i int, s string, n bigint, x double, l array<string>")
    out = run(["i"] + (["s", "n", "x", "l"] >> ops.Categorify(freq_threshold={"s": 2, "n": 1}, num_buckets={"n": 3})), df)
    assert col(out, "s", "i") == [3, 3, 2, 1] and col(out, "n", "i") == [5, 5, 6, 1] and col(out, "x", "i") == [3, 1, 1, 3]
    assert col(out, "l", "i") == [[4], [3, 3], None, []]
    few = run(["i"] + (["s", "n"] >> ops.Categorify(max_size={"n": 4})), df)
    assert col(few, "s", "i") == [3, 3, 4, 1] and col(few, "n", "i") == [3, 3, 2, 1]
    none = run(["s"] >> ops.Categorify(), df.where("s is null"))
    assert col(none, "s") == [1]


def test_lookups_are_broadcast_by_their_bytes(spark):
    from tessera.operators.base import Room
    from tessera.operators.rel import lookup, measured

    table = spark.createDataFrame([("x" * 1000, i) for i in range(50)], "k0 string, label long")
    rows, size = measured(table)
    assert rows == 50 and 50_000 < size < 60_000
    room = Room(100_000)
    hinted = lambda t: "broadcast" in t._jdf.queryExecution().logical().toString().lower()
    assert hinted(lookup(table, size, room)) and not hinted(lookup(table, size, room)) and not hinted(lookup(table, None, room))


def test_groupby_with_its_defaults(spark):
    df = spark.createDataFrame([("k", 2, "a.b"), ("k", 1, None), ("m", 3, "c")], "g string, x int, `y.z` string").coalesce(1)
    out = {r.g: r for r in run(["g", "x", "y.z"] >> ops.Groupby("g"), df).collect()}
    assert out["k"]["x_list"] == [2, 1] and out["k"]["y.z_list"] == ["a.b", None] and out["m"]["x_list"] == [3]
    ends = run(["g", "x"] >> ops.Groupby("g", aggs=["first", "last"]), df).where("g = 'k'").first()
    assert (ends.x_first, ends.x_last) == (2, 1)
    assert sorted(col(run(["g"] >> ops.Groupby("g"), df), "g")) == ["k", "m"]


def test_hashes_of_null_and_of_equal_text(spark):
    df = spark.createDataFrame([(1, 1, "1"), (2, None, "x"), (3, 5, None)], "i int, a int, b string")
    cross = col(run(["i"] + ([["a", "b"]] >> ops.HashedCross(9)), df), "a_X_b", "i")
    assert cross[0] is not None and cross[1:] == [None, None]
    one = run(["i"] + (["a", "b"] >> ops.HashBucket(1000)), df).where("i = 1").first()
    assert one.a == one.b


def test_renaming_two_columns_to_one_name_is_an_error(spark):
    with pytest.raises(ValueError, match="same name"):
        run(["a", "b"] >> ops.Rename(f=lambda n: "c"), spark.createDataFrame([(1, 2)], "a int, b int"))


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "u", 1.0), (2, "v", 3.0), (3, "u", 5.0)], "`i.d` int, `c.at` string, `x.y` double")
    node = ["i.d"] + (["c.at"] >> ops.Categorify()) + (["c.at"] >> ops.JoinGroupby(cont_cols=["x.y"], stats=["sum"])) + (["x.y"] >> ops.Normalize()) + (["c.at"] >> ops.TargetEncoding("x.y", kfold=1))
    out = run(node, df).orderBy("`i.d`").collect()
    assert [r["c.at"] for r in out] == [3, 4, 3] and [r["c.at_x.y_sum"] for r in out] == [6.0, 3.0, 6.0]
    kept = run(["i.d", "x.y"] >> ops.Dropna(), df)
    assert kept.columns == ["i.d", "x.y"] and kept.count() == 3


def test_categorify_null_unseen_and_sizes(spark):
    fit = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    op = ops.Categorify()
    w = Workflow(["c"] >> op).fit(fit)
    seen = w.transform(spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "c string"))
    assert sorted(col(seen, "c")) == [1, 2, 3, 4]
    assert {r.kind: r.num_observed for r in op.meta(spark, "c").collect()} == {"pad": 0, "null": 1, "oov": 0, "unique": 3}
    assert get_embedding_sizes(w) == {"c": (5, 16)}
    for bad in ({"encode_type": "x"}, {"freq_threshold": 1, "max_size": 5}, {"num_buckets": 0}, {"start_index": 1}):
        with pytest.raises(ValueError):
            ops.Categorify(**bad)


def test_distributed_positions_match_the_window(spark, monkeypatch):
    from tessera.operators import cat

    df = spark.range(200).select((F.col("id") % 37).alias("c"))
    one = sorted(col(run(["c"] >> ops.Categorify(), df), "c"))
    monkeypatch.setattr(cat, "WINDOW_ROWS", 1)
    assert sorted(col(run(["c"] >> ops.Categorify(), df), "c")) == one


def test_list_join_path_matches_the_map(spark, monkeypatch):
    from tessera.operators import cat

    monkeypatch.setattr(cat, "MAP_ROWS", 0)
    assert col(run(["i"] + (["fruit"] >> ops.Categorify()), baskets(spark)), "fruit", "i") == ENCODED


def test_groupby_order_nulls_and_dtypes(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, 5), ("k", 3, 7), (None, 1, 1)], "g string, t int, x int")
    out = run(["g", "x"] >> ops.Groupby("g", sort_cols="t", aggs=["list", "first", "last", "sum", "count"]), df)
    row = out.collect()
    assert len(row) == 1 and row[0].x_list == [5, None, 7] and (row[0].x_first, row[0].x_last) == (5, 7)
    assert dict(out.dtypes)["x_sum"] == "float" and row[0].x_count == 2
    assert run(["g", "x"] >> ops.Groupby("g", sort_cols="t", ascending=False), df).first().x_list == [7, None, 5]


def test_join_groupby_and_target_encoding(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0)], "i int, g string, x double")
    out = run(["i"] + (["g"] >> ops.JoinGroupby(cont_cols=["x"], stats=["count", "sum"])), df)
    assert col(out, "g_count", "i") == [2, 2, 1] and col(out, "g_x_sum", "i") == [4.0, 4.0, 5.0]
    te = run(["i"] + (["g"] >> ops.TargetEncoding("x", kfold=1, p_smooth=1, out_dtype="double")), df)
    assert col(te, "TE_g_x", "i") == [pytest.approx(7 / 3), pytest.approx(7 / 3), 4.0]
    single = df.withColumn("g", F.lit("one"))
    assert set(col(run(["g"] >> ops.TargetEncoding("x", kfold=1), single), "TE_g_x")) == {3.0}


def test_join_external_matches_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    ext = spark.createDataFrame([(1, "x"), (1, "x"), (None, "n")], "k int, v string")
    assert sorted(col(run(["k"] >> ops.JoinExternal(ext, "k", drop_duplicates_ext=True), left), "v")) == ["n", "x"]
    assert run(["k"] >> ops.JoinExternal(ext, "k"), left).count() == 3


def test_difference_lag(spark):
    df = spark.createDataFrame([(1, 1000), (1, 1005), (1, 1100), (2, 2000), (2, 2001), (3, 1)], "userid int, timestamp int")
    out = run(["userid", "timestamp"] + (["timestamp"] >> ops.DifferenceLag("userid", [1, -1], order_by="timestamp")), df)
    got = {(r.userid, r.timestamp): (r["timestamp_difference_lag_1"], r["timestamp_difference_lag_-1"]) for r in out.collect()}
    assert got[(1, 1005)] == (5.0, -95.0) and got[(1, 1100)] == (95.0, None) and got[(2, 2000)] == (None, -1.0) and got[(3, 1)] == (None, None)


@pytest.mark.parametrize(("metric", "same"), [("inner", 3.0), ("cosine", 1.0), ("tfidf", 1.0)])
def test_column_similarity(spark, metric, same):
    features = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0)], "r long, c long, v double")
    df = spark.createDataFrame([(0, 0), (0, 1)], "a long, b long")
    out = run(["b"] + ([["a", "b"]] >> ops.ColumnSimilarity(features, metric=metric)), df)
    assert col(out, "a_b_sim", "b") == [pytest.approx(same), 0.0]


def test_reduce_drop_and_rename(spark):
    df = spark.createDataFrame([(1, 40_000, 1.5, "x", "a"), (2, 1, 2.5, "x", "b")], "i long, m long, f double, one string, two string")
    assert dict(run(["i", "m", "f"] >> ops.ReduceDtypeSize(), df).dtypes) == {"i": "tinyint", "m": "int", "f": "float"}
    assert run((["one", "two"] >> ops.Categorify()) >> ops.DropLowCardinality(), df).columns == ["two"]
    assert run(["i", "m"] >> ops.Rename(f=str.upper), df).columns == ["I", "M"]
    with pytest.raises(RuntimeError):
        run(["i", "m"] >> ops.Rename(name="z"), df)


def test_filter_dropna_lambda(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, NAN)], "i int, x double")
    assert run(["i", "x"] >> ops.Dropna(), df).count() == 1
    assert run(["i"] >> ops.Filter(lambda d: d["i"] > 1), df).count() == 2
    with pytest.raises(ValueError):
        run(["i"] >> ops.Filter(lambda d: 5), df)
    assert sorted(col(run(ColumnSelector(["i"]) >> (lambda c: c + 100), df), "i")) == [101, 102, 103]
    two = run(["i"] >> ops.LambdaOp(lambda c, d: c + d["x"], dependency=["x"]), df.where("x = 1"))
    assert col(two, "i") == [2.0]


def test_algebra_tags_and_lineage(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    node = (["a", "b"] >> ops.AddTags([Tags.USER])) + "c"
    assert run(node - ["b"], df).columns == ["a", "c"] and run(node["b"], df).columns == ["b"]
    assert run((ColumnSelector(["a"]) + ["b"]) - "zz", df).columns == ["a", "b"]
    w = Workflow((["a"] >> ops.Rename(postfix="_x")) + ["b"]).fit(df)
    assert w.column_mapping == {"a_x": ["a"], "b": ["b"]}
    tagged = Schema([ColumnSchema("a", "int", ("user",)), ColumnSchema("b", "int")])
    assert Workflow(ColumnSelector(tags=["user"]) >> ops.Operator()).fit_schema(tagged).output_schema.column_names == ["a"]
    with pytest.raises(ValueError):
        ColumnSelector([["a", ["b"]]])
    with pytest.raises(ValueError, match="row sets"):
        run((["a"] >> ops.Dropna()) + ["b"], df)
    assert "digraph" in node.graph


def test_save_load_subgraph_remove(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0), (3, "a", None)], "i int, c string, x double")
    node = ["i"] + Subgraph("cats", ["c"] >> ops.Categorify()) + (["x"] >> ops.FillMissing() >> ops.Normalize())
    w = Workflow(node).fit(df)
    w.save(str(tmp_path / "a"))
    (tmp_path / "a").rename(tmp_path / "b")
    again = Workflow.load(str(tmp_path / "b"))
    assert again.transform(df).orderBy("i").collect() == w.transform(df).orderBy("i").collect()
    assert again.get_subworkflow("cats").transform(df).columns == ["c"]
    with pytest.raises(ValueError, match="No subgraph named"):
        w.get_subworkflow("nope")
    with pytest.raises(ValueError, match="importable"):
        Workflow(ColumnSelector(["i"]) >> (lambda c: c)).fit(df).save(str(tmp_path / "c"))
    assert w.remove_inputs(["x"]).transform(df.drop("x")).columns == ["i", "c"]
    w.clear_stats()
    with pytest.raises(ValueError):
        w.transform(df)


def test_metadata_survives_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3])], "i int, l array<int>")
    op = ops.ValueCount()
    Workflow((["i"] >> ops.TagAsItemID()) + (["l"] >> op)).fit_transform(Dataset(df)).to_parquet(str(tmp_path / "p"), output_files=2)
    schema = Dataset(str(tmp_path / "p")).schema
    assert schema["i"].tags == ("id", "item") and schema["l"].properties["value_count"] == {"min": 1, "max": 2}


def test_hashes_are_in_range_and_repeat(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "p string, q string")
    node = (["p"] >> ops.HashBucket(7)) + ([["p", "q"]] >> ops.HashedCross(5))
    rows = run(node, df).collect()
    assert rows == run(node, df).collect()
    assert all(r.p is None or 0 <= r.p < 7 for r in rows) and "p_X_q" in rows[0]


def test_stream_of_a_fitted_workflow(spark, tmp_path):
    from tessera.streaming import write_stream

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    df.write.parquet(str(tmp_path / "in"))
    w = Workflow((["c"] >> ops.Categorify()) + (["x"] >> ops.Normalize())).fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_stream(w, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
