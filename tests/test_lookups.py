"""Lookups that are too large to be broadcast."""

from pyspark.sql import functions as F

from tessera import Dataset, Workflow, ops
from tessera.operators import base, rel


def test_large_lookups_do_not_sort_the_rows(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 90).alias("k"), F.expr("if(id % 7 = 0, null, id % 11)").alias("j"), F.col("id").alias("y"))
    node = lambda: ["y"] + (["k", ["k", "j"]] >> ops.TargetEncoding("y", fold_seed=None, fold_key="y")) + (["k", "j"] >> ops.Categorify())
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    small = Workflow(node()).fit_transform(Dataset(df)).df
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(base.Room.__init__, "__defaults__", (0,))
    monkeypatch.setattr(rel, "SMALL_BYTES", 0)
    large = Workflow(node()).fit_transform(Dataset(df)).df
    assert plan(large).count("ShuffledHashJoin") == 4 and "SortMergeJoin" not in plan(large)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    monkeypatch.setattr(rel, "PART_BYTES", 1)
    assert "ShuffledHashJoin" not in plan(Workflow(node()).fit_transform(Dataset(df)).df)


def test_joins_carry_what_derived_columns_are_made_of(spark, monkeypatch):
    monkeypatch.setattr(base.Room.__init__, "__defaults__", (0,))
    monkeypatch.setattr(rel, "SMALL_BYTES", 0)
    stored = spark.range(3000).select("id", (F.col("id") % 7).alias("a"), F.expr("if(id % 5 = 0, null, id * 0.5)").alias("x"))
    made = {f"x{k}": f"x * {k}" for k in range(1, 6)} | {"c": "(a * 3 + id) % 50"}
    node = lambda: ["id"] + ([f"x{k}" for k in range(1, 6)] >> ops.FillMissing() >> ops.LogOp()) + (["c"] >> ops.Categorify())
    plain = Workflow(node()).fit_transform(Dataset(stored.select("*", *[F.expr(e).alias(n) for n, e in made.items()]))).df
    late = Workflow(node()).fit_transform(Dataset(stored, derived=made)).df
    assert late.schema == plain.schema and sorted(map(tuple, late.collect())) == sorted(map(tuple, plain.collect()))

    def carried(d):
        n = d._jdf.queryExecution().optimizedPlan()
        while n.nodeName() != "Join":
            n = n.children().head()
        return n.children().head().output().size()

    assert carried(late) < carried(plain) and carried(late) <= 4  # id twice, a and x; not x1 to x5 and c
