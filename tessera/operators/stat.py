"""Operators fitted by plain aggregates; the compiler fuses those of one depth into one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ColumnSchema, Schema, Tags
from .base import Cols, Entries, StatOperator, col, elementwise, flat, missing, numeric, present
from .row import FillMissing


def _leaf(dtype: str | None) -> str | None:
    return dtype[6:-1] if dtype and dtype.startswith("array<") else dtype


def _over(c: Column, dtype: str | None, parts: dict[str, str]) -> list[Column]:
    """Sums over values, or over the leaves of lists without exploding them."""
    if not (dtype and dtype.startswith("array<")):
        x = present(c, dtype).cast("double")
        return [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), F.count(x)]
    leaf = dtype[6:-1]
    v = F.filter(F.transform(c, lambda x: present(x, leaf).cast("double")), lambda x: x.isNotNull())
    n, total = F.sum(F.size(v)), F.sum(F.aggregate(v, F.lit(0.0), lambda s, x: s + x))
    squares = F.sum(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    var = F.when(n > 1, F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))
    return [F.when(n > 0, total / n), F.sqrt(var), F.min(F.array_min(v)), F.max(F.array_max(v)), n]


class _Scaling(StatOperator):
    output_tags = (Tags.CONTINUOUS,)

    def __init__(self, out_dtype: str | None = None) -> None:
        self.out_dtype = out_dtype
        self.output_dtype = out_dtype or "double"
        self.stats: dict[str, list] = {}

    def fit_aggs(self, entries: Entries, cols: Cols, schema: Schema) -> list[Column]:
        self._names = flat(entries)
        return [a for n in self._names for a in _over(cols[n], schema[n].dtype, {})]

    def fit_finalize(self, values: list) -> None:
        self.stats = {n: [None if v is None else float(v) for v in values[5 * i : 5 * i + 4]] for i, n in enumerate(self._names)}
        self.fitted = True

    def scaled(self, c: Column, name: str) -> Column:
        raise NotImplementedError

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        self.need_fit()
        return {n: elementwise(cols[n], schema[n].dtype, lambda c, _, n=n: self.scaled(c.cast("double"), n).cast(self.output_dtype)) for n in flat(entries)}

    def clear(self) -> None:
        self.stats, self.fitted = {}, False

    def state(self) -> dict:
        return {"stats": self.stats}

    def load_state(self, state: dict) -> None:
        self.stats = state["stats"]


class Normalize(_Scaling):
    """(x - mean) / std; only centred where the deviation is 0 or unknown."""

    def scaled(self, c: Column, name: str) -> Column:
        mean, std = self.stats[name][:2]
        if mean is None:
            return c
        return (c - mean) / std if std and not math.isnan(std) else c - mean

    @property
    def means(self) -> dict[str, float]:
        return {n: s[0] for n, s in self.stats.items()}

    @property
    def stds(self) -> dict[str, float]:
        return {n: s[1] or 0.0 for n, s in self.stats.items()}


class NormalizeMinMax(_Scaling):
    """(x - min) / (max - min); a constant column is 0.5, or null at 0; an empty one is null."""

    def scaled(self, c: Column, name: str) -> Column:
        low, high = self.stats[name][2:4]
        if low is None:
            return F.lit(None).cast("double")
        return (c - low) / (high - low) if high > low else F.when(c != 0, F.lit(0.5))

    @property
    def mins(self) -> dict[str, float]:
        return {n: s[2] for n, s in self.stats.items()}

    @property
    def maxs(self) -> dict[str, float]:
        return {n: s[3] for n, s in self.stats.items()}


def medians(df: DataFrame, values: dict[str, Column], accuracy: int = 100_000) -> dict[str, float | None]:
    """The exact median of each column, in bounded memory.

    One pass brackets it between two quantiles within the sketch's error; where
    they differ, a second one counts what lies between: a few values in 100,000.
    """
    names = list(values)
    step = 2 / accuracy
    ends = F.array(F.lit(0.5 - step), F.lit(0.5 + step))
    got = df.agg(*[a.alias(f"{k}{i}") for i, n in enumerate(names) for k, a in (("n", F.count(values[n])), ("q", F.percentile_approx(values[n], ends, accuracy)))]).first()
    out = {n: got[f"q{i}"][0] if got[f"n{i}"] else None for i, n in enumerate(names)}
    wide = [i for i, n in enumerate(names) if got[f"n{i}"] and got[f"q{i}"][0] != got[f"q{i}"][1]]
    if not wide:
        return out
    below = df.agg(*[F.count_if(values[names[i]] < got[f"q{i}"][0]).alias(f"b{i}") for i in wide]).first()
    between = lambda i: F.when(values[names[i]].between(*got[f"q{i}"]), F.struct(F.lit(i).alias("i"), values[names[i]].alias("x")))
    inside = df.select(F.explode(F.array_compact(F.array(*[between(i) for i in wide]))).alias("v")).groupBy("v.i", "v.x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("x"))
    first = F.element_at(F.create_map(*[y for i in wide for y in (F.lit(i), F.lit(below[f"b{i}"]))]), F.col("i"))
    n = F.element_at(F.create_map(*[y for i in wide for y in (F.lit(i), F.lit(got[f"n{i}"]))]), F.col("i"))
    ranked = inside.withColumn("upto", upto + first).withColumn("n", n)
    holds = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    low, high = holds(F.floor((F.col("n") - 1) / 2)), holds(F.ceil((F.col("n") - 1) / 2))
    return out | {names[r.i]: r.m for r in ranked.groupBy("i").agg(((low + high) / 2).alias("m")).collect()}


class FillMedian(FillMissing, StatOperator):
    """The median for null and NaN: exact, or approximate with accuracy; both in bounded memory."""

    stat = True
    fitted = False

    def __init__(self, add_binary_cols: bool = False, accuracy: int | None = None) -> None:
        self.add_binary_cols, self.accuracy = add_binary_cols, accuracy
        self.medians: dict[str, float] = {}

    def fit(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema) -> None:
        x = {n: present(cols[n], schema[n].dtype).cast("double") for n in flat(entries)}
        if self.accuracy:
            got = df.agg(*[F.percentile_approx(c, 0.5, self.accuracy).alias(f"a{i}") for i, c in enumerate(x.values())]).first()
            self.medians = dict(zip(x, got, strict=True))
        else:
            self.medians = medians(df, x)
        self.fitted = True

    def value(self, name: str) -> object:
        self.need_fit()
        return self.medians[name]

    def clear(self) -> None:
        self.medians, self.fitted = {}, False

    def state(self) -> dict:
        return {"medians": self.medians}

    def load_state(self, state: dict) -> None:
        self.medians = state["medians"]


class ReduceDtypeSize(StatOperator):
    """The narrowest integer type that holds a column; floats become float_dtype.

    A later value out of range fails the cast, it does not wrap.
    """

    def __init__(self, float_dtype: str = "float") -> None:
        self.float_dtype = float_dtype
        self.dtypes: dict[str, str] = {}

    def fit_aggs(self, entries: Entries, cols: Cols, schema: Schema) -> list[Column]:
        self._names = flat(entries)
        self._kinds = {n: schema[n].dtype for n in self._names}
        self._ints = [n for n in self._names if self._kinds[n] in ("tinyint", "smallint", "int", "bigint")]
        return [f(cols[n]) for n in self._ints for f in (F.min, F.max)]

    def fit_finalize(self, values: list) -> None:
        for n in self._names:
            if n in self._ints:
                i = 2 * self._ints.index(n)
                low, high = values[i], values[i + 1]
                fits = [t for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if low is not None and -(1 << b) <= low and high < 1 << b]
                self.dtypes[n] = fits[0] if fits else self._kinds[n]
            else:
                self.dtypes[n] = self.float_dtype if self._kinds[n] in ("float", "double") else self._kinds[n]
        self.fitted = True

    def column_dtype(self, name: str, source: ColumnSchema) -> str | None:
        return self.dtypes.get(name, source.dtype)

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        self.need_fit()
        return {n: cols[n].cast(self.dtypes[n]) for n in flat(entries)}

    def clear(self) -> None:
        self.dtypes, self.fitted = {}, False

    def state(self) -> dict:
        return {"dtypes": self.dtypes}

    def load_state(self, state: dict) -> None:
        self.dtypes = state["dtypes"]


def profile_aggs(c: Column, dtype: str | None) -> list[Column]:
    """min, max, mean, std, non-missing and rows of a column; of text its length."""
    leaf = _leaf(dtype)
    if leaf == "string" and dtype == "string":
        x, whole = F.length(c).cast("double"), c
    elif dtype and dtype.startswith("array<"):
        return [*_over(c, dtype, {})[2:4], *_over(c, dtype, {})[:2], F.count(c), F.count(F.lit(1))]
    elif numeric(dtype) or dtype == "boolean":
        x, whole = present(c, dtype).cast("double"), present(c, dtype)
    else:
        x, whole = F.unix_timestamp(c.cast("timestamp")).cast("double") if dtype in ("timestamp", "timestamp_ntz", "date") else F.lit(None).cast("double"), c
    return [F.min(x), F.max(x), F.avg(x), F.stddev_samp(x), F.count(whole), F.count(F.lit(1))]


def distinct_counts(df: DataFrame, cols: Cols, kinds: dict[str, str | None]) -> dict[str, int]:
    """How many values each column has, floats left out, and the leaves of each list; one pass, one shuffle of the distinct (column, value)."""
    names = [n for n in cols if kinds[n] not in ("float", "double")]
    cells = []
    for i, n in enumerate(names):
        if (kinds[n] or "").startswith("array<"):
            cells.append(_text_cells(i, cols[n]))
        else:
            cells.append(F.array(_text_cell(i, cols[n])))
    if not cells:
        return {}
    every = F.flatten(F.filter(F.array(*cells), lambda x: x.isNotNull()))
    found = df.select(F.explode(every).alias("v")).select("v.i", "v.x").where("x is not null").distinct().groupBy("i").count()
    got = {r["i"]: r["count"] for r in found.collect()}
    return {n: got.get(i, 0) for i, n in enumerate(names)}


def _text_cell(i: int, value: Column) -> Column:
    return F.struct(F.lit(i).alias("i"), value.cast("string").alias("x"))


def _text_cells(i: int, values: Column) -> Column:
    return F.transform(values, lambda x: _text_cell(i, x))


class DataStats(StatOperator):
    """A profile of each column, in ``output``; rows pass as they are."""

    def __init__(self) -> None:
        self.output: dict[str, dict] = {}

    def fit(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema) -> None:
        names, kinds = flat(entries), {n: schema[n].dtype for n in flat(entries)}
        aggs = [a for n in names for a in profile_aggs(cols[n], kinds[n])]
        values = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()) if aggs else []
        distinct = distinct_counts(df, {n: cols[n] for n in names if not schema[n].is_list}, kinds)
        for i, n in enumerate(names):
            low, high, mean, std, held, rows = values[6 * i : 6 * i + 6]
            self.output[n] = {"dtype": kinds[n], "min": low, "max": high, "mean": mean, "std": std, "per_nan": 100 * (1 - held / rows) if rows else 0.0}
            if n in distinct:
                self.output[n]["cardinality"] = distinct[n]
        self.fitted = True

    def clear(self) -> None:
        self.output, self.fitted = {}, False

    def state(self) -> dict:
        return {"output": self.output}

    def load_state(self, state: dict) -> None:
        self.output = state["output"]


def moments(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per column: count, mean, var and std (n - 1), missing values left out."""
    kinds = dict(df.dtypes)
    row = [F.struct(F.lit(n).alias("column"), *[a.alias(k) for a, k in zip(_over(col(n), kinds[n], {}), ("mean", "std", "min", "max", "count"), strict=True)]) for n in names]
    one = df.agg(*[x.alias(f"c{i}") for i, x in enumerate(row)])
    each = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(row))])).alias("m"))
    return each.select("m.column", F.col("m.count").cast("bigint").alias("count"), "m.mean", (F.col("m.std") * F.col("m.std")).alias("var"), "m.std")


__all__ = ["DataStats", "FillMedian", "distinct_counts", "Normalize", "NormalizeMinMax", "ReduceDtypeSize", "missing", "moments", "profile_aggs"]
