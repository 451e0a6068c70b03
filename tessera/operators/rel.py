"""Operators that change the rows, or look to other rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ColumnSchema, Schema, Tags
from .base import Cols, Entries, Operator, Room, col, flat, from_path, missing, present, to_path

def row_bytes(table: DataFrame) -> Column:
    """About what a row takes in a lookup: text by its length, other values at 16 bytes."""
    total = F.lit(32).cast("long")
    for f in table.schema.fields:
        kind, c = f.dataType.simpleString(), col(f.name)
        total = total + (F.coalesce(F.octet_length(c), F.lit(0)) + 24 if kind in ("string", "binary") else F.coalesce(F.size(c), F.lit(0)) * 64 if kind.startswith(("array", "map")) else F.lit(16))
    return total


def measured(table: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a lookup table, as counted."""
    n, size = table.agg(F.count("*"), F.sum(row_bytes(table))).first()
    return n, size or 0


#: Most bytes of a lookup that one task may hold as a hash table.
PART_BYTES = 64 << 20
#: Up to so many bytes Spark may broadcast a lookup by itself, which shuffles no rows.
SMALL_BYTES = 16 << 20


def lookup(table: DataFrame, size: int | None, room: Room | None) -> DataFrame:
    """Hints a broadcast only where the bytes are known and fit what is left for the row set.

    Else a shuffled hash join: a task holds its part of the lookup, and neither
    sorts nor spills the rows.  Spark chooses where that part would be large.
    """
    if (room or Room()).fits(size):
        return F.broadcast(table)
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.hint("shuffle_hash") if size is not None and SMALL_BYTES < size <= parts * PART_BYTES else table


class Filter(Operator):
    """Rows where f(df) is true; f may also return the filtered DataFrame."""

    changes_rows = True

    def __init__(self, f: Callable) -> None:
        if f is None:
            raise ValueError("f is needed")
        self.f = from_path(f) if isinstance(f, str) and ":" in f else f

    def relate(self, df: DataFrame, entries: Entries, schema: Schema) -> DataFrame:
        got = F.expr(self.f) if isinstance(self.f, str) else self.f(df)
        if isinstance(got, DataFrame):
            return got
        if not isinstance(got, Column):
            raise ValueError("f must return a Column or a DataFrame")
        return df.where(got)

    def params(self) -> dict:
        return {"f": self.f if isinstance(self.f, str) else to_path(self.f)}


class Dropna(Operator):
    """Rows in which all selected columns hold a value (neither null nor NaN)."""

    changes_rows = True

    def relate(self, df: DataFrame, entries: Entries, schema: Schema) -> DataFrame:
        names = flat(entries) or df.columns
        kinds = dict(df.dtypes)
        keep = F.lit(True)
        for n in names:
            keep = keep & ~missing(col(n), kinds[n])
        return df.where(keep)


class JoinExternal(Operator):
    """An equi-join with an outside table, left or inner; null keys meet null keys."""

    changes_rows = True

    def __init__(self, df_ext: object, on: str | list[str], how: str = "left", on_ext: str | list[str] | None = None, columns_ext: list[str] | None = None, drop_duplicates_ext: bool = False, kind_ext: object = None, cache: str = "host") -> None:
        if how not in ("left", "inner"):
            raise ValueError("how must be left or inner")
        self.df_ext = getattr(df_ext, "df", df_ext)
        self.on = [on] if isinstance(on, str) else list(on)
        self.on_ext = self.on if on_ext is None else [on_ext] if isinstance(on_ext, str) else list(on_ext)
        if len(self.on) != len(self.on_ext):
            raise ValueError("on and on_ext differ in length")
        self.how, self.columns_ext, self.drop_duplicates_ext = how, columns_ext, drop_duplicates_ext

    @property
    def dependencies(self) -> list:
        return []

    def _ext(self) -> DataFrame:
        ext = self.df_ext
        if not isinstance(ext, DataFrame):
            from pyspark.sql import SparkSession

            ext = SparkSession.active().createDataFrame(ext)
        if self.columns_ext:
            ext = ext.select(*[col(c) for c in dict.fromkeys([*self.on_ext, *self.columns_ext])])
        return ext.dropDuplicates() if self.drop_duplicates_ext else ext

    def relate(self, df: DataFrame, entries: Entries, schema: Schema) -> DataFrame:
        ext = self._ext()
        same = {e for o, e in zip(self.on, self.on_ext, strict=True) if o == e}
        clash = set(df.columns) & set(ext.columns) - same
        if clash:
            raise ValueError(f"columns of both tables: {sorted(clash)}; choose with columns_ext")
        right = ext.select(*[col(c).alias(f"__ext_{c}") for c in ext.columns])
        on = F.lit(True)
        for o, e in zip(self.on, self.on_ext, strict=True):
            on = on & col(o).eqNullSafe(col(f"__ext_{e}"))
        joined = df.join(right, on, self.how)  # adaptive execution broadcasts a side that turns out small
        return joined.select(*[col(c) for c in df.columns], *[col(f"__ext_{c}").alias(c) for c in ext.columns if c not in same])

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        ext = Schema.of(self._ext().schema)
        left = schema.select(n for n in flat(entries) if n in schema)
        return left + ext.excluding(left.column_names)

    def params(self) -> dict:
        return {"on": self.on, "how": self.how, "on_ext": self.on_ext, "columns_ext": self.columns_ext, "drop_duplicates_ext": self.drop_duplicates_ext, "df_ext": None}

    def tables(self) -> dict[str, DataFrame]:
        return {"ext": self.df_ext if isinstance(self.df_ext, DataFrame) else self._ext()}

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        self.df_ext = tables["ext"]


class DifferenceLag(Operator):
    """x minus its value ``shift`` rows before (after, if negative) within a partition, in the order of order_by.

    A null partition key equals none, so its rows have no neighbour.
    """

    output_tags = (Tags.CONTINUOUS,)
    output_dtype = "float"

    def __init__(self, partition_cols: str | list[str], shift: int | list[int] = 1, order_by: str | list[str] | None = None) -> None:
        self.partition_cols = [partition_cols] if isinstance(partition_cols, str) else list(partition_cols)
        self.shift = list(shift) if isinstance(shift, (list, tuple)) else [shift]
        self.order_by = [order_by] if isinstance(order_by, str) else order_by

    @property
    def dependencies(self) -> list:
        return [[*self.partition_cols, *(self.order_by or [])]]

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        return {f"{n}_difference_lag_{k}": [n] for k in self.shift for n in flat(entries)}

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        order = [cols[c] for c in self.order_by] if self.order_by else [F.monotonically_increasing_id()]
        w = Window.partitionBy(*[cols[c] for c in self.partition_cols]).orderBy(*order)
        known = F.lit(True)
        for c in self.partition_cols:
            known = known & cols[c].isNotNull()
        out = {}
        for k in self.shift:
            for n in flat(entries):
                x = cols[n]
                if schema[n].dtype in ("timestamp", "timestamp_ntz", "date"):
                    x = F.unix_micros(x.cast("timestamp")).cast("double") / 1e6
                out[f"{n}_difference_lag_{k}"] = F.when(known, x - F.lag(x, k).over(w)).cast("float")
        return out


class ColumnSimilarity(Operator):
    """The similarity of the feature rows that two id columns name.

    Features are a DataFrame (row, col, value).  inner is the plain product;
    cosine normalises rows; tfidf weighs columns by ln(rows / entries) first.
    An id without features has similarity 0; a null id has none.
    """

    output_tags = (Tags.CONTINUOUS,)
    output_dtype = "double"

    def __init__(self, left_features: DataFrame, right_features: DataFrame | None = None, metric: str = "tfidf", on_device: bool = True) -> None:
        if metric not in ("tfidf", "cosine", "inner"):
            raise ValueError(f"unknown metric: {metric}")
        self.left_features, self.right_features, self.metric = left_features, right_features, metric

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        pairs = [e for e in entries if not isinstance(e, str)] or [tuple(flat(entries))]
        return {f"{a}_{b}_sim": [a, b] for a, b in pairs}

    def weighted(self, features: DataFrame) -> DataFrame:
        """row, col and value of all entries, weighted; cosine and tfidf divide by the row's length."""
        f = features.select(*[col(c).cast(t).alias(n) for c, t, n in zip(features.columns, ("long", "long", "double"), ("row", "col", "value"), strict=False)])
        if self.metric == "tfidf":
            n = f.agg((F.max("row") + 1).cast("double").alias("n"))
            df_ = f.groupBy(F.col("col").alias("c")).agg(F.count("*").alias("d")).crossJoin(F.broadcast(n))  # n is one row
            f = f.join(df_, F.col("col") == F.col("c")).select("row", "col", (F.col("value") * F.log(F.col("n") / F.col("d"))).alias("value"))
        if self.metric == "inner":
            return f
        norms = f.groupBy(F.col("row").alias("r")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).where("norm > 0")
        return f.join(norms, F.col("row") == F.col("r")).select("row", "col", (F.col("value") / F.col("norm")).alias("value"))

    def extend(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema, fitting: bool = False) -> tuple[DataFrame, Cols]:
        """Each distinct pair of ids once: its left row's entries meet the right row's on (row, column) and are summed."""
        out = {}
        left = self.weighted(self.left_features)
        right = self.weighted(self.right_features) if self.right_features is not None else left
        right = right.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("value").alias("value2"))
        for i, (name, (a, b)) in enumerate(self.column_mapping(entries).items()):
            tag = f"__sim{id(self)}_{i}"
            x, y = cols[a].cast("long"), cols[b].cast("long")
            pairs = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null").distinct()
            met = pairs.join(left, F.col("x") == F.col("row")).join(right, (F.col("y") == F.col("row2")) & (F.col("col") == F.col("col2")))
            dots = met.groupBy(F.col("x").alias(f"{tag}x"), F.col("y").alias(f"{tag}y")).agg(F.sum(F.col("value") * F.col("value2")).alias(f"{tag}d"))
            df = df.join(dots, (x == F.col(f"{tag}x")) & (y == F.col(f"{tag}y")), "left")
            out[name] = F.when(x.isNotNull() & y.isNotNull(), F.coalesce(F.col(f"{tag}d"), F.lit(0.0)))
        return df, {n: c.cast("double") for n, c in out.items()}

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        return Schema(ColumnSchema(n, "double", ("continuous",)) for n in self.column_mapping(entries))

    def params(self) -> dict:
        return {"metric": self.metric, "left_features": None}

    def tables(self) -> dict[str, DataFrame]:
        return {"left": self.left_features} | ({"right": self.right_features} if self.right_features is not None else {})

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        self.left_features, self.right_features = tables["left"], tables.get("right")


__all__ = ["ColumnSimilarity", "DifferenceLag", "Dropna", "Filter", "JoinExternal", "lookup", "measured", "present"]
