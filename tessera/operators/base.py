"""Operator bases.

An operator sees its inputs as named Spark columns and returns named Spark
columns; the compiler keeps all of a graph in one DataFrame.  There are three
ways to act, from cheapest on:

- ``columns`` gives expressions over the same rows;
- ``extend`` may also left-join lookup tables with unique keys to the rows;
- ``relate`` returns a DataFrame of other rows.
"""

from __future__ import annotations

import importlib
import inspect
import sys
from collections.abc import Callable
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ColumnSchema, Schema

Entries = list  # of names and of groups (tuples of names)
Cols = dict[str, Column]


class SerializationError(ValueError):
    """A callable that has no import path cannot be saved."""


def flat(entries: Entries) -> list[str]:
    return list(dict.fromkeys(n for e in entries for n in ([e] if isinstance(e, str) else e)))


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing(c: Column, dtype: str | None) -> Column:
    """Null, or NaN in a float column."""
    return c.isNull() | F.isnan(c) if dtype in ("float", "double") else c.isNull()


def present(c: Column, dtype: str | None) -> Column:
    """The value, NaN made null."""
    return F.nanvl(c, F.lit(None).cast(dtype)) if dtype in ("float", "double") else c


def elementwise(c: Column, dtype: str | None, f: Callable[[Column, str | None], Column]) -> Column:
    """f over a value, or over each element of a list."""
    if dtype and dtype.startswith("array<"):
        return F.transform(c, lambda x: f(x, dtype[6:-1]))
    return f(c, dtype)


class Room:
    """Bytes that all lookups of one row set may take in an executor's memory, together."""

    def __init__(self, left: int = 256 << 20) -> None:
        self.left = left

    def fits(self, size: int | None) -> bool:
        if size is None or size > self.left:
            return False
        self.left -= size
        return True


class Operator:
    """Identity; the base of all operators."""

    #: how many bytes of lookups may still be broadcast to the rows at hand; the compiler hands it on
    room: Room | None = None
    output_tags: tuple[str, ...] = ()
    output_dtype: str | None = None
    output_properties: dict = {}
    stat = False
    changes_rows = False

    def __rrshift__(self, left: object):
        from ..graph import as_node

        return as_node(left) >> self

    @property
    def label(self) -> str:
        return type(self).__name__

    @property
    def dependencies(self) -> list:
        return []

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        """Each output column's inputs."""
        return {n: [n] for n in flat(entries)}

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        out = []
        for name, sources in self.column_mapping(entries).items():
            base = schema[sources[0]] if sources and sources[0] in schema else ColumnSchema(name)
            col = base.with_name(name).with_tags(self.output_tags).with_properties(self.column_properties(name, base))
            out.append(col.with_dtype(self.column_dtype(name, base)))
        return Schema(out)

    def column_properties(self, name: str, source: ColumnSchema) -> dict:
        return self.output_properties

    def column_dtype(self, name: str, source: ColumnSchema) -> str | None:
        if self.output_dtype and source.is_list:
            return f"array<{self.output_dtype}>"
        return self.output_dtype or source.dtype

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        return {n: cols[n] for n in flat(entries)}

    def extend(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema, fitting: bool = False) -> tuple[DataFrame, Cols]:
        return df, self.columns(entries, cols, schema)

    # saving

    def params(self) -> dict[str, Any]:
        """The constructor's arguments, as they were kept under their own names."""
        names = list(inspect.signature(type(self).__init__).parameters)[1:]
        return {n: getattr(self, n) for n in names if hasattr(self, n) and n not in ("args", "kwargs")}

    def state(self) -> dict:
        return {}

    def load_state(self, state: dict) -> None:
        pass

    def tables(self) -> dict[str, DataFrame]:
        """Fitted tables, saved as Parquet."""
        return {}

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        pass


class StatOperator(Operator):
    """An operator that gathers statistics over all rows before it can transform.

    ``fit_aggs`` gives plain aggregates: the compiler computes those of all
    operators at one depth in a single job and hands back the row.  ``fit``
    runs jobs of its own.
    """

    stat = True
    fitted = False

    def fit_aggs(self, entries: Entries, cols: Cols, schema: Schema) -> list[Column] | None:
        return None

    def fit_finalize(self, values: list) -> None:
        pass

    def fit(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema) -> None:
        pass

    def clear(self) -> None:
        self.fitted = False

    def need_fit(self) -> None:
        if not self.fitted:
            raise RuntimeError(f"{self.label} must be fitted before it can transform")


def to_path(f: Callable) -> str:
    path = f"{getattr(f, '__module__', None)}:{getattr(f, '__qualname__', '<lambda>')}"
    if "<" in path or path.startswith(("__main__", "None")):
        raise SerializationError(f"a callable must be importable to be saved: {path}")
    return path


#: While a saved graph is loaded: packages whose callables it may name, besides modules that are imported already.
trusted: ContextVar[tuple[str, ...] | None] = ContextVar("trusted", default=None)


def from_path(path: str) -> Callable:
    module, _, name = path.partition(":")
    allowed = trusted.get()
    if allowed is not None and module not in sys.modules and not any(module == x or module.startswith(f"{x}.") for x in allowed):
        raise SerializationError(f"{path} is of a module that is neither imported nor trusted; name it in load(trusted=...)")
    out: Any = importlib.import_module(module)
    for part in name.split("."):
        out = getattr(out, part)
    return out


class LambdaOp(Operator):
    """A function of a column, f(col), or of a column and all of the node's columns, f(col, df).

    It works on Spark columns.  engine="pandas" runs it on pandas Series in
    Arrow batches, for which dtype must be given.
    """

    def __init__(self, f: Callable, dependency: object = None, label: str | None = None, dtype: str | None = None, tags: tuple = (), properties: dict | None = None, engine: str = "spark") -> None:
        if not callable(f):
            raise ValueError("f must be callable")
        if engine == "pandas" and dtype is None:
            raise ValueError("the pandas engine needs a dtype")
        self.f, self.dependency, self.dtype, self.tags, self.properties, self.engine = f, dependency, dtype, tags, properties, engine
        self._label = label
        self.output_tags, self.output_dtype, self.output_properties = tuple(tags), dtype, properties or {}

    @property
    def label(self) -> str:
        return self._label or getattr(self.f, "__name__", "LambdaOp")

    @property
    def dependencies(self) -> list:
        if self.dependency is None:
            return []
        return list(self.dependency) if isinstance(self.dependency, (list, tuple)) else [self.dependency]

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        n = len([p for p in inspect.signature(self.f).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]) if self._inspectable() else 1
        out = {}
        for name in flat(entries):
            if self.engine == "pandas":
                c = F.pandas_udf(self.f, self.dtype)(cols[name])
            else:
                c = self.f(cols[name], cols) if n > 1 else self.f(cols[name])
            out[name] = c.cast(self.dtype) if self.dtype and self.engine != "pandas" else c
        return out

    def _inspectable(self) -> bool:
        try:
            inspect.signature(self.f)
        except (TypeError, ValueError):
            return False
        return True

    def column_dtype(self, name: str, source: ColumnSchema) -> str | None:
        return self.dtype  # else found from the plan

    def params(self) -> dict:
        return {"f": to_path(self.f), "label": self._label, "dtype": self.dtype, "tags": list(self.tags), "properties": self.properties, "engine": self.engine}


def numeric(dtype: str | None) -> bool:
    return dtype is None or dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")


def spark_type(text: str) -> T.DataType:
    return T._parse_datatype_string(text)
