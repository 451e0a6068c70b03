"""Operators on names, tags and properties; they cost nothing at run time."""

from __future__ import annotations

from collections.abc import Callable

from ..schema import ColumnSchema, Schema, Tags
from .base import Cols, Entries, Operator, StatOperator, flat, from_path, to_path


class AddMetadata(Operator):
    def __init__(self, tags: object = None, properties: dict | None = None) -> None:
        self.tags = [tags] if isinstance(tags, str) else list(tags or [])
        self.properties = properties or {}
        self.output_tags, self.output_properties = tuple(self.tags), self.properties

    def params(self) -> dict:
        return {"tags": [str(getattr(t, "value", t)) for t in self.tags], "properties": self.properties}


class AddTags(AddMetadata):
    def __init__(self, tags: object = None) -> None:
        super().__init__(tags)

    def params(self) -> dict:
        return {"tags": super().params()["tags"]}


class AddProperties(AddMetadata):
    def __init__(self, properties: dict | None = None) -> None:
        super().__init__(None, properties)

    def params(self) -> dict:
        return {"properties": self.properties}


class _Fixed(AddMetadata):
    fixed: tuple = ()

    def __init__(self) -> None:
        super().__init__(list(self.fixed))

    def params(self) -> dict:
        return {}


class TagAsUserID(_Fixed):
    fixed = (Tags.ID, Tags.USER)


class TagAsItemID(_Fixed):
    fixed = (Tags.ID, Tags.ITEM)


class TagAsUserFeatures(_Fixed):
    fixed = (Tags.USER,)


class TagAsItemFeatures(_Fixed):
    fixed = (Tags.ITEM,)


class Rename(Operator):
    """New names by a function, a postfix, or (for one column) a name; the first given counts."""

    def __init__(self, f: Callable[[str], str] | None = None, postfix: str | None = None, name: str | None = None) -> None:
        if f is None and postfix is None and name is None:
            raise ValueError("one of f, postfix and name is needed")
        self.f = from_path(f) if isinstance(f, str) else f
        self.postfix, self.name = postfix, name

    def renamed(self, column: str) -> str:
        if self.f:
            return self.f(column)
        return column + self.postfix if self.postfix is not None else self.name

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        names = flat(entries)
        if not self.f and self.postfix is None and len(names) > 1:
            raise RuntimeError("a single name cannot be given to several columns")
        out = {self.renamed(n): [n] for n in names}
        if len(out) < len(names):
            raise ValueError("several columns would get the same name")
        return out

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        return {new: cols[old[0]] for new, old in self.column_mapping(entries).items()}

    def params(self) -> dict:
        return {"f": to_path(self.f) if self.f else None, "postfix": self.postfix, "name": self.name}


class DropLowCardinality(Operator):
    """Drops categorical columns whose known domain has fewer than min_cardinality ids; others come first."""

    def __init__(self, min_cardinality: int = 4) -> None:
        self.min_cardinality = min_cardinality

    def kept(self, schema: Schema, entries: Entries) -> list[str]:
        names = [n for n in flat(entries) if n in schema]
        cat = [n for n in names if "categorical" in schema[n].tags]

        def enough(n: str) -> bool:
            domain = schema[n].properties.get("domain")
            return domain is None or domain.get("max", 0) >= self.min_cardinality

        return [n for n in names if n not in cat] + [n for n in cat if enough(n)]

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        return schema.select(self.kept(schema, entries))

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        return {n: cols[n] for n in self.kept(schema, entries)}


class ValueCount(StatOperator):
    """The least and greatest length of list columns, as a property."""

    def __init__(self) -> None:
        self.counts: dict[str, dict] = {}

    def fit_aggs(self, entries: Entries, cols: Cols, schema: Schema) -> list:
        from pyspark.sql import functions as F

        self._lists = [n for n in flat(entries) if schema[n].is_list]
        return [f(F.size(cols[n])) for n in self._lists for f in (F.min, F.max)]

    def fit_finalize(self, values: list) -> None:
        self.counts = {n: {"min": values[2 * i], "max": values[2 * i + 1]} for i, n in enumerate(self._lists)}
        self.fitted = True

    def column_properties(self, name: str, source: ColumnSchema) -> dict:
        return {"value_count": self.counts[name]} if name in self.counts else {}

    def clear(self) -> None:
        self.counts, self.fitted = {}, False

    def state(self) -> dict:
        return {"counts": self.counts}

    def load_state(self, state: dict) -> None:
        self.counts = state["counts"]
