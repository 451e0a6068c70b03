"""Columns with tags and properties, carried in StructField metadata."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T


class Tags(str, Enum):
    CATEGORICAL = "categorical"
    CONTINUOUS = "continuous"
    LIST = "list"
    ID = "id"
    USER = "user"
    ITEM = "item"
    TARGET = "target"


#: Tags that exclude each other; the one added later stays.
EXCLUSIVE = {"categorical": "continuous", "continuous": "categorical"}


def tag_name(tag: str | Tags) -> str:
    return tag.value if isinstance(tag, Tags) else str(tag)


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    dtype: str | None = None  # Spark's simple type string; None if unknown
    tags: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)

    @property
    def is_list(self) -> bool:
        return bool(self.dtype and self.dtype.startswith("array<"))

    @property
    def is_ragged(self) -> bool:
        count = self.properties.get("value_count", {})
        return self.is_list and (not count or count.get("min") != count.get("max"))

    def with_name(self, name: str) -> ColumnSchema:
        return replace(self, name=name)

    def with_dtype(self, dtype: str | None) -> ColumnSchema:
        return replace(self, dtype=dtype)

    def with_tags(self, tags: Iterable[str | Tags]) -> ColumnSchema:
        out = list(self.tags)
        for tag in map(tag_name, tags):
            out = [t for t in out if t != EXCLUSIVE.get(tag)]
            if tag not in out:
                out.append(tag)
        return replace(self, tags=tuple(out))

    def with_properties(self, properties: dict) -> ColumnSchema:
        return replace(self, properties={**self.properties, **properties})

    def metadata(self) -> dict:
        out: dict = {}
        if self.tags:
            out["tags"] = list(self.tags)
        if self.properties:
            out["properties"] = json.dumps(self.properties, sort_keys=True)
        return out


class Schema:
    """An ordered set of column schemas."""

    def __init__(self, columns: Iterable[ColumnSchema | str] = ()) -> None:
        self.columns = {c.name: c for c in (ColumnSchema(x) if isinstance(x, str) else x for x in columns)}

    @classmethod
    def of(cls, struct: T.StructType) -> Schema:
        return cls(ColumnSchema(f.name, f.dataType.simpleString(), tuple((f.metadata or {}).get("tags", ())), json.loads((f.metadata or {}).get("properties", "{}"))) for f in struct.fields)

    @property
    def column_names(self) -> list[str]:
        return list(self.columns)

    def __getitem__(self, name: str) -> ColumnSchema:
        return self.columns[name]

    def __iter__(self):
        return iter(self.columns.values())

    def __len__(self) -> int:
        return len(self.columns)

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and list(self.columns.values()) == list(other.columns.values())

    def __add__(self, other: Schema) -> Schema:
        return Schema([*self, *other])

    def select(self, names: Iterable[str]) -> Schema:
        return Schema(self.columns[n] for n in names)

    def excluding(self, names: Iterable[str]) -> Schema:
        gone = set(names)
        return Schema(c for c in self if c.name not in gone)

    def by_tag(self, tags: Iterable[str | Tags]) -> Schema:
        wanted = {tag_name(t) for t in tags}
        return Schema(c for c in self if wanted & set(c.tags))

    def to_json(self) -> list[dict]:
        return [{"name": c.name, "dtype": c.dtype, "tags": list(c.tags), "properties": c.properties} for c in self]

    @classmethod
    def from_json(cls, data: list[dict]) -> Schema:
        return cls(ColumnSchema(d["name"], d["dtype"], tuple(d["tags"]), d["properties"]) for d in data)
