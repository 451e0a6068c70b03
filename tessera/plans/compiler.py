"""A graph becomes one DataFrame.

All columns of one row set live in one growing DataFrame under private names;
each node is a projection or a left join with a lookup of unique keys, and the
result is one final select.  Catalyst collapses the projections and prunes what
is not used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Node
from ..operators.base import Entries, Operator, Room, flat
from ..schema import ColumnSchema, Schema


class RowSet:
    """Rows that several nodes share."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.n, self.room = df, 0, Room()

    def bind(self, cols: dict[str, Column]) -> dict[str, str]:
        """Gives expressions private names in the DataFrame."""
        names = {c: f"__n{self.n + i}_{c}" for i, c in enumerate(cols)}
        self.n += len(cols)
        self.df = self.df.select("*", *[x.alias(names[c]) for c, x in cols.items()])
        return names


@dataclass
class Part:
    """A node's columns: public name to private name, or to the expression of a derived column, and the schema."""

    rows: RowSet | None
    names: dict[str, str | Column]
    schema: Schema
    entries: Entries = field(default_factory=list)

    def columns(self) -> dict[str, Column]:
        return {n: p if isinstance(p, Column) else F.col(f"`{p}`") for n, p in self.names.items()}


def merged_entries(entries: Entries, extra: Entries) -> Entries:
    return list(dict.fromkeys([*entries, *extra]))


class Compiler:
    """Evaluates nodes over a DataFrame, or over a schema alone.

    derived columns are expressions of the source's: they are worked out where
    they are used, so joins carry what they are made of.
    """

    def __init__(self, source: DataFrame | None, schema: Schema, fitting: bool = False, removed: set[str] = frozenset(), derived: dict[str, Column] | None = None) -> None:
        self.fitting, self.done = fitting, {}
        self.schema = schema
        self.removed = removed
        self.root = None
        if source is not None:
            self.root = RowSet(source)
            self.root_names = self.root.bind({c: F.col(f"`{c}`") for c in source.columns if not derived or c in schema}) | (derived or {})

    def part(self, node: Node) -> Part:
        if id(node) not in self.done:
            self.done[id(node)] = self._eval(node)
        return self.done[id(node)]

    def _select(self, part: Part, names: list[str]) -> Part:
        return Part(part.rows, {n: part.names[n] for n in names} if part.rows else {}, part.schema.select(names), list(names))

    def _eval(self, node: Node) -> Part:
        if node.kind == "selection":
            entries = [e for e in node.selector.resolve(self.schema) if not ({e} if isinstance(e, str) else set(e)) & self.removed]
            if node.lenient:
                entries = [n for n in flat(entries) if n in self.schema]
            names = flat(entries)
            unknown = [n for n in names if n not in self.schema]
            if unknown and len(self.schema):
                raise ValueError(f"columns not in the dataset: {unknown}")
            schema = Schema(self.schema[n] if n in self.schema else ColumnSchema(n) for n in names)
            return Part(self.root, {n: self.root_names[n] for n in names} if self.root else {}, schema, entries)
        for p in sorted([*node.parents, *node.dependencies], key=lambda p: not self._looks_up(p)):  # lookups join rows that have no further columns yet
            self.part(p)
        inputs = [self.part(p) for p in node.parents]
        others = [self.part(d) for d in node.dependencies]
        if node.kind == "subgraph":
            return inputs[0]
        if node.kind == "group":
            p = inputs[0]
            return Part(p.rows, p.names, p.schema, [tuple(p.schema.column_names)])
        if node.kind == "subset":
            wanted = node.selector.resolve(inputs[0].schema)
            return Part(inputs[0].rows, {n: inputs[0].names[n] for n in flat(wanted)} if inputs[0].rows else {}, inputs[0].schema.select(flat(wanted)), wanted)
        if node.kind == "subtract":
            gone = {n for o in others for n in o.schema.column_names}
            kept = [n for n in inputs[0].schema.column_names if n not in gone]
            return self._select(inputs[0], kept)
        if node.kind == "concat":
            return self._concat([*inputs, *others])
        return self._apply(node.op, self._concat(inputs) if len(inputs) > 1 else inputs[0], others)

    @staticmethod
    def _looks_up(node: Node) -> bool:
        return any(n.op is not None and type(n.op).extend is not Operator.extend for n in node.walk())

    def _concat(self, parts: list[Part]) -> Part:
        rows = {id(p.rows) for p in parts if p.schema.column_names}
        if len(rows) > 1:
            raise ValueError("columns of different row sets cannot stand side by side: a branch has filtered, joined or grouped its rows")
        names, schema, entries = {}, Schema(), []
        for p in parts:
            names, schema, entries = names | p.names, schema + p.schema, merged_entries(entries, p.entries)
        # a node may come both alone and within a group
        return Part(parts[0].rows, names, schema, entries)

    def _apply(self, op: Operator, main: Part, others: list[Part]) -> Part:
        names = {n for o in others for n in o.schema.column_names}
        if hasattr(op, "bind_dependencies") and others:
            op.bind_dependencies([n for o in others for n in o.schema.column_names])
        everything = self._concat([main, *others]) if others else main
        if self.root is None:
            out = op.output_schema(everything.schema, main.entries)
            return Part(None, {}, out, out.column_names)
        del names
        if op.changes_rows:
            cols = everything.columns()
            df = everything.rows.df.select(*[c.alias(n) for n, c in cols.items()])
            got = op.relate(df, main.entries, everything.schema)
            declared = op.output_schema(everything.schema, main.entries)
            rows = RowSet(got)
            bound = rows.bind({n: F.col(f"`{n}`") for n in declared.column_names})
            return Part(rows, bound, self._typed(declared, rows, bound), declared.column_names)
        rows = everything.rows
        op.room = rows.room
        rows.df, cols = op.extend(rows.df, main.entries, everything.columns(), everything.schema, self.fitting)
        bound = rows.bind(cols)
        declared = op.output_schema(everything.schema, main.entries)
        declared = Schema(declared[n] if n in declared else ColumnSchema(n) for n in bound)
        return Part(rows, bound, self._typed(declared, rows, bound), list(bound))

    @staticmethod
    def _typed(declared: Schema, rows: RowSet, bound: dict[str, str]) -> Schema:
        """The types that the plan really has."""
        kinds = dict(rows.df.dtypes)
        return Schema(declared[n].with_dtype(kinds[p]) for n, p in bound.items())

    def result(self, node: Node) -> DataFrame:
        p = self.part(node)
        return p.rows.df.select(*[c.alias(n, metadata=p.schema[n].metadata()) for n, c in p.columns().items()])
