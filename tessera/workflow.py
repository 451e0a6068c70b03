"""Fit a graph once, transform any number of datasets, save and load."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from datetime import UTC, datetime
from functools import singledispatchmethod

import pyspark
from pyspark.sql import DataFrame, SparkSession

from . import operators
from .graph import ColumnSelector, Node, as_node
from .operators.base import Operator, StatOperator, col, flat
from .operators.base import trusted as trusted_packages
from .plans.compiler import Compiler
from .schema import Schema
from .sources.dataset import Dataset

VERSION = "0.1.0"
FORMAT = 1


class Workflow:
    def __init__(self, output_node: object) -> None:
        self.output_node: Node = as_node(output_node)
        self._input_schema: Schema | None = None
        self._output_schema: Schema | None = None
        self._removed: set[str] = set()
        #: what was fitted last, until the output schema is asked for: its types take a whole plan
        self._fitted_on: tuple[DataFrame, Schema] | None = None

    # schema

    def fit_schema(self, schema: Schema) -> Workflow:
        """Output names and, as far as they are known, types from an input schema alone."""
        self._input_schema, self._fitted_on = schema.excluding(self._removed), None
        self._output_schema = Compiler(None, self._input_schema, removed=self._removed).part(self.output_node).schema
        return self

    @property
    def input_schema(self) -> Schema | None:
        if self._input_schema is None:
            return None
        used = self._inputs(self._input_schema)
        return self._input_schema.select(n for n in self._input_schema.column_names if n in used)

    @property
    def output_schema(self) -> Schema | None:
        if self._fitted_on is not None:
            df, schema = self._fitted_on
            self._output_schema, self._fitted_on = Compiler(df, schema, removed=self._removed).part(self.output_node).schema, None
        return self._output_schema

    @property
    def input_dtypes(self) -> dict[str, str]:
        return {c.name: c.dtype for c in self.input_schema}

    @property
    def output_dtypes(self) -> dict[str, str]:
        return {c.name: c.dtype for c in self.output_schema}

    def _inputs(self, schema: Schema) -> set[str]:
        used = {n for node in self.output_node.walk() if node.kind == "selection" for n in flat(node.selector.resolve(schema))}
        return used - self._removed

    @property
    def column_mapping(self) -> dict[str, list[str]]:
        """Each output column's input columns, through the whole graph."""
        schema = self._input_schema or Schema()
        compiler = Compiler(None, schema, removed=self._removed)
        lineage: dict[int, dict[str, list[str]]] = {}
        for node in self.output_node.walk():
            below = [lineage[id(x)] for x in [*node.parents, *node.dependencies]]
            known = {k: v for m in below for k, v in m.items()}
            part = compiler.part(node)
            if node.kind == "selection":
                lineage[id(node)] = {n: [n] for n in part.schema.column_names}
            elif node.kind == "op":
                mapping = node.op.column_mapping(compiler._concat([compiler.part(p) for p in node.parents]).entries)
                lineage[id(node)] = {n: list(dict.fromkeys(s for x in mapping.get(n, [n]) for s in known.get(x, [x]))) for n in part.schema.column_names}
            else:
                lineage[id(node)] = {n: known.get(n, [n]) for n in part.schema.column_names}
        return lineage[id(self.output_node)]

    # parts

    @property
    def subworkflows(self) -> list[str]:
        return [n.name for n in self.output_node.walk() if n.kind == "subgraph"]

    def get_subworkflow(self, name: str) -> Workflow:
        for n in self.output_node.walk():
            if n.kind == "subgraph" and n.name == name:
                out = Workflow(n)
                if self._input_schema is not None:
                    out.fit_schema(self._input_schema)
                return out
        raise ValueError(f"No subgraph named {name!r}")

    def remove_inputs(self, columns: Iterable[str]) -> Workflow:
        """Takes away input columns and all that is made from them."""
        gone = set(columns)
        mapping = self.column_mapping
        lost = [n for n, sources in mapping.items() if set(sources) & gone]
        self._removed |= gone
        self.output_node = self._without(self.output_node, gone, {})
        if lost and self._input_schema is not None:
            self.fit_schema(self._input_schema)
        return self

    def _without(self, node: Node, gone: set[str], done: dict[int, Node | None]) -> Node | None:
        """The graph without nodes whose every input is gone."""
        if id(node) in done:
            return done[id(node)]
        if node.kind == "selection":
            entries = [e for e in node.selector.entries if not ({e} if isinstance(e, str) else set(e)) & gone]
            out = Node(selector=ColumnSelector(entries, node.selector.tags)) if entries or node.selector.tags else None
        else:
            parents = [x for p in node.parents if (x := self._without(p, gone, done)) is not None]
            rest = [x for d in node.dependencies if (x := self._without(d, gone, done)) is not None]
            if node.kind == "concat" and not parents and rest:
                parents, rest = rest[:1], rest[1:]
            if not parents or node.kind == "op" and len(rest) < len(node.dependencies):
                out = None
            else:
                out = Node(node.op, parents, rest, node.selector, node.kind, node.name)
        done[id(node)] = out
        return out

    # fitting

    def fit(self, dataset: Dataset | DataFrame) -> Workflow:
        """Fits all statistics, in layers: plain aggregates of one layer and row set are one job."""
        df = _frame(dataset)
        schema = Schema.of(df.schema).excluding(self._removed)
        self.clear_stats()
        waiting = [n for n in self.output_node.walk() if n.op is not None and n.op.stat]
        while waiting:
            below = {id(n): {id(x) for x in n.walk() if x is not n} for n in waiting}
            ready = [n for n in waiting if not any(id(w) in below[id(n)] for w in waiting)]
            compiler = Compiler(df, schema, fitting=True, removed=self._removed)
            fused: dict[int, list] = {}
            for n in ready:
                main = compiler._concat([compiler.part(p) for p in n.parents])
                others = [compiler.part(d) for d in n.dependencies]
                if hasattr(n.op, "bind_dependencies") and others:
                    n.op.bind_dependencies([c for o in others for c in o.schema.column_names])
                everything = compiler._concat([main, *others]) if others else main
                aggs = n.op.fit_aggs(main.entries, everything.columns(), everything.schema)
                if aggs is None:
                    n.op.fit(everything.rows.df, main.entries, everything.columns(), everything.schema)
                else:
                    fused.setdefault(id(everything.rows), [everything.rows]).append((n.op, aggs))
            for rows, *ops in fused.values():
                flat_aggs = [a for _, aggs in ops for a in aggs]
                values = list(rows.df.agg(*[a.alias(f"a{i}") for i, a in enumerate(flat_aggs)]).first()) if flat_aggs else []
                at = 0
                for op, aggs in ops:
                    op.fit_finalize(values[at : at + len(aggs)])
                    at += len(aggs)
            for n in ready:
                n.op.fitted = True
            waiting = [n for n in waiting if n not in ready]
        self._input_schema = schema
        self._fitted_on = (df, schema)
        return self

    def fit_transform(self, dataset: Dataset | DataFrame) -> Dataset:
        self.fit(dataset)
        return self._transform(dataset, fitting=True)

    def clear_stats(self) -> None:
        for n in self.output_node.walk():
            if isinstance(n.op, StatOperator):
                n.op.clear()

    @singledispatchmethod
    def transform(self, data):
        raise NotImplementedError(f"cannot transform {type(data)}")

    @transform.register
    def _(self, data: Dataset) -> Dataset:
        return self._transform(data)

    @transform.register
    def _(self, data: DataFrame) -> DataFrame:
        return self._transform(data).df

    def _transform(self, data: Dataset | DataFrame, fitting: bool = False) -> Dataset:
        df = _frame(data)
        for n in self.output_node.walk():
            if isinstance(n.op, StatOperator) and not n.op.fitted:
                raise ValueError(f"{n.op.label} is not fitted")
        schema = Schema.of(df.schema).excluding(self._removed)
        used = self._inputs(schema)
        source = df.select(*[col(c) for c in df.columns if c in used]) if used else df
        derived = {n: c for n, c in data.derived.items() if n in source.columns} if isinstance(data, Dataset) else {}
        compiler = Compiler(data.stored if derived else source, schema.select(source.columns), fitting=fitting, removed=self._removed, derived=derived)
        out = Dataset(compiler.result(self.output_node))
        self._output_schema, self._fitted_on = compiler.part(self.output_node).schema, None
        return out

    # saving

    def save(self, path: str) -> None:
        """graph.json and metadata.json, tables as Parquet beside them; written through Spark, so any path it knows will do."""
        spark = SparkSession.active()
        order = list(self.output_node.walk())
        ids = {id(n): i for i, n in enumerate(order)}
        nodes = []
        for i, n in enumerate(order):
            rec: dict = {"id": i, "kind": n.kind, "name": n.name, "parents": [ids[id(p)] for p in n.parents], "dependencies": [ids[id(d)] for d in n.dependencies]}
            if n.selector is not None:
                rec["selector"] = {"entries": [e if isinstance(e, str) else list(e) for e in n.selector.entries], "tags": n.selector.tags}
            if n.op is not None:
                kind = type(n.op)
                rec |= {"op": kind.__name__ if getattr(operators, kind.__name__, None) is kind else f"{kind.__module__}:{kind.__qualname__}", "params": n.op.params(), "state": n.op.state(), "fitted": getattr(n.op, "fitted", None)}
                rec["tables"] = {}
                for k, (name, table) in enumerate(n.op.tables().items()):
                    rec["tables"][name] = f"artifacts/node_{i}/table_{k}"
                    table.write.mode("overwrite").parquet(f"{path}/{rec['tables'][name]}")
            nodes.append(rec)
        graph = {"format_version": FORMAT, "nodes": nodes, "output": ids[id(self.output_node)], "removed": sorted(self._removed), "input_schema": self._input_schema.to_json() if self._input_schema else None, "output_schema": self.output_schema.to_json() if self.output_schema else None}
        meta = {"versions": {"tessera": VERSION, "pyspark": pyspark.__version__}, "generated": datetime.now(UTC).isoformat()}
        for name, content in (("graph.json", graph), ("metadata.json", meta)):
            spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")

    @classmethod
    def load(cls, path: str, trusted: Iterable[str] = ()) -> Workflow:
        """A saved graph names callables by import path: those of modules that are imported already, or of trusted packages, are taken."""
        held = trusted_packages.set(("tessera", *trusted))
        try:
            return cls._load(path)
        finally:
            trusted_packages.reset(held)

    @classmethod
    def _load(cls, path: str) -> Workflow:
        spark = SparkSession.active()
        read = lambda name: json.loads(spark.read.text(f"{path}/{name}", wholetext=True).first()[0])
        meta, graph = read("metadata.json"), read("graph.json")
        if graph["format_version"] != FORMAT:
            raise ValueError(f"unknown format version {graph['format_version']}")
        for k, now in (("tessera", VERSION), ("pyspark", pyspark.__version__)):
            if meta["versions"][k].split(".")[:2] != now.split(".")[:2]:
                warnings.warn(f"saved with {k} {meta['versions'][k]}, loaded with {now}", stacklevel=2)
        nodes: list[Node] = []
        for rec in graph["nodes"]:
            op = None
            if "op" in rec:
                op = _rebuilt(rec["op"], rec["params"])
                op.load_state(rec["state"])
                if rec["tables"]:
                    op.load_tables({name: spark.read.parquet(f"{path}/{p}") for name, p in rec["tables"].items()})
                if rec["fitted"] is not None:
                    op.fitted = rec["fitted"]
            selector = ColumnSelector([e if isinstance(e, str) else tuple(e) for e in rec["selector"]["entries"]], rec["selector"]["tags"]) if "selector" in rec else None
            nodes.append(Node(op, [nodes[p] for p in rec["parents"]], [nodes[d] for d in rec["dependencies"]], selector, rec["kind"], rec["name"]))
        out = cls(nodes[graph["output"]])
        out._removed = set(graph["removed"])
        out._input_schema = Schema.from_json(graph["input_schema"]) if graph["input_schema"] else None
        out._output_schema = Schema.from_json(graph["output_schema"]) if graph["output_schema"] else None
        return out


def _rebuilt(name: str, params: dict) -> Operator:
    """An operator of this package by name, or one of the user's by import path."""
    from .operators.base import from_path

    kind = from_path(name) if ":" in name else getattr(operators, name)
    if not (isinstance(kind, type) and issubclass(kind, Operator)):
        raise ValueError(f"not an operator: {name}")
    if kind is operators.LambdaOp:
        params = params | {"f": from_path(params["f"])}
    return kind(**params)


def _frame(data: Dataset | DataFrame) -> DataFrame:
    return data.df if isinstance(data, Dataset) else data
