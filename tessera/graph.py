"""Selectors and the operator graph: >>, +, -, [] over nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from .operators.base import LambdaOp, Operator
from .schema import Schema, tag_name


class ColumnSelector:
    """Names, groups of names (one level) and tags."""

    def __init__(self, names: str | Iterable = (), tags: Iterable = ()) -> None:
        self.entries: list[str | tuple[str, ...]] = []
        self.tags = [tag_name(t) for t in tags]
        for x in [names] if isinstance(names, str) else names:
            if isinstance(x, str):
                self.entries.append(x)
            elif isinstance(x, ColumnSelector):
                self.entries.append(tuple(x.names))
            else:
                group = list(x)
                if not all(isinstance(y, str) for y in group):
                    raise ValueError("column groups cannot hold groups")
                self.entries.append(tuple(group))

    @property
    def names(self) -> list[str]:
        flat = [n for e in self.entries for n in ([e] if isinstance(e, str) else e)]
        return list(dict.fromkeys(flat))

    @property
    def grouped_names(self) -> list[str | tuple[str, ...]]:
        return list(self.entries)

    @property
    def subgroups(self) -> list[tuple[str, ...]]:
        return [e for e in self.entries if not isinstance(e, str)]

    def resolve(self, schema: Schema) -> list[str | tuple[str, ...]]:
        tagged = schema.by_tag(self.tags).column_names if self.tags else []
        return list(dict.fromkeys([*self.entries, *tagged]))

    def __rshift__(self, op: object) -> Node:
        return Node(selector=self) >> op

    def __add__(self, other: object) -> Node:
        return Node(selector=self) + other

    def __radd__(self, other: object) -> Node:
        return as_node(other) + Node(selector=self)

    def __sub__(self, other: object) -> Node:
        return Node(selector=self) - other


def ColumnGroup(columns: Iterable) -> Node:  # noqa: N802
    """A node of columns; kept for older code."""
    return Node(selector=ColumnSelector(columns))


class Node:
    """kind: selection, op, concat, subtract, subset, group or subgraph."""

    def __init__(self, op: Operator | None = None, parents: Iterable[Node] = (), dependencies: Iterable[Node] = (), selector: ColumnSelector | None = None, kind: str | None = None, name: str | None = None) -> None:
        self.op, self.parents, self.dependencies, self.selector, self.name = op, list(parents), list(dependencies), selector, name
        self.kind = kind or ("op" if op else "selection")
        self.lenient = False

    def __rshift__(self, op: object) -> Node:
        if isinstance(op, type) and issubclass(op, Operator):
            op = op()
        if not isinstance(op, Operator):
            if not callable(op):
                raise ValueError(f"not an operator: {op!r}")
            op = LambdaOp(op)
        return Node(op, [self], [as_node(d) for d in op.dependencies])

    __rrshift__ = None  # lists reach a node through Operator.__rrshift__

    def __add__(self, other: object) -> Node:
        left = [*self.parents, *self.dependencies] if self.kind == "concat" else [self]
        others = [as_node(x) for x in other] if isinstance(other, list) and any(isinstance(x, Node) for x in other) else [as_node(other)]
        for o in others:
            left += [*o.parents, *o.dependencies] if o.kind == "concat" else [o]
        return Node(parents=left[:1], dependencies=left[1:], kind="concat")

    def __radd__(self, other: object) -> Node:
        return as_node(other) + self

    def __sub__(self, other: object) -> Node:
        gone = other if isinstance(other, Node) else as_node(other)
        if gone is not other:
            gone.lenient = True  # names that are not there are no error
        return Node(parents=[self], dependencies=[gone], kind="subtract")

    def __rsub__(self, other: object) -> Node:
        return as_node(other) - self

    def __getitem__(self, names: object) -> Node:
        return Node(parents=[self], selector=ColumnSelector(names), kind="subset")

    def walk(self) -> Iterator[Node]:
        """Depth first, inputs before what uses them, each node once."""
        seen: set[int] = set()

        def visit(n: Node) -> Iterator[Node]:
            if id(n) not in seen:
                seen.add(id(n))
                for x in [*n.parents, *n.dependencies]:
                    yield from visit(x)
                yield n

        yield from visit(self)

    @property
    def graph(self) -> str:
        """The graph in DOT."""
        order = {id(n): i for i, n in enumerate(self.walk())}
        lines = [f'  n{order[id(n)]} [label="{n.label}"];' for n in self.walk()]
        lines += [f"  n{order[id(p)]} -> n{order[id(n)]};" for n in self.walk() for p in [*n.parents, *n.dependencies]]
        return "digraph {\n" + "\n".join(lines) + "\n}"

    @property
    def label(self) -> str:
        if self.kind == "op":
            return self.op.label
        return str(self.selector.grouped_names or self.selector.tags) if self.selector else self.kind


def Subgraph(name: str, node: object, loop_until: Callable | None = None) -> Node:  # noqa: N802
    """A named part of a graph, found again by Workflow.get_subworkflow."""
    out = Node(parents=[as_node(node)], kind="subgraph", name=name)
    out.loop_until = loop_until
    return out


def as_node(x: object) -> Node:
    if isinstance(x, Node):
        return x
    if isinstance(x, ColumnSelector):
        return Node(selector=x)
    if isinstance(x, str):
        return Node(selector=ColumnSelector([x]))
    parts = list(x)
    if any(isinstance(p, (Node, ColumnSelector)) for p in parts) or any(isinstance(p, list) and any(isinstance(q, Node) for q in p) for p in parts):
        nodes = []
        for p in parts:
            if isinstance(p, list):
                nodes.append(Node(parents=[as_node(p)], kind="group"))
            elif isinstance(p, Node) and p.kind == "concat" and len(parts) == 1:
                nodes.append(Node(parents=[p], kind="group"))
            else:
                nodes.append(as_node(p))
        return nodes[0] if len(nodes) == 1 else Node(parents=nodes[:1], dependencies=nodes[1:], kind="concat")
    return Node(selector=ColumnSelector(parts))
