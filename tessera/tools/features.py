"""A workflow from declared features: what a model wants to be fed, as plain descriptors.

Each descriptor names its input and how it becomes a number; ``embedding`` is
the dimension of an embedding, or None for an indicator.  The workflow makes
the inputs; the list returned with it says what the model's first layer gets:
numbers, and ids below a size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..graph import Node
from ..operators import Bucketize, Categorify, HashBucket, HashedCross, Operator, Rename
from ..workflow import Workflow


@dataclass(frozen=True)
class Numeric:
    name: str


@dataclass(frozen=True)
class Bucketized:
    """The bucket of a number; boundaries are ascending."""

    name: str
    boundaries: tuple[float, ...]
    embedding: int | None = None


@dataclass(frozen=True)
class Vocabulary:
    """The place of a value in a list, or in a text file of one value a line (any path that Spark reads)."""

    name: str
    values: tuple | None = None
    file: str | None = None
    embedding: int | None = None


@dataclass(frozen=True)
class Hashed:
    name: str
    buckets: int
    embedding: int | None = None


@dataclass(frozen=True)
class Identity:
    """Ids below ``buckets`` as they are."""

    name: str
    buckets: int
    embedding: int | None = None


@dataclass(frozen=True)
class Crossed:
    names: tuple[str, ...]
    buckets: int
    embedding: int | None = None


@dataclass(frozen=True)
class Fed:
    """One output of the workflow: a number (size None) or an id from 0 to size - 1."""

    name: str
    size: int | None = None
    embedding: int | None = None


Feature = Numeric | Bucketized | Vocabulary | Hashed | Identity | Crossed


def _values(f: Vocabulary) -> list:
    if (f.values is None) == (f.file is None):
        raise ValueError(f"{f.name}: give either values or a file")
    if f.values is not None:
        return list(f.values)
    whole = SparkSession.active().read.text(f.file, wholetext=True).first()
    return whole[0].splitlines() if whole else []


def feature_workflow(features: list[Feature], label: str | list[str] | None = None, method: str = "xxhash64") -> tuple[Workflow, list[Fed]]:
    """The workflow, not yet fitted, and what it feeds.

    A column that several features use gets an output for each: the plain name
    for the first, then the name with ``_buckets``, ``_ids``, ``_hashed`` or ``_id``.
    """
    kinds = {Bucketized: "_buckets", Vocabulary: "_ids", Hashed: "_hashed", Identity: "_id"}
    used: set[str] = set()
    nodes: list[Node | list[str]] = []
    fed: list[Fed] = []

    def out(name: str, postfix: str, node: Node, size: int | None, embedding: int | None) -> None:
        target = name if name not in used else name + postfix
        if target in used:
            raise ValueError(f"two features would feed {target}")
        used.add(target)
        nodes.append(node if target == name else node >> Rename(name=target))
        fed.append(Fed(target, size, embedding))

    for f in sorted(features, key=lambda f: not isinstance(f, Numeric)):  # numbers keep their names
        if isinstance(f, Crossed):
            name = "_X_".join(f.names)
            out(name, "_crossed", [list(f.names)] >> HashedCross(f.buckets, method=method), f.buckets, f.embedding)
        elif isinstance(f, Numeric):
            out(f.name, "", [f.name] >> Operator(), None, None)
        elif isinstance(f, Bucketized):
            out(f.name, kinds[Bucketized], [f.name] >> Bucketize(list(f.boundaries)), len(f.boundaries) + 1, f.embedding)
        elif isinstance(f, Vocabulary):
            values = _values(f)
            out(f.name, kinds[Vocabulary], [f.name] >> Categorify(vocabs={f.name: values}), len(values) + 3, f.embedding)  # padding, null and other values come first
        elif isinstance(f, Hashed):
            out(f.name, kinds[Hashed], [f.name] >> HashBucket(f.buckets, method=method), f.buckets, f.embedding)
        elif isinstance(f, Identity):
            out(f.name, kinds[Identity], [f.name] >> Operator(), f.buckets, f.embedding)
        else:
            raise TypeError(f"not a feature: {f!r}")
    for n in [label] if isinstance(label, str) else label or []:
        nodes.append([n] >> Operator())
    if not nodes:
        raise ValueError("no features")
    whole = nodes[0]
    for n in nodes[1:]:
        whole = whole + n
    return Workflow(whole), fed
