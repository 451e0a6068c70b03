"""Sharding by a hierarchical weighted hash tree.

A key descends from the root: at each node every child draws an exponential
clock -ln(u) / weight from a hash of the key and the child's path, and the least
draw wins, so a child is chosen in proportion to its weight among its siblings.
A draw depends on nothing but the key, the path and the child's own weight:

- a child whose weight rises takes rows from its siblings, one whose weight
  falls gives rows to them, and nothing moves between the others;
- inside a subtree whose own weight is fixed nothing that changes reaches the
  outside: what is moved stays below the node whose children changed;
- a shard that is added takes rows only into itself, and only from its rack.

The law is ``key``: the key and the tree decide, rows are spread in
expectation.  A null key hashes as the text 'null'.  Equal keys share a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, quoted


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; names are unique among siblings, and a leaf's name is its shard number."""

    name: int
    weight: float = 1.0
    children: tuple[Node, ...] = ()

    @property
    def open(self) -> bool:
        """Whether keys can come here: it has a weight, and a leaf below it has."""
        return self.weight > 0 and (not self.children or any(c.open for c in self.children))


def balanced_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """Shards 0 to n-1, dealt to regions and to racks in turn; all weights are equal.

    Shards get equal shares if every rack has as many.  A larger tree holds all
    nodes of a smaller one with the same weights, so growth moves rows only into
    the new shard.
    """
    at: dict[int, dict[int, list[Node]]] = {}
    for i in range(shards):
        at.setdefault(i % regions, {}).setdefault(i // regions % racks, []).append(Node(i))
    return Node(0, 1.0, tuple(Node(r, 1.0, tuple(Node(k, 1.0, tuple(x)) for k, x in rack.items())) for r, rack in at.items()))


def _clock(key: Column, path: str, weight: float) -> Column:
    u = (F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), F.lit(path)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def descend(key: Column, tree: Node, path: str = "") -> Column:
    """The shard that the key descends to; nodes of weight 0 take nothing."""
    if not tree.open:
        raise ValueError("no leaf has a weight")
    if not tree.children:
        return F.lit(tree.name)
    draws = []
    for child in tree.children:
        if child.open:
            at = f"{path}/{child.name}"
            draws.append(F.struct(_clock(key, at, child.weight).alias("draw"), descend(key, child, at).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard(df: DataFrame, key: str, tree: Node, out: str = "shard") -> DataFrame:
    return df.withColumn(out, descend(F.col(quoted(key)), tree).cast("int"))


def with_slots(df: DataFrame, group: str, order: list[str], out: str = "slot", rows_per_task: int = 50_000) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each group, by hashed parts and by the order within them.

    A group may be a large share of all rows, and so may be rows that are equal:
    the parts hash the ordering columns and the row's place in its task, and are
    numbered apart; their counts, summed, give the offsets.  The rows are
    checkpointed with their parts, so that both reads see the same.
    """
    part, n, offset, row, g = fresh(df, "__part", "__n", "__offset", "__row", "__g")
    parts = max(1, df.count() // rows_per_task)
    place = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    cut = checkpoint(df.withColumn(part, F.pmod(F.hash(*[F.col(quoted(c)) for c in order]) + place, F.lit(parts))))
    counts = cut.groupBy(F.col(quoted(group)).alias(g), part).agg(F.count("*").alias(n))
    before = Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(g, F.col(part).alias(n), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    inside = F.row_number().over(Window.partitionBy(quoted(group), part).orderBy(*[F.col(quoted(c)) for c in order])) - 1
    met = cut.withColumn(row, inside).join(offsets, (F.col(quoted(group)) == F.col(g)) & (F.col(part) == F.col(n)))
    return met.select(*[F.col(quoted(c)) for c in df.columns], (F.col(row) + F.col(offset)).cast("long").alias(out))


def size() -> Column:
    """UTF-8 bytes of the text plus 1; a null text counts as empty."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def text_crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row.

    Repeated rows have a slot each; an empty table gives no rows.  Other columns
    are not carried.
    """
    rows = docs.select(
        "doc_id",
        size().alias("size"),
        text_crc32().alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(F.col("doc_id"), balanced_tree(shards)).cast("int").alias("shard"),
        descend(F.col("doc_id"), balanced_tree(shards + 1)).cast("int").alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_whole(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The documents, all columns, with size, text_crc32, shard and slot; a name that is taken gets an underscore more."""
    names = fresh(docs, "size", "text_crc32", "shard", "slot")
    rows = docs.select(*[F.col(quoted(c)) for c in docs.columns], size().alias(names[0]), text_crc32().alias(names[1]), descend(F.col("doc_id"), balanced_tree(shards)).cast("int").alias(names[2]))
    return with_slots(rows, names[2], ["doc_id", names[1], names[0]], names[3])
