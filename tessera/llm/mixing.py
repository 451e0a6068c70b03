"""Mixing sources to target weights, in DataFrame functions only.

1. The words of each source are one stream, packed into blocks of a fixed
   length.  A document's place in the stream is a prefix sum: sources are cut
   into hashed runs, about as many as a run has documents, that are summed
   apart; the runs' totals give offsets.
2. Targets share the total by weight, stop at ``cap`` times the source, and the
   excess is shared again: the water level has a closed form over the sources
   sorted by cap / weight.
3. Each source gets round(target / mean block) output slots.  Every one draws
   its output shard by a hash; counted, this gives each shard a multinomial
   number of slots of every source, and the sources' totals meet their targets.
4. A shard's slots of a source take the next indexes of that source, as many as
   were drawn, and index i takes block perm(i mod blocks): a swap-or-not
   shuffle (Hoang, Morris, Rogaway 2012), which permutes any range [0, n) by
   hashes.  A block recurs only when all others have been taken as often, so no
   document exceeds ``cap`` times its size.
5. Slots and document pieces meet in one equi-join on (source, block).

Null or blank texts have size 0, are in no block, and take 0.  Null is a source
like others and sorts last; a null doc_id is a document like others.  Repeated
rows are documents of their own.  An empty table gives no rows.  Columns may
have any names.  The targets are worked out in one task, a row for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, checkpoint, fresh, quoted

ROUNDS = 16
WEIGHTS = (5.0, 2.0, 1.0)


def permuted(x: Column, n: Column, *keys: Column | int) -> Column:
    """A keyed pseudorandom permutation of [0, n)."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in keys]

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *keys), n) - x, n)
        coin = F.pmod(F.xxhash64(F.greatest(x, partner), r + 1000, *keys), F.lit(2))
        return F.when(coin == 1, partner).otherwise(x)

    return F.when(n > 0, F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), x.cast("long"), step))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).cast("long").alias("size"))


def plan(sized: DataFrame, block_words: int, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source: its rank, words, target, blocks and slots."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("rank", rank).withColumn("w", w).withColumn("limit", cap * F.col("source_size")).withColumn("all", F.sum("source_size").over(everything))
    # sorted by limit / weight, the capped sources come first
    order = Window.orderBy((F.col("limit") / F.col("w")), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("capped", F.col("limit") <= F.col("level") * F.col("w"))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everything), F.lit(0.0))
    t = t.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(left * F.col("w") / free))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    t = t.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    return t.select("source", "rank", "source_size", "target", "blocks", "slots")


def _numbers(table: DataFrame, count: str, chunk: int, tasks: int, *keys: str) -> DataFrame:
    """``t`` from 0 to the count less 1 for each row, in chunks of their own: a large count is many tasks.

    The number of tasks is fixed, as the few rows dealt here make many.
    """
    few = table.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk))).alias("chunk"))
    low = F.col("chunk") * chunk
    return few.repartition(tasks, *[F.col(k) for k in keys], F.col("chunk")).select("*", F.explode(F.sequence(low, F.least(low + chunk, F.col(count)) - 1)).alias("t"))


def _tasks(planned: DataFrame, slots_per_task: int = 50_000) -> int:
    return 1 + (planned.agg(F.sum("slots")).first()[0] or 0) // slots_per_task


def drawn(planned: DataFrame, shards: int, seed: int = 0, chunk: int = 4096) -> DataFrame:
    """rank, shard and n, the number of slots drawn, and first, the index of the first of them; sources and shards with some."""
    each = _numbers(planned.select("rank", "slots"), "slots", chunk, _tasks(planned), "rank")
    counts = each.select("rank", F.pmod(F.xxhash64("t", "rank", F.lit(seed), F.lit(-1)), F.lit(shards)).cast("int").alias("shard")).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(planned: DataFrame, shards: int, seed: int = 0, chunk: int = 4096) -> DataFrame:
    """One row per output slot: shard, source rank, block."""
    counts = drawn(planned, shards, seed, chunk).join(planned.select(F.col("rank").alias("r"), "blocks"), F.col("rank") == F.col("r")).drop("r")
    each = _numbers(counts, "n", chunk, _tasks(planned), "rank", "shard")
    return each.select("shard", "rank", permuted(F.pmod(F.col("first") + F.col("t"), F.col("blocks")), F.col("blocks"), seed, F.col("rank")).alias("block"))


def pieces(sized: DataFrame, planned: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block that it lies in: rank, block, sized's columns, first word, words.

    sized has source, size and columns that tell rows apart, the first of them
    named ``row``.
    """
    most = sized.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    runs = max(1, math.isqrt(most))
    kept = [c for c in sized.columns if c != "source"]
    cut = sized.withColumn("run", F.pmod(F.xxhash64(*[c for c in kept if c != "size"]), F.lit(runs)))
    totals = cut.groupBy("source", "run").agg(F.sum("size").alias("n"))
    prior = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "run").orderBy(*kept).rowsBetween(Window.unboundedPreceding, -1)
    at = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r"))).where("size > 0")
    at = at.withColumn("start", F.col("offset") + F.col("inside")).join(planned.select(F.col("source").alias("p"), "rank"), F.col("source").eqNullSafe(F.col("p")))
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    cuts = at.select(*kept, "rank", "start", F.explode(blocks).alias("block"))
    low = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    return cuts.select(*kept, "rank", "block", low.alias("first_word"), (high - low).alias("n_words"))


def taken(docs: DataFrame, block_words: int = 64, shards: int = 64, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; the least and the greatest output shard that takes words of it."""
    sized = checkpoint(sizes(docs).select(F.monotonically_increasing_id().alias("row"), "*"))
    planned = checkpoint(plan(sized, block_words))
    times = slots(planned, shards, seed).groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    cut = pieces(sized.select("row", "source", "size"), planned, block_words)
    got = cut.hint("merge").join(times, ["rank", "block"])  # both grow with the input; estimates of exploded rows are far too low
    got = got.groupBy("row").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard"))
    per_source = planned.select(F.col("source").alias("s"), "source_size", "target")
    rows = sized.hint("merge").join(got, "row", "left").join(per_source, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard", "last_shard")


def mix(docs: DataFrame, block_words: int = 2048, shards: int = 64, seed: int = 0, shard: str | None = None) -> DataFrame:
    """The mixed corpus: the documents' columns, a row per slot and document piece; its output shard if a name for that is given.

    A document that lies whole in a block keeps its text as it is; the pieces of
    one that crosses blocks are its words joined by single spaces.  Rows meet
    their pieces again by two 64-bit hashes of all their columns (maps apart),
    so rows that are equal share one text and each keeps its own pieces.
    """
    k1, k2, cuts, cut = fresh(docs, "__k1", "__k2", "__cuts", "__cut")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).cast("long")
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    own = [F.xxhash64(*[F.col(quoted(c)) for c in hashed]), F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in hashed], F.lit(1))]
    sized = checkpoint(docs.select(own[0].alias("row"), own[1].alias("row2"), "source", n_words.alias("size")))
    planned = checkpoint(plan(sized, block_words))
    got = pieces(sized, planned, block_words).hint("merge").join(slots(planned, shards, seed), ["rank", "block"])
    got = got.groupBy("row", "row2", "size", "first_word", "n_words", "shard").agg(F.count("*").alias("times"))
    got = got.groupBy(F.col("row").alias(k1), F.col("row2").alias(k2)).agg(F.collect_list(F.struct("size", "first_word", "n_words", "shard", "times")).alias(cuts))
    once = docs.withColumn(k1, own[0]).withColumn(k2, own[1]).dropDuplicates([k1, k2])
    met = once.join(got, [k1, k2]).withColumn(cut, F.explode(cuts))
    words = F.regexp_extract_all("text", F.lit(WORD_REGEX), F.lit(0))
    c = F.col(cut)
    part = F.array_join(F.slice(words, (c["first_word"] + 1).cast("int"), c["n_words"].cast("int")), " ")
    text = F.when(c["size"] == c["n_words"], F.col("text")).otherwise(part).alias("text")
    out = [text if n == "text" else F.col(quoted(n)) for n in docs.columns] + ([c["shard"].alias(shard)] if shard else [])
    return met.withColumn(cuts, F.explode(F.sequence(F.lit(1), c["times"].cast("int")))).select(*out)
