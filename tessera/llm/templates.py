"""Line dedup by a tree of log templates, in DataFrame functions only.

A line descends a tree of fixed depth: its count of tokens, then its leading
tokens, where a token that holds a digit counts as a field.  In the leaves that
recur, the other fields are generalised: a token stays constant where the leaf
holds it at that place in enough lines of several documents, else it is a
field.  Lines of one leaf with the same constants are one template; it must
keep at least half of its tokens.  Templates that recur across documents are
dropped, all lines of them.

Recurring means at least ``min_lines`` lines of at least two documents; both are
sums and extremes, which pre-aggregate, so a line in a third of all documents
is a row per task.  The counts are joined back on the key's complement: that gives
them a shuffle of their own, without which adaptive execution can't split the
lines of one hot template or place over tasks.

Rows are told apart by a hash of doc_id and text.  Equal rows are one document:
they count once and are judged alike.  A null doc_id is an id like others.
Blank lines are no lines.  Null texts have none.  An empty table gives no rows.
Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, quoted

LEADING = 3


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _trimmed(c: Column | str) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\f\x0b"))


def _once(docs: DataFrame) -> DataFrame:
    """row and text of the distinct rows; texts are shuffled only if there are equal ones."""
    rows = docs.select(_row().alias("row"), "text")
    again = rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1")
    return rows.dropDuplicates(["row"]) if again.head(1) else rows


def lines(rows: DataFrame) -> DataFrame:
    """row, line (number from 0), n, leaf and the tokens of every line that is not blank."""
    each = rows.select("row", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    split = each.where(_trimmed("raw") != "").select("row", "line", F.split(_trimmed("raw"), "[ \\t\\r\\f\\x0B]+").alias("t"))
    token = lambda i: F.get("t", F.lit(i))
    lead = [F.coalesce(F.when(F.translate(token(i), "0123456789", "") != token(i), F.lit("<*>")).otherwise(token(i)), F.lit("")) for i in range(LEADING)]
    return split.select("row", "line", F.size("t").alias("n"), F.xxhash64(F.size("t"), *lead).alias("leaf"), "t")


def _recurs(min_lines: int) -> Column:
    return (F.col("lines") >= min_lines) & (F.col("low") != F.col("high"))


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("lines"), F.min("row").alias("low"), F.max("row").alias("high"))


def recurring(docs: DataFrame, min_lines: int = 3, share: float = 0.5) -> DataFrame:
    """row and line of every line whose template recurs."""
    every = lines(_once(docs))
    leaves = checkpoint(_counted(every.select("row", "leaf"), "leaf").where(_recurs(min_lines)).select(F.col("leaf").alias("l")))
    hashes = F.transform("t", lambda x: F.hash(x))
    held = every.select("row", "line", "n", "leaf", hashes.alias("h")).join(leaves, F.col("leaf") == F.col("l")).drop("l")
    tokens = held.select("row", "line", "n", "leaf", F.posexplode("h").alias("at", "token")).withColumn("place", F.xxhash64("leaf", "at", "token")).select("row", "line", "n", "leaf", "place")
    tokens = checkpoint(tokens)
    fixed = _counted(tokens.select("row", "place"), "place").where(_recurs(min_lines)).select(F.bitwise_not("place").alias("p"))
    constant = tokens.join(fixed, F.bitwise_not("place") == F.col("p"))
    # the combined hashes of (leaf, place, token) are the template: they hold the constants and where they stand
    shaped = constant.groupBy("row", "line", "n", "leaf").agg(F.bit_xor("place").alias("template"), F.count("*").alias("kept")).where(F.col("kept") >= share * F.col("n"))
    shaped = shaped.withColumn("template", F.xxhash64("leaf", "template", "kept"))
    good = _counted(shaped, "template").where(_recurs(min_lines)).select(F.bitwise_not("template").alias("g"))
    return shaped.join(good, F.bitwise_not("template") == F.col("g")).select("row", "line")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (line numbers) of every document."""
    gone = recurring(docs, **options).groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    n = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: _trimmed(x) != "")), F.lit(0))
    base = docs.select("doc_id", F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), _row().alias("row"))
    out = base.join(gone, F.col("row") == F.col("r"), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without the lines whose template recurs."""
    row, r, lost = fresh(docs, "__row", "__r", "__gone")
    gone = recurring(docs, **options).groupBy(F.col("row").alias(r)).agg(F.collect_set("line").alias(lost))
    met = docs.withColumn(row, _row()).join(gone, F.col(row) == F.col(r), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(lost, i)), "\n")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept).alias("text")
    return met.select(*[text if c == "text" else F.col(quoted(c)) for c in docs.columns])
