"""Categorify: frequency-ranked integer encoding.

Ids: 0 padding (never given), 1 null, then the out-of-vocabulary buckets, then
the vocabulary by falling frequency, ties by key, nulls first.
"""

from __future__ import annotations

import warnings
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..schema import ColumnSchema, Schema, Tags
from ..session import checkpointed, shared_dir
from .base import Cols, Entries, StatOperator, col, present
from .rel import lookup, measured, row_bytes
from .row import embedding_size, hashed

#: Above so many keys, positions come from a distributed sort instead of one window.
WINDOW_ROWS = 1_000_000
#: List columns are encoded through a map up to so many keys, above by explode and join.
MAP_ROWS = 256


def positions(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Adds ``position`` from 0 in the given order, which must be total."""
    if rows <= WINDOW_ROWS:
        return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id is the partition number in its high bits and the row's place in the low ones
    placed = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    table = df.sparkSession.createDataFrame(offsets, "p long, o long")
    return placed.join(F.broadcast(table), part == F.col("p")).withColumn("position", F.col("o") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "p", "o")


def _leaf(dtype: str | None) -> str | None:
    return dtype[6:-1] if dtype and dtype.startswith("array<") else dtype


def _cell(group: int, value: Column) -> Column:
    return F.struct(F.lit(group).alias("g"), value.alias("k0"))


def _cells(group: int, values: Column, leaf: str) -> Column:
    return F.transform(values, lambda x: _cell(group, present(x, leaf)))


class Categorify(StatOperator):
    output_tags = (Tags.CATEGORICAL,)

    def __init__(self, freq_threshold: int | dict = 0, out_path: str | None = None, cat_cache: object = "host", dtype: str | None = None, on_host: bool = True, encode_type: str = "joint", name_sep: str = "_", search_sorted: bool = False, num_buckets: int | dict | None = None, vocabs: object = None, max_size: int | dict = 0, single_table: bool = False, cardinality_memory_limit: object = None, tree_width: object = None, split_out: int = 1, split_every: int = 8, hash_method: str = "xxhash64", **kwargs) -> None:
        for k in kwargs:
            raise ValueError(f"{'no longer supported' if k in ('start_index', 'na_sentinel') else 'unknown'}: {k}")
        if encode_type not in ("joint", "combo"):
            raise ValueError("encode_type must be joint or combo")
        if encode_type == "combo" and vocabs is not None:
            raise ValueError("vocabs cannot be given for combo encoding")
        if freq_threshold and max_size:
            raise ValueError("freq_threshold and max_size exclude each other")
        if search_sorted and freq_threshold:
            raise ValueError("search_sorted and freq_threshold exclude each other")
        if num_buckets == 0:
            raise ValueError("num_buckets must be positive")
        if num_buckets and not max_size and not freq_threshold:
            warnings.warn("num_buckets without max_size or freq_threshold: only unseen values are hashed", stacklevel=2)
        if tree_width is not None:
            warnings.warn("tree_width is ignored; aggregation is left to Spark", FutureWarning, stacklevel=2)
        self.freq_threshold, self.out_path, self.dtype, self.encode_type, self.name_sep = freq_threshold, out_path, dtype, encode_type, name_sep
        self.num_buckets, self.max_size, self.single_table, self.hash_method = num_buckets, max_size, single_table, hash_method
        self.vocabs = vocabs
        self.output_dtype = dtype or "bigint"
        self.vocabularies: dict[str, DataFrame] = {}
        self.metas: dict[str, dict] = {}
        self.shift: dict[str, int] = {}

    # groups

    def groups(self, entries: Entries) -> dict[str, tuple[str, ...]]:
        """Storage name to member columns."""
        out = {(e if isinstance(e, str) else self.name_sep.join(e)): ((e,) if isinstance(e, str) else tuple(e)) for e in entries}
        if self.encode_type == "joint":
            members = [c for g in out.values() for c in g]
            if len(members) != len(set(members)):
                raise ValueError("a column cannot be in two joint groups")
        return out

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        groups = self.groups(entries)
        if self.encode_type == "combo":
            return {name: list(members) for name, members in groups.items()}
        return {c: [c] for members in groups.values() for c in members}

    def _home(self, entries: Entries, column: str) -> str:
        return next(name for name, members in self.groups(entries).items() if column in members or column == name)

    def _option(self, option: int | dict | None, name: str, members: tuple[str, ...]) -> int:
        if isinstance(option, dict):
            return next((option[k] for k in (name, *members) if k in option), 0)
        return option or 0

    def _buckets(self, name: str, members: tuple[str, ...]) -> int:
        return self._option(self.num_buckets, name, members) or 1

    # fitting

    def fit(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema) -> None:
        """Counts all single columns of a type in one scan, and numbers their small vocabularies in one job."""
        groups = self.groups(entries)
        given = {n: t for n, m in groups.items() if (t := self._given(df, n, m)) is not None}
        combos = [n for n, m in groups.items() if n not in given and self.encode_type == "combo" and len(m) > 1]
        for name, members in groups.items():
            limit, b = self._option(self.max_size, name, members), self._buckets(name, members)
            if limit and limit < b + 2:
                raise ValueError(f"max_size must leave room for null and {b} out-of-vocabulary ids")
        by_type: dict[tuple, list[str]] = {}
        for name, members in groups.items():
            if name not in given and name not in combos:
                by_type.setdefault(tuple(sorted({_leaf(schema[m].dtype) for m in members})), []).append(name)
        for name, table in given.items():
            b = self._buckets(name, groups[name])
            kept = table.select("k0", F.lit(None).cast("long").alias("size"), (F.col("position") + 2 + b).cast("long").alias("label"))
            self._keep(name, groups[name], self._stored(kept, name), 1, {"null_size": None, "oov_size": None})
        for name in combos:
            keys = [f"k{i}" for i in range(len(groups[name]))]
            counted = checkpointed(self._combination(df, groups[name], keys, cols, schema).groupBy(*keys).agg(F.count("*").alias("size")))
            known = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(1)) for k in keys]).isNotNull()
            null, total, n = counted.agg(F.sum(F.when(~known, F.col("size"))), F.sum(F.when(known, F.col("size"))), F.count(F.when(known, F.lit(1)))).first()
            self._number(name, groups[name], counted.where(known), keys, n, null or 0, total or 0)
        for names in by_type.values():
            self._fit_together(df, names, groups, cols, schema)
        start = 0
        for name in groups:
            self.shift[name] = start if self.single_table else 0
            start += self.metas[name]["rows"]
        self.fitted = True

    def _fit_together(self, df: DataFrame, names: list[str], groups: dict, cols: Cols, schema: Schema) -> None:
        """The groups of one key type: one scan that counts (group, value)."""
        scalars, lists = [], []
        for g, name in enumerate(names):
            for m in groups[name]:
                if schema[m].is_list:
                    lists.append(_cells(g, cols[m], schema[m].dtype[6:-1]))
                else:
                    scalars.append(_cell(g, present(cols[m], schema[m].dtype)))
        arrays = ([F.array(*scalars)] if scalars else []) + lists
        if len(scalars) == 1 and not lists:
            source = df.select(scalars[0].alias("c"))
        elif len(arrays) == 1:
            source = df.select(F.explode(arrays[0]).alias("c"))
        else:
            source = df.select(F.explode(F.flatten(F.filter(F.array(*arrays), lambda x: x.isNotNull()))).alias("c"))
        counted = checkpointed(source.groupBy("c.g", "c.k0").agg(F.count("*").alias("size")))
        known = F.col("k0").isNotNull()
        stats = {r.g: r for r in counted.groupBy("g").agg(F.sum(F.when(~known, F.col("size"))).alias("null"), F.sum(F.when(known, F.col("size"))).alias("total"), F.count(F.when(known, F.lit(1))).alias("n")).collect()}
        small = []
        for g, name in enumerate(names):
            null, total, n = (stats[g].null or 0, stats[g].total or 0, stats[g].n) if g in stats else (0, 0, 0)
            if n <= WINDOW_ROWS and not self.out_path:
                small.append((g, name, null, total))
            else:
                self._number(name, groups[name], counted.where(known & (F.col("g") == g)).select("k0", "size"), ["k0"], n, null, total)
        if not small:
            return
        option = lambda f, none: F.element_at(F.create_map(*[x for g, name, _, _ in small for x in (F.lit(g), F.lit(f(name) or none).cast("long"))]), F.col("g"))
        rest = counted.where(known & F.col("g").isin([g for g, *_ in small])).where(F.col("size") >= option(lambda n: self._option(self.freq_threshold, n, groups[n]), 0))
        place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("size"), F.asc("k0"))).cast("long") - 1
        room = lambda n: self._option(self.max_size, n, groups[n]) and self._option(self.max_size, n, groups[n]) - 2 - self._buckets(n, groups[n])
        placed = rest.withColumn("position", place)
        limited = placed.where(F.col("position") < option(lambda n: None if not self._option(self.max_size, n, groups[n]) else room(n) or -1, 1 << 62))
        labelled = limited.select("g", "k0", "size", (F.col("position") + 2 + option(lambda n: self._buckets(n, groups[n]), 1)).alias("label"))
        # a folder for each group, so that a lookup reads its own keys only
        path = f"{shared_dir(df.sparkSession)}/vocabularies-{uuid4().hex}"
        kinds = StructType([StructField("k0", labelled.schema["k0"].dataType), StructField("size", LongType()), StructField("label", LongType())])
        labelled.repartition("g").write.partitionBy("g").parquet(path)
        read = df.sparkSession.read
        every = read.schema(StructType([*kinds.fields, StructField("g", IntegerType())])).parquet(path)
        sums = {r.g: r for r in every.groupBy("g").agg(F.count("*").alias("rows"), F.sum("size").alias("seen"), F.sum(row_bytes(every.drop("g"))).alias("bytes")).collect()}
        for g, name, null, total in small:
            got = sums.get(g)
            table = read.schema(kinds).parquet(f"{path}/g={g}") if got else df.sparkSession.createDataFrame([], kinds)
            rows, seen, size = (got.rows, got.seen, got.bytes) if got else (0, 0, 0)
            self._keep(name, groups[name], table, 1, {"null_size": null, "oov_size": total - seen, "unique_size": seen}, rows, size)

    def _combination(self, df: DataFrame, members: tuple[str, ...], keys: list[str], cols: Cols, schema: Schema) -> DataFrame:
        if sum(schema[m].is_list for m in members) > 1:
            raise ValueError("at most one list column can be in a combination")
        return df.select(*[(F.explode(cols[m]) if schema[m].is_list else present(cols[m], schema[m].dtype)).alias(k) for m, k in zip(members, keys, strict=True)])

    def _number(self, name: str, members: tuple[str, ...], table: DataFrame, keys: list[str], n: int, null: int, total: int) -> None:
        """The vocabulary of one group, of any size."""
        b, limit, least = self._buckets(name, members), self._option(self.max_size, name, members), self._option(self.freq_threshold, name, members)
        order = [F.desc("size"), *[F.asc_nulls_first(k) for k in keys]]
        kept = table.where(F.col("size") >= least) if least else table
        if limit:
            kept = kept.orderBy(*order).limit(limit - 2 - b)
        kept = positions(kept, order, min(n, limit) if limit else n)
        kept = kept.select(*keys, "size", (F.col("position") + 2 + b).cast("long").alias("label"))
        self._keep(name, members, self._stored(kept, name), len(keys), {"null_size": null, "total": total})

    def _keep(self, name: str, members: tuple[str, ...], table: DataFrame, keys: int, meta: dict, rows: int | None = None, size: int = 0) -> None:
        if rows is None:
            rows, size = measured(table)
        if "total" in meta:
            seen = table.agg(F.sum("size")).first()[0] or 0
            meta = {"null_size": meta["null_size"], "oov_size": meta["total"] - seen, "unique_size": seen}
        self.vocabularies[name] = table
        self.metas[name] = {"buckets": self._buckets(name, members), "rows": rows, "bytes": size, "keys": keys, "members": list(members), **meta}

    def _given(self, df: DataFrame, name: str, members: tuple[str, ...]) -> DataFrame | None:
        vocab = self.vocabs
        if isinstance(vocab, dict):
            vocab = next((vocab[k] for k in (name, *members) if k in vocab), None)
        if vocab is None:
            return None
        spark = df.sparkSession
        if isinstance(vocab, str):
            table = spark.read.parquet(vocab)
            key = next((c for c in (name, *members) if c in table.columns), table.columns[0])
            if "label" in table.columns:
                least = table.where(col(key).isNotNull()).agg(F.min("label")).first()[0] or 0
                return table.where(col(key).isNotNull()).select(col(key).alias("k0"), (F.col("label") - least).alias("position"))
            ordered = checkpointed(table.select(col(key).alias("k0"), F.monotonically_increasing_id().alias("at")).where("k0 is not null"))
            return positions(ordered, [F.col("at")], ordered.count()).drop("at")
        values = [v.item() if hasattr(v, "item") else v for v in vocab if v is not None and v == v]
        kind = dict(df.dtypes).get(members[0]) or None
        return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k0 {kind or ('string' if not values or isinstance(values[0], str) else 'bigint' if isinstance(values[0], int) else 'double')}, position long")

    def _stored(self, table: DataFrame, name: str) -> DataFrame:
        if not self.out_path:
            return checkpointed(table)
        path = f"{self.out_path}/categories/unique.{name}.parquet"
        table.write.mode("overwrite").parquet(path)
        return table.sparkSession.read.parquet(path)

    def vocabulary(self, name: str) -> DataFrame:
        """The keys of a group with their sizes and labels."""
        return self.vocabularies[name]

    def meta(self, spark, name: str) -> DataFrame:
        """kind, offset, num_indices and num_observed of padding, null, out-of-vocabulary and unique ids."""
        m = self.metas[name]
        rows = [("pad", 0, 1, 0), ("null", 1, 1, m["null_size"]), ("oov", 2, m["buckets"], m["oov_size"]), ("unique", 2 + m["buckets"], m["rows"], m.get("unique_size"))]
        return spark.createDataFrame(rows, "kind string, offset long, num_indices long, num_observed long")

    # transforming

    def _oov(self, parts: list[Column], b: int) -> Column:
        if b == 1:
            return F.lit(2).cast("long")
        h = hashed(parts[0], self.hash_method)
        for p in parts[1:]:
            h = h.bitwiseXOR(hashed(p, self.hash_method))
        return F.lit(2) + h % b

    def extend(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema, fitting: bool = False) -> tuple[DataFrame, Cols]:
        self.need_fit()
        out: Cols = {}
        k = 0
        for name, members in self.groups(entries).items():
            m, table = self.metas[name], self.vocabularies[name]
            b, shift = m["buckets"], self.shift.get(name, 0)
            label = lambda c, shift=shift: c + shift if shift else c
            if m["keys"] > 1:
                k += 1
                tag = f"__cat{id(self)}_{k}"
                parts = [present(cols[x], schema[x].dtype) for x in members]
                right = table.select(*[F.col(f"k{i}").alias(f"{tag}{i}") for i in range(m["keys"])], F.col("label").alias(f"{tag}l"))
                on, none = F.lit(True), F.lit(True)
                for i, p in enumerate(parts):
                    on, none = on & p.eqNullSafe(F.col(f"{tag}{i}")), none & p.isNull()
                df = df.join(lookup(right, m["bytes"], self.room), on, "left")
                filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
                out[name] = F.when(none, F.lit(1)).otherwise(F.coalesce(label(F.col(f"{tag}l")), self._oov(filled, b)))
                continue
            for x in members:
                k += 1
                target, tag = name if self.encode_type == "combo" else x, f"__cat{id(self)}_{k}"
                if schema[x].is_list:
                    df, out[target] = self._list(df, tag, cols[x], schema[x].dtype[6:-1], table, m, b, label)
                    continue
                c = present(cols[x], schema[x].dtype)
                right = table.select(F.col("k0").alias(f"{tag}k"), F.col("label").alias(f"{tag}l"))
                df = df.join(lookup(right, m["bytes"], self.room), c == F.col(f"{tag}k"), "left")
                out[target] = F.when(c.isNull(), F.lit(1)).otherwise(F.coalesce(label(F.col(f"{tag}l")), self._oov([c], b)))
        lists = {x for members in self.groups(entries).values() for x in members if schema[x].is_list}
        return df, {n: c if set(self.column_mapping(entries)[n]) & lists else c.cast(self.output_dtype) for n, c in out.items()}

    def _list(self, df: DataFrame, tag: str, c: Column, leaf: str, table: DataFrame, m: dict, b: int, label) -> tuple[DataFrame, Column]:
        def encoded(x: Column, found: Column) -> Column:
            return F.when(x.isNull(), F.lit(1).cast("long")).otherwise(F.coalesce(label(found), self._oov([x], b))).cast(self.output_dtype)

        if m["rows"] <= MAP_ROWS:
            one = table.agg(F.map_from_entries(F.collect_list(F.struct("k0", "label"))).alias(f"{tag}m"))
            df = df.crossJoin(F.broadcast(one))  # one row, of at most MAP_ROWS entries
            return df, F.transform(c, lambda x: encoded(present(x, leaf), F.try_element_at(F.col(f"{tag}m"), present(x, leaf))))
        rows = checkpointed(df.withColumn(f"{tag}id", F.monotonically_increasing_id()))
        each = rows.select(f"{tag}id", F.posexplode(c).alias(f"{tag}p", f"{tag}x")).withColumn(f"{tag}x", present(F.col(f"{tag}x"), leaf))
        met = each.join(lookup(table.select(F.col("k0").alias(f"{tag}k"), F.col("label").alias(f"{tag}l")), m["bytes"], self.room), F.col(f"{tag}x") == F.col(f"{tag}k"), "left")
        listed = met.groupBy(F.col(f"{tag}id").alias(f"{tag}r")).agg(F.transform(F.array_sort(F.collect_list(F.struct(f"{tag}p", encoded(F.col(f"{tag}x"), F.col(f"{tag}l")).alias("v")))), lambda s: s["v"]).alias(f"{tag}v"))
        df = rows.join(listed, F.col(f"{tag}id") == F.col(f"{tag}r"), "left")
        return df, F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(F.col(f"{tag}v"), F.array().cast(f"array<{self.output_dtype}>")))

    # schema

    def cardinality(self, name: str) -> int:
        m = self.metas[name]
        return 2 + m["rows"] + m["buckets"] + self.shift.get(name, 0)

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        out = []
        for name, sources in self.column_mapping(entries).items():
            home = self._home(entries, name)
            base = schema[sources[0]] if len(sources) == 1 and sources[0] in schema else ColumnSchema(name)
            props: dict = {}
            if home in self.metas:
                n = self.cardinality(home)
                props = {"domain": {"min": 0, "max": n - 1, "name": home}, "embedding_sizes": dict(zip(("cardinality", "dimension"), embedding_size(n), strict=True)), "num_buckets": self._option(self.num_buckets, home, tuple(sources)) or None, "freq_threshold": self._option(self.freq_threshold, home, tuple(sources)), "max_size": self._option(self.max_size, home, tuple(sources)), "cat_path": f"{self.out_path}/categories/unique.{home}.parquet" if self.out_path else None}
            out.append(base.with_name(name).with_dtype(f"array<{self.output_dtype}>" if base.is_list else self.output_dtype).with_tags(self.output_tags).with_properties(props))
        return Schema(out)

    def get_embedding_sizes(self, columns: list[str]) -> dict[str, tuple[int, int]]:
        return {c: embedding_size(self.cardinality(next(n for n, m in self.metas.items() if c == n or c in m["members"]))) for c in columns}

    def clear(self) -> None:
        self.vocabularies, self.metas, self.shift, self.fitted = {}, {}, {}, False

    def params(self) -> dict:
        return {k: getattr(self, k) for k in ("freq_threshold", "out_path", "dtype", "encode_type", "name_sep", "num_buckets", "max_size", "single_table", "hash_method")}

    def state(self) -> dict:
        return {"metas": self.metas, "shift": self.shift}

    def load_state(self, state: dict) -> None:
        self.metas, self.shift = state["metas"], state["shift"]

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.vocabularies)

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        self.vocabularies = dict(tables)


def get_embedding_sizes(source: object, output_dtypes: dict | None = None):
    """Embedding sizes of a workflow's or node's categorical outputs; with ragged lists, (single-hot, multi-hot)."""
    schema = source.output_schema
    single, multi = {}, {}
    for c in schema:
        size = c.properties.get("embedding_sizes")
        if size:
            (multi if c.is_list else single)[c.name] = (size["cardinality"], size["dimension"])
    return (single, multi) if multi else single
