"""A DataFrame with a schema: sources, sinks, row shuffles and batches."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ColumnSchema, Schema


class Shuffle(Enum):
    PER_PARTITION = "partition"  # rows mix within what a task holds
    PER_WORKER = "worker"  # rows mix across the whole dataset


class Dataset:
    """From a DataFrame, paths (Parquet, CSV, ORC or JSON; files, folders, globs), pandas or Arrow tables.

    names gives the columns of a CSV file without header.  npartitions is
    honoured; sizes of parts are left to Spark (spark.sql.files.maxPartitionBytes),
    which a warning says where they are given.  Files must agree in schema;
    check_schema reads all of them for that and raises where one differs.
    derived adds columns by SQL expressions of the others; they must be
    deterministic, as a workflow works them out where it uses them.
    """

    def __init__(self, source: object, engine: str | None = None, schema: Schema | None = None, names: list[str] | None = None, npartitions: int | None = None, part_size: object = None, part_mem_fraction: float | None = None, row_groups_per_part: int | None = None, storage_options: dict | None = None, cpu: bool = True, base_dataset: Dataset | None = None, check_schema: bool = False, derived: dict[str, str] | None = None, **options) -> None:
        self.base_dataset = base_dataset or self
        given = [n for n, v in (("part_size", part_size), ("part_mem_fraction", part_mem_fraction), ("row_groups_per_part", row_groups_per_part)) if v is not None]
        if given:
            warnings.warn(f"{', '.join(given)}: set spark.sql.files.maxPartitionBytes, or give npartitions", stacklevel=2)
        df = self._read(source, engine, names, {**options, **(storage_options or {})})
        if check_schema and not isinstance(source, (DataFrame, pd.DataFrame, pa.Table)):
            self._agree(df, source, engine, options)
        if npartitions:
            df = df.repartition(npartitions)
        if schema is not None:
            df = df.select(*[F.col(f"`{c}`").alias(c, metadata=schema[c].metadata()) if c in schema else F.col(f"`{c}`") for c in df.columns])
        if set(derived or {}) & set(df.columns):
            raise ValueError("a derived column has the name of another")
        self.stored, self.derived = df, {n: F.expr(x) for n, x in (derived or {}).items()}
        self.df = df.select("*", *[c.alias(n) for n, c in self.derived.items()]) if derived else df
        self.cpu = True

    @staticmethod
    def _read(source: object, engine: str | None, names: list[str] | None, options: dict) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        spark = SparkSession.active()
        if isinstance(source, (pd.DataFrame, pa.Table)):
            return spark.createDataFrame(source)
        paths = [source] if isinstance(source, str) else [str(p) for p in source]
        kind = engine or next((k for k in ("csv", "orc", "json") if paths[0].rstrip("/*").endswith(k)), "parquet")
        reader = spark.read.options(**options)
        if kind in ("csv", "csv-no-header"):
            given = options.get("schema")
            reader = reader.schema(given) if given else reader.option("inferSchema", True)
            df = reader.option("header", names is None and kind == "csv").csv(paths)
            return df.toDF(*names) if names else df
        return reader.format(kind).load(paths)

    @staticmethod
    def _agree(df: DataFrame, source: object, engine: str | None, options: dict) -> None:
        """Raises ValueError unless all files have the columns and types of df."""
        paths = [source] if isinstance(source, str) else [str(p) for p in source]
        try:
            whole = df.sparkSession.read.options(**options).option("mergeSchema", True).format(engine or "parquet").load(paths)
        except Exception as e:
            raise ValueError(f"the files differ in the type of a column: {e}") from e
        kinds = lambda d: {f.name: f.dataType for f in d.schema.fields}
        one = [kinds(df.sparkSession.read.options(**options).format(engine or "parquet").load(p)) for p in paths]
        if any(k != kinds(whole) for k in [kinds(df), *one]):
            raise ValueError(f"the files differ in their columns; together they have {list(kinds(whole))}")

    @property
    def schema(self) -> Schema:
        return Schema.of(self.df.schema)

    def infer_schema(self) -> Schema:
        return self.schema

    @property
    def num_rows(self) -> int:
        return self.df.count()

    @property
    def npartitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def to_ddf(self, columns: Iterable[str] | None = None) -> DataFrame:
        return self.df.select(*columns) if columns else self.df

    def compute(self) -> pd.DataFrame:
        return self.df.toPandas()

    def head(self, n: int = 5) -> pd.DataFrame:
        return self.df.limit(n).toPandas()

    def to_cpu(self) -> Dataset:
        return self

    to_gpu = to_cpu

    def shuffle_by_keys(self, keys: list[str]) -> Dataset:
        return Dataset(self.df.repartition(*keys), base_dataset=self)

    def repartition(self, npartitions: int) -> Dataset:
        return Dataset(self.df.repartition(npartitions), base_dataset=self)

    @classmethod
    def merge(cls, left: Dataset, right: Dataset, **options) -> Dataset:
        return cls(left.df.join(right.df, **options))

    def to_iter(self, columns: Iterable[str] | None = None, batch_rows: int = 10_000) -> Iterator[pd.DataFrame]:
        """pandas frames, a partition at a time on the driver."""
        held: list = []
        df = self.to_ddf(columns)
        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == batch_rows:
                yield pd.DataFrame(held, columns=df.columns)
                held = []
        if held:
            yield pd.DataFrame(held, columns=df.columns)

    def _shuffled(self, shuffle: Shuffle | str | bool | None, files: int | None, seed: int) -> DataFrame:
        df = self.df
        if shuffle in (Shuffle.PER_WORKER, "PER_WORKER", True):
            df = df.repartition(files, F.rand(seed)) if files else df.repartition(F.rand(seed))
        elif files:
            df = df.repartition(files)
        return df.sortWithinPartitions(F.rand(seed + 1)) if shuffle else df

    def to_parquet(self, output_path: str, shuffle: Shuffle | str | bool | None = None, out_files_per_proc: int | None = None, output_files: int | None = None, num_threads: int | None = None, dtypes: dict[str, str] | None = None, cats: list[str] | None = None, conts: list[str] | None = None, labels: list[str] | None = None, partition_on: list[str] | None = None, seed: int = 0, mode: str = "overwrite") -> None:
        """Parquet files; column roles become tags and travel in the files' schema."""
        roles = [(cats, "categorical"), (conts, "continuous"), (labels, "target")]
        cols = []
        for f in self.df.schema.fields:
            c = Schema.of(type(self.df.schema)([f]))[f.name].with_tags([tag for names, tag in roles if f.name in (names or [])])
            x = F.col(f"`{f.name}`")
            cols.append((x.cast(dtypes[f.name]) if f.name in (dtypes or {}) else x).alias(f.name, metadata=c.metadata()))
        out = self._shuffled(shuffle, output_files or out_files_per_proc, seed).select(*cols).write.mode(mode)
        (out.partitionBy(*partition_on) if partition_on else out).parquet(output_path)

    def to_csv(self, output_path: str, mode: str = "overwrite") -> None:
        self.df.write.mode(mode).option("header", True).csv(output_path)

    def to_npy(self, path: str, max_rows: int = 10_000_000) -> np.ndarray:
        """Ids and vectors (or plain columns) side by side as one matrix; a table of more than max_rows is refused, as it comes to the driver."""
        got = self.df.limit(max_rows + 1).toArrow()
        if got.num_rows > max_rows:
            raise ValueError(f"more than {max_rows} rows")
        parts = []
        for c in got.columns:
            c = c.combine_chunks()
            nested = pa.types.is_list(c.type)
            flat = (c.flatten() if nested else c).to_numpy(zero_copy_only=False).astype(np.float64)
            parts.append(flat.reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 0)))
        out = np.concatenate(parts, 1) if parts else np.zeros((0, 0))
        np.save(path, out)
        return out


def flatten_lists(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Fixed-length list columns as c_0 .. c_n (a plain c for length 1); ragged ones stay.

    Lengths are found in one pass where they are not given.
    """
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    if sizes is None and lists:
        got = df.agg(*[f(F.size(c)).alias(f"{k}{c}") for c in lists for k, f in (("a", F.min), ("b", F.max))]).first()
        sizes = {c: got[f"a{c}"] for c in lists if got[f"a{c}"] == got[f"b{c}"] and got[f"a{c}"]}
    cols = []
    for c in df.columns:
        n = (sizes or {}).get(c)
        cols += [F.col(c)] if c not in lists or not n else [F.get(c, F.lit(i)).alias(c if n == 1 else f"{c}_{i}") for i in range(n)]
    return df.select(*cols)


def augment_schema(schema: Schema, cats: Iterable[str] = (), conts: Iterable[str] = (), labels: Iterable[str] = (), padded: dict[str, int] | None = None) -> Schema:
    """Tags for the columns' roles, and the lengths that lists are padded to."""
    cats, conts, labels = set(cats), set(conts), set(labels)

    def one(c: ColumnSchema) -> ColumnSchema:
        c = c.with_tags([t for names, t in ((cats, "categorical"), (conts, "continuous"), (labels, "target")) if c.name in names])
        return c.with_properties({"value_count": {"min": padded[c.name], "max": padded[c.name]}}) if c.name in (padded or {}) else c

    return Schema(map(one, schema))
