"""Synthetic datasets: every column is an expression over a range of row numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class UniformDistro:
    def column(self, u: Column, low: float, high: float) -> Column:
        return F.lit(low) + u * (high - low)

    def cdf(self, x: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip((x - low) / (high - low), 0, 1)

    def verify(self, sample: np.ndarray, low: float, high: float) -> float:
        """1 minus the Kolmogorov-Smirnov distance of a sample."""
        x = np.sort(np.asarray(sample, float))
        c, n = self.cdf(x, low, high), len(x)
        return 1 - max(np.abs(c - np.arange(n) / n).max(), np.abs(c - np.arange(1, n + 1) / n).max())


class PowerLawDistro(UniformDistro):
    """Density x^-alpha between low and high."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def column(self, u: Column, low: float, high: float) -> Column:
        g = 1 - self.alpha
        a, b = max(low, 1e-9) ** g, high**g
        return F.pow(u * (b - a) + a, F.lit(1 / g))

    def cdf(self, x: np.ndarray, low: float, high: float) -> np.ndarray:
        g = 1 - self.alpha
        a, b = max(low, 1e-9) ** g, high**g
        return np.clip((np.maximum(x, 1e-9) ** g - a) / (b - a), 0, 1)


@dataclass
class ContCol:
    name: str
    dtype: str = "float"
    min_val: float = 0.0
    max_val: float = 1.0
    mean: float | None = None
    std: float | None = None
    per_nan: float = 0.0
    width: int = 1
    distro: UniformDistro | None = None


@dataclass
class LabelCol(ContCol):
    dtype: str = "int"
    max_val: float = 1.0


@dataclass
class CatCol:
    name: str
    dtype: str = "bigint"
    cardinality: int = 100
    min_entry_size: int | None = None
    max_entry_size: int | None = None
    avg_entry_size: int | None = None
    per_nan: float = 0.0
    multi_min: int | None = None
    multi_max: int | None = None
    multi_avg: int | None = None
    width: int = 1
    distro: UniformDistro | None = None


@dataclass
class DatasetGen:
    """distribution for columns that name none; gen(rows, columns) gives the DataFrame."""

    distribution: UniformDistro = field(default_factory=UniformDistro)
    seed: int = 0

    def create_df(self, spark: SparkSession, size: int, schema: dict[str, list], partitions: int | None = None) -> DataFrame:
        cols, k = [], 0
        for group in ("conts", "cats", "labels"):
            for c in schema.get(group, []):
                for w in range(c.width):
                    k += 1
                    name = c.name if c.width == 1 else f"{c.name}_{w}"
                    x = self._cat(c, k) if isinstance(c, CatCol) else self._cont(c, k)
                    if c.per_nan:
                        x = F.when(F.rand(self.seed * 7919 + k + 500_000) >= c.per_nan / 100, x)
                    cols.append(x.alias(name))
        rows = spark.range(0, size, 1, partitions) if partitions else spark.range(size)
        return rows.select(*cols)

    def _cont(self, c: ContCol, k: int) -> Column:
        seed = self.seed * 7919 + k
        if c.mean is not None and c.std is not None:
            return (F.randn(seed) * c.std + c.mean).cast(c.dtype)
        d = c.distro or self.distribution
        if c.dtype in ("int", "bigint", "smallint", "tinyint"):
            return F.least(F.floor(d.column(F.rand(seed), c.min_val + isinstance(d, PowerLawDistro), c.max_val + 1)), F.lit(int(c.max_val))).cast(c.dtype)
        return d.column(F.rand(seed), c.min_val, c.max_val).cast(c.dtype)

    def _id(self, c: CatCol, u: Column) -> Column:
        d = c.distro or self.distribution
        return F.least(F.floor(d.column(u, 1, c.cardinality + 1)), F.lit(c.cardinality)).cast("bigint") - 1

    def _cat(self, c: CatCol, k: int) -> Column:
        seed = self.seed * 7919 + k
        if c.multi_max:
            # element i of row r is a hash of both, so a list needs no random state
            n = (F.lit(c.multi_min or 1) + F.floor(F.rand(seed) * (c.multi_max - (c.multi_min or 1) + 1))).cast("int")
            u = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 50)) / float(1 << 50)
            return F.transform(F.sequence(F.lit(1), n), lambda i: self._entry(c, self._id(c, u(i))))
        return self._entry(c, self._id(c, F.rand(seed)))

    def _entry(self, c: CatCol, x: Column) -> Column:
        if c.min_entry_size is None and c.dtype != "string":
            return x.cast(c.dtype)
        low, high = c.min_entry_size or 1, c.max_entry_size or c.min_entry_size or 10
        size = F.lit(low) + F.pmod(F.hash(x), F.lit(high - low + 1))
        return F.substring(F.concat(x.cast("string"), F.lit("_"), F.md5(x.cast("string").cast("binary")), F.md5(F.concat(x.cast("string"), F.lit("+")).cast("binary"))), F.lit(1), F.greatest(size, F.length(x.cast("string"))))


def columns_from_schema(spec: dict[str, dict[str, dict]]) -> dict[str, list]:
    """Columns from a dict (or an inspector's output): conts, cats and labels by name."""
    kinds = {"conts": ContCol, "cats": CatCol, "labels": LabelCol}
    rename = {"min": "min_val", "max": "max_val", "min_entry": "min_entry_size", "max_entry": "max_entry_size"}
    out: dict[str, list] = {}
    for group, kind in kinds.items():
        fields = set(kind.__dataclass_fields__)
        out[group] = [kind(name, **{rename.get(k, k): v for k, v in s.items() if rename.get(k, k) in fields and v is not None}) for name, s in spec.get(group, {}).items()]
    return out
