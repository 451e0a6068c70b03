"""Row-wise operators: each is an expression, and a chain of them one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ColumnSchema, Schema, Tags
from .base import Cols, Entries, Operator, elementwise, flat, from_path, missing, to_path


class Clip(Operator):
    """Bounds values; null and NaN stay."""

    def __init__(self, min_value: float | None = None, max_value: float | None = None) -> None:
        if min_value is None and max_value is None:
            raise ValueError("a least or a greatest value is needed")
        self.min_value, self.max_value = min_value, max_value

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        def clip(c: Column, dtype: str | None) -> Column:
            out = None
            whole = ~F.isnan(c) if dtype in ("float", "double") else F.lit(True)
            if self.min_value is not None:
                out = F.when(c < self.min_value, F.lit(self.min_value))
            if self.max_value is not None:
                over = whole & (c > self.max_value)
                out = F.when(over, F.lit(self.max_value)) if out is None else out.when(over, F.lit(self.max_value))
            out = out.otherwise(c)
            return out.cast(dtype) if dtype else out

        return {n: elementwise(cols[n], schema[n].dtype, clip) for n in flat(entries)}


class LogOp(Operator):
    """log(1 + x) as float; -inf at -1, NaN below."""

    output_tags = (Tags.CONTINUOUS,)
    output_dtype = "float"

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        def log(c: Column, _: str | None) -> Column:
            x = c.cast("double")
            return F.when(x == -1, F.lit(float("-inf"))).when(x < -1, F.lit(float("nan"))).otherwise(F.log1p(x)).cast("float")

        return {n: elementwise(cols[n], schema[n].dtype, log) for n in flat(entries)}


class FillMissing(Operator):
    """A value for null and NaN; a flag column for what was missing, if asked for."""

    def __init__(self, fill_val: object = 0, add_binary_cols: bool = False) -> None:
        self.fill_val, self.add_binary_cols = fill_val, add_binary_cols

    def value(self, name: str) -> object:
        return self.fill_val

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        names = flat(entries)
        return {n: [n] for n in names} | ({f"{n}_filled": [n] for n in names} if self.add_binary_cols else {})

    def column_dtype(self, name: str, source: ColumnSchema) -> str | None:
        return "boolean" if self.add_binary_cols and name == f"{source.name}_filled" else source.dtype

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        out, flags = {}, {}
        for n in flat(entries):
            gone, dtype = missing(cols[n], schema[n].dtype), schema[n].dtype
            value = F.lit(self.value(n))
            out[n] = F.when(gone, value.cast(dtype) if dtype else value).otherwise(cols[n])
            flags[f"{n}_filled"] = gone
        return out | (flags if self.add_binary_cols else {})


class Bucketize(Operator):
    """The bucket number of b[i-1] <= x < b[i]; missing values count as beyond the last boundary.

    Decreasing boundaries number the buckets downwards: b[i-1] > x >= b[i].
    """

    output_tags = (Tags.CATEGORICAL,)
    output_dtype = "int"

    def __init__(self, boundaries: list | tuple | dict | Callable) -> None:
        if isinstance(boundaries, str):
            boundaries = from_path(boundaries)
        if not (isinstance(boundaries, (list, tuple, dict)) or callable(boundaries)):
            raise TypeError("boundaries must be a list, a dict or a function of the name")
        self.boundaries = boundaries

    def of(self, name: str) -> list:
        b = self.boundaries
        return list(b[name] if isinstance(b, dict) else b(name) if callable(b) else b)

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        return {n: [n] for n in flat(entries) if not isinstance(self.boundaries, dict) or n in self.boundaries}

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        out = {}
        for n in self.column_mapping(entries):
            b = self.of(n)
            down = len(b) > 1 and b[0] > b[-1]

            def bucket(c: Column, dtype: str | None, b: list = b, down: bool = down) -> Column:
                total = F.lit(0)
                for x in b:
                    total = total + ((c < x) if down else (c >= x)).cast("int")
                return F.when(missing(c, dtype), F.lit(0 if down else len(b))).otherwise(total)

            out[n] = elementwise(cols[n], schema[n].dtype, bucket)
        return out

    def params(self) -> dict:
        return {"boundaries": to_path(self.boundaries) if callable(self.boundaries) else self.boundaries}


def hashed(c: Column, method: str = "xxhash64") -> Column:
    """A non-negative 60-bit hash of a value as text; md5 can be computed by any SQL engine."""
    if method == "md5":
        return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(c.cast("string")), 4)


def embedding_size(cardinality: int) -> tuple[int, int]:
    """(cardinality, dimension): 1.6 n^0.56, between 16 and 512."""
    return cardinality, min(max(16, round(1.6 * cardinality**0.56)), 512)


def bucket_properties(n: int) -> dict:
    return {"domain": {"min": 0, "max": n}, "num_buckets": n, "embedding_sizes": dict(zip(("cardinality", "dimension"), embedding_size(n), strict=True))}


class HashBucket(Operator):
    """A hash modulo num_buckets, one number for all columns or one each; null stays null."""

    output_tags = (Tags.CATEGORICAL,)
    output_dtype = "int"

    def __init__(self, num_buckets: int | dict[str, int], method: str = "xxhash64") -> None:
        if not isinstance(num_buckets, (int, dict)):
            raise TypeError("num_buckets must be a number or a dict")
        self.num_buckets, self.method = num_buckets, method

    def of(self, name: str) -> int:
        return self.num_buckets[name] if isinstance(self.num_buckets, dict) else self.num_buckets

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        return {n: [n] for n in flat(entries) if isinstance(self.num_buckets, int) or n in self.num_buckets}

    def column_properties(self, name: str, source: ColumnSchema) -> dict:
        return bucket_properties(self.of(name))

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        def bucket(n: int) -> Callable:
            return lambda c, _: F.when(c.isNotNull(), (hashed(c, self.method) % n).cast("int"))

        return {n: elementwise(cols[n], schema[n].dtype, bucket(self.of(n))) for n in self.column_mapping(entries)}

    def get_embedding_sizes(self, columns: list[str]) -> dict[str, tuple[int, int]]:
        return {c: embedding_size(self.of(c)) for c in columns}


class HashedCross(Operator):
    """The XOR of the columns' hashes modulo num_buckets, one output for each group.

    Plain names form one group together.  A row with a null part is null.
    """

    output_tags = (Tags.CATEGORICAL,)
    output_dtype = "int"

    def __init__(self, num_buckets: int | dict, method: str = "xxhash64") -> None:
        if not isinstance(num_buckets, (int, dict)):
            raise TypeError("num_buckets must be a number or a dict")
        self.num_buckets, self.method = num_buckets, method

    def groups(self, entries: Entries) -> list[tuple[str, ...]]:
        plain = tuple(e for e in entries if isinstance(e, str))
        return [e for e in entries if not isinstance(e, str)] + ([plain] if plain else [])

    def of(self, group: tuple[str, ...]) -> int:
        if isinstance(self.num_buckets, int):
            return self.num_buckets
        return self.num_buckets.get(group) or self.num_buckets["_X_".join(group)]

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        return {"_X_".join(g): list(g) for g in self.groups(entries)}

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        return Schema(ColumnSchema("_X_".join(g), "int", ("categorical",), bucket_properties(self.of(g))) for g in self.groups(entries))

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        out = {}
        for g in self.groups(entries):
            total, known = hashed(cols[g[0]], self.method), cols[g[0]].isNotNull()
            for n in g[1:]:
                total, known = total.bitwiseXOR(hashed(cols[n], self.method)), known & cols[n].isNotNull()
            out["_X_".join(g)] = F.when(known, (total % self.of(g)).cast("int"))
        return out

    def params(self) -> dict:
        n = self.num_buckets
        return {"num_buckets": n if isinstance(n, int) else {k if isinstance(k, str) else "_X_".join(k): v for k, v in n.items()}, "method": self.method}


class ListSlice(Operator):
    """Python slices of lists; padded to the slice's greatest length if asked for."""

    output_tags = (Tags.LIST,)

    def __init__(self, start: int, end: int | None = None, pad: bool = False, pad_value: float = 0.0) -> None:
        self.start, self.end, self.pad, self.pad_value = start, end, pad, pad_value
        if end is None and start > 0:
            self._from, self._to = 0, start
        else:
            self._from, self._to = start, end
        if self._from < 0:
            self.max_elements = -self._from if self._to is None else self._to - self._from
        else:
            self.max_elements = self._to - self._from if self._to is not None and self._to >= 0 else None
        if pad and self.max_elements is None:
            raise ValueError("this slice has no greatest length to pad to")

    def columns(self, entries: Entries, cols: Cols, schema: Schema) -> Cols:
        def bound(n: Column, x: int | None) -> Column:
            if x is None:
                return n
            return F.greatest(n + x, F.lit(0)) if x < 0 else F.least(n, F.lit(x))

        out = {}
        for name in flat(entries):
            c = cols[name]
            n = F.size(c)
            a, b = bound(n, self._from), bound(n, self._to)
            part = F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))
            if self.pad:
                value = F.lit(self.pad_value)
                element = schema[name].dtype[6:-1] if schema[name].is_list else None
                value = value.cast(element) if element else value
                part = F.concat(part, F.array_repeat(value, F.greatest(F.lit(self.max_elements) - F.greatest(b - a, F.lit(0)), F.lit(0))))
            out[name] = F.when(c.isNotNull(), part)
        return out

    def column_properties(self, name: str, source: ColumnSchema) -> dict:
        if self.max_elements is None:
            return {}
        return {"value_count": {"min": self.max_elements if self.pad else 0, "max": self.max_elements}}
