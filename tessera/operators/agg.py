"""Aggregations: to groups, and from groups back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ColumnSchema, Schema, Tags
from ..session import checkpointed
from .base import Cols, Entries, Operator, StatOperator, col, flat, present
from .rel import lookup, measured

_NARROW = {"count": "int", "nunique": "int", "mean": "float", "median": "float", "std": "float", "var": "float", "sum": "float"}


class Groupby(Operator):
    """One row per key; lists, first and last follow sort_cols (first and last by ascending order), or without them the order of the input.

    Rows with a null key are dropped.  Nulls stay in lists.  Key columns are
    part of the result if they were selected.
    """

    changes_rows = True

    def __init__(self, groupby_cols: str | list[str], sort_cols: str | list[str] | None = None, aggs: object = "list", name_sep: str = "_", ascending: bool = True) -> None:
        as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
        self.groupby_cols, self.sort_cols, self.aggs, self.name_sep, self.ascending = as_list(groupby_cols), as_list(sort_cols), aggs, name_sep, ascending

    @property
    def dependencies(self) -> list:
        return [[*self.groupby_cols, *self.sort_cols]]

    def _wanted(self, entries: Entries) -> list[tuple[str, str]]:
        names = lambda a: ["list" if x is list else x for x in (a if isinstance(a, (list, tuple)) else [a])]
        if isinstance(self.aggs, dict):
            return [(c, a) for c in flat(entries) if c not in self.groupby_cols for a in names(self.aggs.get(c, self.aggs.get("__all__", [])))]
        return [(c, a) for c in flat(entries) if c not in self.groupby_cols for a in names(self.aggs)]

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        keys = {k: [k] for k in flat(entries) if k in self.groupby_cols}
        return keys | {f"{c}{self.name_sep}{a}": [c] for c, a in self._wanted(entries)}

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        out = [schema[k] for k in flat(entries) if k in self.groupby_cols]
        for c, a in self._wanted(entries):
            base = schema[c].with_name(f"{c}{self.name_sep}{a}")
            dtype = f"array<{base.dtype}>" if a == "list" else _NARROW.get(a, base.dtype)
            out.append((base.with_tags([Tags.LIST]) if a == "list" else base).with_dtype(dtype))
        return Schema(out)

    def relate(self, df: DataFrame, entries: Entries, schema: Schema) -> DataFrame:
        kinds = dict(df.dtypes)
        wanted = self._wanted(entries)
        known = F.lit(True)
        for k in self.groupby_cols:
            known = known & present(col(k), kinds[k]).isNotNull()
        df = df.where(known)
        order = [col(c).alias(f"s{i}") for i, c in enumerate(self.sort_cols)]
        if not order and any(a in ("list", "first", "last") for _, a in wanted):
            df = df.withColumn("__order", F.monotonically_increasing_id())  # the order of the input
            order = [F.col("__order").alias("s0")]
        place = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in wanted))}
        aggs: list[Column] = []
        lists = list(dict.fromkeys(c for c, a in wanted if a == "list"))
        if lists:
            # one ordered list of structs per group serves all list aggregations
            rows = F.collect_list(F.struct(*order, *[col(c).alias(f"v{place[c]}") for c in lists]))
            aggs.append(F.sort_array(rows, self.ascending or not self.sort_cols).alias("__lists"))
        plain = {"sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "count": F.count, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "nunique": F.count_distinct, "min": F.min, "max": F.max}
        ends = {"first": F.min_by, "last": F.max_by}
        for c, a in dict.fromkeys(wanted):
            if a in plain:
                aggs.append(plain[a](present(col(c), kinds[c])).alias(f"__{a}{place[c]}"))
            elif a in ends:
                aggs.append(ends[a](F.struct(col(c).alias("v")), F.struct(*order))["v"].alias(f"__{a}{place[c]}"))
            elif a != "list":
                raise ValueError(f"unknown aggregation: {a}")
        keys = [col(k).alias(f"__key{i}") for i, k in enumerate(self.groupby_cols)]
        grouped = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        out = [F.col(f"__key{self.groupby_cols.index(k)}").alias(k) for k in flat(entries) if k in self.groupby_cols]
        for c, a in wanted:
            x = F.col("__lists")[f"v{place[c]}"] if a == "list" else F.col(f"__{a}{place[c]}")  # a field of an array of structs is an array
            out.append((x.cast(_NARROW[a]) if a in _NARROW else x).alias(f"{c}{self.name_sep}{a}"))
        return grouped.select(*out)


_STATS = {"count": None, "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}


def _joined(df: DataFrame, table: DataFrame, tag: str, keys: list[Column], size: int | None, room: object) -> DataFrame:
    """A null-safe left join with a table whose key columns are k0, k1, ..."""
    right = table.select(*[F.col(c).alias(f"{tag}{c}") for c in table.columns])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"{tag}k{i}"))
    return df.join(lookup(right, size, room), on, "left")


class JoinGroupby(StatOperator):
    """Statistics of each row's group; a key not seen in fitting gives null."""

    output_tags = (Tags.CONTINUOUS,)

    def __init__(self, cont_cols: object = None, stats: tuple | list = ("count",), split_out: object = None, split_every: object = None, cat_cache: object = "host", out_path: str | None = None, on_host: bool = True, name_sep: str = "_", tree_width: object = None) -> None:
        self.cont_cols, self.stats, self.name_sep = cont_cols, list(stats), name_sep
        unknown = set(self.stats) - set(_STATS)
        if unknown:
            raise ValueError(f"unknown statistics: {sorted(unknown)}")
        self.found: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}
        self.cont_names: list[str] | None = list(cont_cols) if isinstance(cont_cols, (list, tuple)) and all(isinstance(c, str) for c in cont_cols) else [cont_cols] if isinstance(cont_cols, str) else [] if cont_cols is None else None

    @property
    def dependencies(self) -> list:
        return [] if not self.cont_cols else [self.cont_cols]

    def bind_dependencies(self, names: list[str]) -> None:
        if self.cont_names is None or self.cont_cols:
            self.cont_names = names

    def _groups(self, entries: Entries) -> dict[str, tuple[str, ...]]:
        return {(e if isinstance(e, str) else self.name_sep.join(e)): ((e,) if isinstance(e, str) else tuple(e)) for e in entries}

    def _outputs(self, entries: Entries) -> dict[str, tuple[str, str | None, str]]:
        """Output name to (group, continuous column, statistic)."""
        out = {}
        for g in self._groups(entries):
            if "count" in self.stats:
                out[f"{g}{self.name_sep}count"] = (g, None, "count")
            for c in self.cont_names or []:
                for s in self.stats:
                    if s != "count":
                        out[self.name_sep.join((g, c, s))] = (g, c, s)
        return out

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        groups = self._groups(entries)
        return {n: [*groups[g], *([c] if c else [])] for n, (g, c, _) in self._outputs(entries).items()}

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        return Schema(ColumnSchema(n, "int" if s == "count" else "float" if s in ("mean", "std", "var") else schema[c].dtype if c in schema else None, ("continuous",)) for n, (_, c, s) in self._outputs(entries).items())

    def fit(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema) -> None:
        for g, members in self._groups(entries).items():
            keys = [present(cols[m], schema[m].dtype).alias(f"k{i}") for i, m in enumerate(members)]
            aggs = [F.count("*").alias("count")]
            for i, c in enumerate(self.cont_names or []):
                x = present(cols[c], schema[c].dtype)
                aggs += [_STATS[s](x).alias(f"c{i}{s}") for s in self.stats if s != "count"]
            table = checkpointed(df.groupBy(*keys).agg(*aggs))
            self.found[g], self.sizes[g] = table, measured(table)[1]
        self.fitted = True

    def extend(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema, fitting: bool = False) -> tuple[DataFrame, Cols]:
        self.need_fit()
        place = {g: i for i, g in enumerate(self._groups(entries))}
        for g, members in self._groups(entries).items():
            df = _joined(df, self.found[g], f"__jg{id(self)}_{place[g]}", [present(cols[m], schema[m].dtype) for m in members], self.sizes.get(g), self.room)
        kinds = {c.name: c.dtype for c in self.output_schema(schema, entries)}
        out = {}
        for n, (g, c, s) in self._outputs(entries).items():
            x = F.col(f"__jg{id(self)}_{place[g]}" + ("count" if c is None else f"c{self.cont_names.index(c)}{s}"))
            out[n] = x.cast(kinds[n]) if s in ("count", "mean", "std", "var") else x
        return df, out

    def clear(self) -> None:
        self.found, self.sizes, self.fitted = {}, {}, False

    def params(self) -> dict:
        return {"cont_cols": self.cont_names or None, "stats": self.stats, "name_sep": self.name_sep}

    def state(self) -> dict:
        return {"sizes": self.sizes, "cont_names": self.cont_names}

    def load_state(self, state: dict) -> None:
        self.sizes, self.cont_names = state["sizes"], state["cont_names"]

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.found)

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        self.found = dict(tables)


class TargetEncoding(StatOperator):
    """(sum of the target in the group + p * mean) / (rows in the group + p).

    fit_transform leaves out a row's own fold; a later transform uses all folds,
    unless folds_at_transform is set.  A row's fold is a hash of fold_key (by
    default of the grouped and target columns), so it is the same in every run;
    with fold_seed None and one integer fold_key it is that key modulo kfold.
    """

    output_tags = (Tags.CONTINUOUS,)

    def __init__(self, target: object, target_mean: object = None, kfold: int | None = None, fold_seed: int | None = 42, p_smooth: float = 20, out_col: object = None, out_dtype: str | None = None, split_out: object = None, split_every: object = None, cat_cache: object = "host", out_path: str | None = None, on_host: bool = True, name_sep: str = "_", drop_folds: bool = True, tree_width: object = None, fold_key: object = None, folds_at_transform: bool = False) -> None:
        self.target = [target] if isinstance(target, str) else list(target)
        self.target_mean, self.kfold, self.fold_seed, self.p_smooth = target_mean, kfold or 3, fold_seed, p_smooth
        self.out_col = [out_col] if isinstance(out_col, str) else out_col
        self.out_dtype = out_dtype or "float"
        self.name_sep, self.drop_folds, self.folds_at_transform = name_sep, drop_folds, folds_at_transform
        self.fold_key = [fold_key] if isinstance(fold_key, str) else fold_key
        self.means: dict[str, float] = {}
        self.found: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}

    @property
    def dependencies(self) -> list:
        return [[*self.target, *(self.fold_key or [])]]

    def _groups(self, entries: Entries) -> dict[str, tuple[str, ...]]:
        return {(e if isinstance(e, str) else self.name_sep.join(e)): ((e,) if isinstance(e, str) else tuple(e)) for e in entries}

    def _outputs(self, entries: Entries) -> dict[str, tuple[str, str]]:
        pairs = [(g, t) for g in self._groups(entries) for t in self.target]
        if self.out_col:
            if len(self.out_col) != len(pairs):
                raise ValueError("out_col must name each group and target")
            return dict(zip(self.out_col, pairs, strict=True))
        return {self.name_sep.join(("TE", g, t)): (g, t) for g, t in pairs}

    @property
    def _folded(self) -> bool:
        return self.kfold > 1

    def column_mapping(self, entries: Entries) -> dict[str, list[str]]:
        groups = self._groups(entries)
        out = {n: [*groups[g], t] for n, (g, t) in self._outputs(entries).items()}
        return out | ({} if self.drop_folds or not self._folded else {"__fold__": []})

    def output_schema(self, schema: Schema, entries: Entries) -> Schema:
        return Schema([ColumnSchema(n, self.out_dtype, ("continuous",)) for n in self._outputs(entries)] + ([] if self.drop_folds or not self._folded else [ColumnSchema("__fold__", "int")]))

    def fold(self, entries: Entries, cols: Cols) -> Column:
        keys = self.fold_key or list(dict.fromkeys([*flat(entries), *self.target]))
        if self.fold_seed is None and len(keys) == 1:
            return F.pmod(cols[keys[0]], F.lit(self.kfold)).cast("int")
        return F.pmod(F.xxhash64(*[cols[k] for k in keys], F.lit(self.fold_seed)), F.lit(self.kfold)).cast("int")

    def fit(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema) -> None:
        y = {t: present(cols[t], schema[t].dtype).cast("double") for t in self.target}
        given = self.target_mean if isinstance(self.target_mean, dict) else {t: self.target_mean for t in self.target if self.target_mean is not None}
        self.means = {t: float(v) for t, v in given.items()}
        for g, members in self._groups(entries).items():
            keys = [present(cols[m], schema[m].dtype).alias(f"k{i}") for i, m in enumerate(members)]
            names = [f"k{i}" for i in range(len(members))]
            folds = [self.fold(entries, cols).alias("fold")] if self._folded else []
            sums = [a for i, t in enumerate(self.target) for a in (F.sum(y[t]).alias(f"s{i}"), F.count(y[t]).alias(f"n{i}"))]
            by_fold = df.groupBy(*keys, *folds).agg(*sums)
            total = [F.sum(f"{x}{i}").alias(f"{x}{i}") for i in range(len(self.target)) for x in "sn"]
            if self._folded:
                # one row per key, its folds' sums beside the totals: one lookup serves both
                each = F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*[F.col(f"{x}{i}") for i in range(len(self.target)) for x in "sn"])))).alias("folds")
                table = by_fold.groupBy(*names).agg(*total, each)
            else:
                table = by_fold.groupBy(*names).agg(*total)
            table = checkpointed(table)
            self.found[g], self.sizes[g] = table, measured(table)[1]
            if any(t not in self.means for t in self.target):
                got = table.agg(*[F.sum(f"s{i}") / F.sum(f"n{i}") for i in range(len(self.target))]).first()
                self.means |= {t: float(got[i] or 0.0) for i, t in enumerate(self.target) if t not in self.means}
        self.fitted = True

    def extend(self, df: DataFrame, entries: Entries, cols: Cols, schema: Schema, fitting: bool = False) -> tuple[DataFrame, Cols]:
        self.need_fit()
        out: Cols = {}
        use_folds = self._folded and (fitting or self.folds_at_transform)
        fold = self.fold(entries, cols) if self._folded else None
        place = {g: i for i, g in enumerate(self._groups(entries))}
        for g, members in self._groups(entries).items():
            df = _joined(df, self.found[g], f"__te{id(self)}_{place[g]}", [present(cols[m], schema[m].dtype) for m in members], self.sizes.get(g), self.room)
        for name, (g, t) in self._outputs(entries).items():
            i, tag, mean, p = self.target.index(t), f"__te{id(self)}_{place[g]}", self.means[t], float(self.p_smooth)
            s, n = F.coalesce(F.col(f"{tag}s{i}"), F.lit(0.0)), F.coalesce(F.col(f"{tag}n{i}"), F.lit(0))
            if use_folds:
                own = F.try_element_at(F.col(f"{tag}folds"), fold)
                s, n = s - F.coalesce(own[f"s{i}"], F.lit(0.0)), n - F.coalesce(own[f"n{i}"], F.lit(0))
            out[name] = F.when(n + p > 0, (s + p * mean) / (n + p)).otherwise(F.lit(mean)).cast(self.out_dtype)
        if self._folded and not self.drop_folds:
            out["__fold__"] = fold
        return df, out

    def clear(self) -> None:
        self.found, self.sizes, self.means, self.fitted = {}, {}, {}, False

    def params(self) -> dict:
        return {k: getattr(self, k) for k in ("target", "target_mean", "kfold", "fold_seed", "p_smooth", "out_col", "out_dtype", "name_sep", "drop_folds", "fold_key", "folds_at_transform")}

    def state(self) -> dict:
        return {"sizes": self.sizes, "means": self.means}

    def load_state(self, state: dict) -> None:
        self.sizes, self.means = state["sizes"], state["means"]

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.found)

    def load_tables(self, tables: dict[str, DataFrame]) -> None:
        self.found = dict(tables)
