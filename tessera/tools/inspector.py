"""A profile of a dataset as JSON.

Run ``python -m tessera.tools.inspector -c columns.json -d data -f parquet -o out.json``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.base import col
from ..operators.stat import distinct_counts, profile_aggs
from ..sources.dataset import Dataset


class DatasetInspector:
    def inspect(self, dataset: Dataset, columns_dict: dict[str, list[str]], output_file: str | None = None) -> dict:
        """num_rows and, for conts, cats and labels, each column's statistics; one pass for these, one for distinct values."""
        df = dataset.df
        kinds = dict(df.dtypes)
        names = [c for group in ("conts", "cats", "labels") for c in columns_dict.get(group, [])]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, n in enumerate(names):
            c, dtype = col(n), kinds[n]
            aggs += [a.alias(f"a{i}_{j}") for j, a in enumerate(profile_aggs(c, dtype))]
            if dtype.startswith("array<"):
                aggs += [F.avg(F.size(c)).alias(f"l{i}"), F.min(F.size(c)).alias(f"m{i}"), F.max(F.size(c)).alias(f"x{i}")]
        got = df.agg(*aggs).first()
        distinct = distinct_counts(df, {n: col(n) for n in names}, kinds)
        out: dict = {"num_rows": got["rows"]}
        for group in ("conts", "cats", "labels"):
            out[group] = {}
            for n in columns_dict.get(group, []):
                i = names.index(n)
                low, high, mean, std, held, rows = (got[f"a{i}_{j}"] for j in range(6))
                one = {"dtype": kinds[n], "min": low, "max": high, "mean": mean, "std": std, "per_nan": 100 * (1 - held / rows) if rows else 0.0}
                if n in distinct:
                    one["cardinality"] = distinct[n]
                if kinds[n].startswith("array<"):
                    one |= {"multi_min": got[f"m{i}"], "multi_max": got[f"x{i}"], "multi_avg": got[f"l{i}"]}
                out[group][n] = one
        if output_file:
            with open(output_file, "w") as f:
                json.dump(out, f, indent=1)
        return out


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("-c", "--config_file", required=True)
    p.add_argument("-d", "--data_path", required=True)
    p.add_argument("-f", "--format", default="parquet")
    p.add_argument("-o", "--output_file", default="dataset_info.json")
    a = p.parse_args()
    SparkSession.builder.getOrCreate()
    with open(a.config_file) as f:
        DatasetInspector().inspect(Dataset(a.data_path, engine=a.format), json.load(f), a.output_file)


if __name__ == "__main__":
    main()
