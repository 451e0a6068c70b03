"""Batches of exact size for training loops, as dicts of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

from ..sources.dataset import Dataset


class BatchLoader:
    """Yields (features, labels).  shuffle permutes rows anew each epoch.

    global_size and global_rank deal rows out by a hash of the row, so that
    workers see disjoint rows.  Lists are (values, offsets) unless padded to
    sparse_max.  Columns are named, or found by tags.
    """

    def __init__(self, dataset: Dataset, batch_size: int, cats: list[str] | None = None, conts: list[str] | None = None, labels: list[str] | None = None, shuffle: bool = True, drop_last: bool = False, seed: int = 0, global_size: int = 1, global_rank: int = 0, sparse_max: dict[str, int] | None = None) -> None:
        schema = dataset.schema
        tagged = lambda t: schema.by_tag([t]).column_names
        named = cats is not None or conts is not None or labels is not None
        self.cats = (cats or []) if named else tagged("categorical")
        self.conts = (conts or []) if named else tagged("continuous")
        self.labels = (labels or []) if named else tagged("target")
        if not (self.cats or self.conts):
            raise ValueError("no feature columns: name them, or tag them")
        self.dataset, self.batch_size, self.shuffle, self.drop_last, self.seed = dataset, batch_size, shuffle, drop_last, seed
        self.global_size, self.global_rank, self.sparse_max, self.epoch = global_size, global_rank, sparse_max or {}, 0

    def _rows(self):
        df = self.dataset.df.select(*self.cats, *self.conts, *self.labels)
        if self.global_size > 1:
            df = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(self.global_size)) == self.global_rank)
        if self.shuffle:
            df = df.orderBy(F.rand(self.seed + self.epoch))
        return df

    def __len__(self) -> int:
        n = self._rows().count()
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)

    def __iter__(self) -> Iterator[tuple[dict, dict]]:
        held: list = []
        for row in self._rows().toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == self.batch_size:
                yield self._batch(held)
                held = []
        if held and not self.drop_last:
            yield self._batch(held)
        self.epoch += 1

    def _column(self, rows: list, name: str):
        values = [r[name] for r in rows]
        if not any(isinstance(v, list) for v in values):
            return np.array(values)
        lists = [v or [] for v in values]
        if name in self.sparse_max:
            n = self.sparse_max[name]
            return np.array([(v + [0] * n)[:n] for v in lists])
        return np.array([x for v in lists for x in v]), np.cumsum([0, *map(len, lists)])

    def _batch(self, rows: list) -> tuple[dict, dict]:
        return {n: self._column(rows, n) for n in [*self.cats, *self.conts]}, {n: self._column(rows, n) for n in self.labels}
