"""Shared plumbing: checkpoints, Arrow text buffers, vectorised word hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed as checkpoint

#: Removes a query's shuffle files when it has ended; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """checkpoint(), without the shuffle files that df was made with: they do not pile up from step to step."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return checkpoint(df.select("*"))
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


#: Lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [\x20\x09-\x0D] separates words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The same class for Java regular expressions.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def crc_mod(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n; 0 for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a whole text column: one scan, one number."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def as_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def by_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer one is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in the buffer, and where each document's words begin.

    inside: for each byte value, whether it belongs to a word.  The third array
    has one entry more than there are documents.
    """
    part = np.zeros(len(data) + 1, bool)
    part[:-1] = inside[data]
    first = part[:-1].copy()
    first[1:] &= ~part[:-2]
    last = part[:-1] & ~part[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = part[cuts]
    last[cuts - 1] = part[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, np.ndarray] = {}
#: Values hashed at a time, so that the tables of powers stay small.
_STEP = 1 << 17


def _powers(r: np.uint64, n: int) -> np.ndarray:
    """r to the powers 0 to n - 1, modulo 2^64."""
    if len(_POWERS.get(int(r), ())) < n:
        out = np.full(max(n, 2 * _STEP), r, np.uint64)
        out[0] = 1
        table = np.multiply.accumulate(out)
        if n > 2 * _STEP:  # for one long span; not kept
            return table
        _POWERS[int(r)] = table
    return _POWERS[int(r)][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash is usable."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _R1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, r: np.uint64 = _R2) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end] for many spans, ordered by start and by end."""
    out = np.empty(len(starts), np.uint64)
    back = np.uint64(pow(int(r), -1, 1 << 64))
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _STEP, "right")))
        a, b = starts[i:j] - low, ends[i:j] - low
        part = values[low : low + b[-1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(r, len(part)), out=total[1:])
        out[i:j] = mixed((total[b] - total[a]) * _powers(back, len(part) + 1)[a] + (b - a).astype(np.uint64) * _R1)
        i = j
    return out


class _ByteValues:
    """Random 64-bit values of bytes, looked up a slice at a time."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data

    def __getitem__(self, part: slice) -> np.ndarray:
        return _BYTES[self.data[part]]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    return span_hashes(_ByteValues(data), starts, ends)


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within one document, and their first words."""
    at = np.arange(max(0, len(hashes) - k + 1))
    if len(at):
        doc = np.searchsorted(bounds, at, "right")
        at = at[at + k <= bounds[doc]]
    return (span_hashes(hashes, at, at + k, _R1) if len(at) else np.zeros(0, np.uint64)), at


def in_blocks(docs: DataFrame, keys: list[str], text: str, block_bytes: int, size: int | None = None) -> DataFrame:
    """Adds ``block``: a hash of the keys into blocks of about block_bytes of text.

    Rows that agree in all keys share a block.  The count of blocks follows the
    size of the input, so that a block's text fits a worker at every scale; a
    text longer than that is a block's only large one.
    """
    n = max(1, math.ceil((text_bytes(docs, text) if size is None else size) / block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(n)))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a plain sort is much faster than numpy's unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def places(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x, all of which are there, stands among sorted distinct 64-bit values; by a table of hashes."""
    shift = np.uint64(64 - max(10, int(len(ordered)).bit_length() + 3))
    odd = np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(1 << int(64 - shift), np.int32 if len(ordered) < 1 << 31 else np.int64)
    table[ordered * odd >> shift] = np.arange(len(ordered))
    at = table[x * odd >> shift]
    lost = np.flatnonzero(ordered[at] != x)
    at[lost] = np.searchsorted(ordered, x[lost])
    return at


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such columns."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame) -> str:
    """df's columns as a DDL string."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1 by a hash's leading bits, so that sorted hashes lie by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_cuts(ordered: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; n + 1 entries."""
    return np.searchsorted(bucket_of(ordered, n), np.arange(n + 1))


def packed(values: np.ndarray, cuts: np.ndarray, kind: str) -> list[bytes]:
    values = values.astype(kind)
    return [values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def unpacked(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)
