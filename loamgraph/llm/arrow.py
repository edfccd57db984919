"""Arrow helpers for the operators that run Python: bounded slices of batches, and texts to hashed words without a Python loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Text bytes handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at once, so that long texts don't add up there.
BATCH_ROWS = 512


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows at most; lowers the session's setting if that is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most`` bytes of the column at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def words(texts: pa.Array, stems: tuple[int, ...] = ()) -> tuple:
    """(offsets, hashes): lower-cased runs of letters and digits as 64-bit hashes, texts one after another. Null is empty.
    stems: lengths of word beginnings to hash as well, returned as a third value."""
    t = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    t = pc.utf8_trim_whitespace(pc.replace_substring_regex(t, pattern=r"[^\p{L}\p{N}]+", replacement=" "))
    lists = pc.split_pattern(t, " ")
    enc = lists.flatten().dictionary_encode()
    at = enc.indices.to_numpy()

    def hashed(known: pa.Array) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in known.to_pylist()), np.uint64, len(known))[at]

    every = [hashed(enc.dictionary), *(hashed(pc.utf8_slice_codeunits(enc.dictionary, 0, n)) for n in stems)]
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(t, "").to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text splits into one empty word
        every = [x[~np.repeat(empty, counts)] for x in every]
        counts = np.where(empty, 0, counts)
    return (np.concatenate([[0], np.cumsum(counts)]), every[0], *([every[1:]] if stems else []))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(offsets: np.ndarray, ids: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the runs of n words of each text, repeats included; a text of 1 to n - 1 words is one shingle."""
    counts = np.diff(offsets)
    if not len(ids):
        return np.zeros(len(counts) + 1, np.int64), np.zeros(0, np.uint64)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(offsets[:-1] - out[:-1], made) + np.arange(out[-1])
    last = np.repeat(offsets[1:], made)
    h = np.full(len(first), np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for i in range(n):
            at = first + i
            inside = at < last
            w = ids[np.minimum(at, len(ids) - 1)]
            h = np.where(inside, mix64(h * np.uint64(0x100000001B3) + w), h)
    return out, h
