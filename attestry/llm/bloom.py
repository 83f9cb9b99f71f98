"""Bloom filters over 64-bit hashes: which hashes possibly occur twice.

Hashes, never rows, shuffle to where equal ones meet; each range of them has a filter
of its own, of a few megabytes, and a hash that finds all its bits set possibly
repeats. What possibly repeats goes into one filter that is sent to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import table

U = np.uint64
SEGMENT = 1 << 19
PROBES = 4
RANGE = 1 << 20  # hashes of a range, about
HELD = 1 << 20  # hashes that a task looks through for copies before it sends them


def bits_for(rows: int, bits_per_row: int, max_mb: int) -> int:
    """A power of two bits; beyond max_mb it stays there, and more hashes count as
    possibly repeated, which costs work but never a result."""
    need = max(SEGMENT, rows * bits_per_row)
    return min(1 << (need - 1).bit_length(), 1 << (max_mb * (8 << 20)).bit_length() - 1)


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """(n, PROBES) bit positions by double hashing, all in one segment."""
    h = h.view(U) if h.dtype == np.int64 else h.astype(U)
    step = (h * U(0x9E3779B97F4A7C15) >> U(17)) | U(1)
    at = (h[:, None] + np.arange(PROBES, dtype=U)[None, :] * step[:, None]) & U(SEGMENT - 1)
    return (at + ((h >> U(40)) & U(bits // SEGMENT - 1))[:, None] * U(SEGMENT)).astype(np.int64)


def repeated(df: DataFrame, column: str, rows: int, bits_per_row: int = 16) -> DataFrame:
    """(k): hashes of a bigint column that possibly occur more than once, each once. All
    that do are among them; of the others, one in a few hundred. Nulls are left out."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash that a task has many times is sent twice."""
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(np.concatenate([v, v[c > 1]]))], ["k"])

        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            held.append(h)
            count += len(h)
            if count >= HELD:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    ranges = max(1, -(-rows // RANGE))
    bits = bits_for(min(rows, 2 * RANGE), bits_per_row, 64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, out = np.zeros(bits, bool), []  # at most 64 MB, whatever the table's size
        for batch in batches:
            v, c = np.unique(batch.column(0).to_numpy(), return_counts=True)
            p = probes(v, bits)
            out.append(v[once[p].all(axis=1) | (c > 1)])
            once[p] = True
        if out:
            yield pa.record_batch([pa.array(np.unique(np.concatenate(out)))], ["k"])

    return df.select(column).mapInArrow(thin, "k long").repartition(ranges, "k").mapInArrow(find, "k long")


def plain_filter(df: DataFrame, column: str, rows: int, bits_per_row: int = 16, max_mb: int = 64) -> tuple[np.ndarray, int]:
    """The packed filter of all hashes of a bigint column, and its number of bits."""
    bits = bits_for(rows, bits_per_row, max_mb)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            p = np.unique(probes(h, bits).ravel())
            ends = np.searchsorted(p, np.arange(bits // SEGMENT + 1) * SEGMENT)
            for seg in np.flatnonzero(np.diff(ends)).tolist():
                yield pa.record_batch([pa.array([seg]), pa.array([(p[ends[seg] : ends[seg + 1]] & (SEGMENT - 1)).astype(np.uint32).tobytes()], pa.binary())], ["seg", "at"])

    def merge(t: pa.Table) -> pa.Table:
        dense = np.zeros(SEGMENT, bool)
        for at in t["at"].to_pylist():
            dense[np.frombuffer(at, np.uint32)] = True
        return pa.table({"seg": t["seg"].slice(0, 1), "bits": pa.array([np.packbits(dense).tobytes()], pa.binary())})

    parts = df.select(column).mapInArrow(place, "seg long, at binary").groupBy("seg").applyInArrow(merge, "seg long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for seg, data in parts.collect():  # no more than bits / 8 bytes, at most max_mb
        out[seg * SEGMENT // 8 : (seg + 1) * SEGMENT // 8] = np.frombuffer(data, np.uint8)
    return out, bits


def repeat_filter(df: DataFrame, column: str, rows: int, bits_per_row: int = 16, max_mb: int = 64) -> tuple[np.ndarray, int]:
    """The filter of the hashes that possibly repeat, sized by how many these are."""
    some = table(repeated(df, column, rows, bits_per_row), "repeated")
    return plain_filter(some, "k", some.count(), bits_per_row, max_mb)


def contains(packed: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    p = probes(h, bits)
    return ((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)


def might_contain(df: DataFrame, packed: np.ndarray, bits: int, column: Column) -> Column:
    """Whether the filter, broadcast, holds a bigint; null is not in it."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        ok = h.notna().to_numpy()
        out = np.zeros(len(h), bool)
        if ok.any():
            out[ok] = contains(shared.value, bits, h[ok].to_numpy().astype(np.int64))
        return pd.Series(out)

    return test(column)
