"""Exact dedup by two-pass Bloom filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.bloom import might_contain, repeat_filter
from attestry.llm.shared import col, fresh


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", bits_per_row: int = 16, max_filter_mb: int = 64) -> DataFrame:
    """Of rows with the same text, the one with the lowest order column stays.

    Pass 1 sends the texts' hashes, eight bytes each, to Bloom filters by range of
    hashes, which tell those that possibly occur twice. Pass 2 lets rows whose hash is
    certainly unique pass straight through; only the others shuffle, and are compared
    by their text itself. They are told by a broadcast filter of bits_per_row bits for
    each hash that repeats, at most max_filter_mb (checked): at the default, up to 33
    million different repeated hashes one unique row in some hundred shuffles with
    them, at 10**8 one in twelve; the result is the same.

    Null texts: every such row stays. Empty texts are texts like any other: one
    stays. A null order value comes after all others. Rows with the same text and
    order value: one stays, by the hash of the other columns. An empty table gives
    an empty table. All columns stay as they are, whatever their names.
    """
    h, rn = fresh(df, "__hash"), fresh(df, "__rn")
    hashed = df.withColumn(h, F.when(col(text).isNotNull(), F.xxhash64(col(text))))
    packed, bits = repeat_filter(hashed.select(h), h, df.count(), bits_per_row, max_filter_mb)
    flag = fresh(hashed, "__maybe")
    flagged = hashed.withColumn(flag, might_contain(df, packed, bits, F.col(h)))
    names = [col(c) for c in df.columns]
    through = flagged.where(~F.col(flag)).select(*names)
    others = [col(f.name) for f in df.schema if f.name not in (text, order) and "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tie = [F.xxhash64(*others)] if others else []
    w = Window.partitionBy(F.col(h), col(text)).orderBy(col(order).asc_nulls_last(), *tie)
    kept = flagged.where(F.col(flag)).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).select(*names)
    return through.unionAll(kept)
