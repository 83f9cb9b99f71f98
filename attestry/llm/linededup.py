"""Dedup of content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.bloom import contains, might_contain, plain_filter, repeat_filter
from attestry.llm.kernels import STEP, Kernel, U, bytes_of, mix, pieces
from attestry.llm.shared import col, fresh, table


MEMORY = 64 << 20  # bytes of chunks that a task remembers


def chunks(k: Kernel, arr: pa.Array, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, and of each chunk of at least two lines and min_bytes:
    hash, first byte, byte after its last line feed, document.

    r[i] rolls over the hashes of lines i - 1 and i; a chunk ends after each line
    where r is a strict local minimum to the left and none to the right is less.
    So boundaries depend on four lines around them and never stand side by side.
    """
    text, offs = bytes_of(arr)
    h, starts, ends, lo = k.lines(text, offs)
    empty = np.zeros(0, np.int64)
    if not len(h):
        return text, h, empty, empty, empty
    first = np.zeros(len(h), bool)
    first[lo[:-1][np.diff(lo) > 0]] = True
    last = np.roll(first, -1)
    before = np.where(first, U(0), np.roll(h, 1))
    r = mix(before * U(STEP) + h)
    cut = ~first & ~last & (r < np.roll(r, 1)) & (r <= np.roll(r, -1)) | last
    stop = np.flatnonzero(cut)
    go = np.concatenate([[0], stop[:-1] + 1])
    s, e = starts[go], ends[stop]
    content = e - (text[e - 1] == 10)
    ink = np.concatenate([[0], np.cumsum(text > 32)])
    good = (stop > go) & (content - s >= min_bytes) & (ink[content] > ink[s])
    go, s, e, content = go[good], s[good], e[good], content[good]
    return text, k.ranges(k.prefix(text), s, content), s, e, np.searchsorted(lo, go, "right") - 1


def windows(k: Kernel, arr: pa.Array, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As chunks, for the shortest runs of at least two lines and min_bytes from each
    line on and up to each line. Whatever run of lines repeats is the union of the
    windows within it, so they need no boundaries."""
    text, offs = bytes_of(arr)
    h, starts, ends, lo = k.lines(text, offs)
    empty = np.zeros(0, np.int64)
    if len(h) < 2:
        return text, h[:0], empty, empty, empty
    content = ends - (text[ends - 1] == 10)
    own = np.searchsorted(lo, np.arange(len(h)), "right") - 1
    line = np.arange(len(h))
    # content and starts both grow with the line
    down = np.maximum(np.searchsorted(content, starts + min_bytes), line + 1)
    up = np.minimum(np.searchsorted(starts, content - min_bytes, "right") - 1, line - 1)
    fits, back = down < lo[own + 1], up >= lo[own]
    go, stop = np.concatenate([line[fits], up[back]]), np.concatenate([down[fits], line[back]])
    pair = np.unique(go << 32 | stop)
    go, stop = pair >> 32, pair & 0xFFFFFFFF
    s, e, content = starts[go], ends[stop], content[stop]
    ink = np.concatenate([[0], np.cumsum(text > 32)])
    good = ink[content] > ink[s]
    s, e, content = s[good], e[good], content[good]
    return text, k.ranges(k.prefix(text), s, content), s, e, own[go[good]]


def line_dedup(
    df: DataFrame, text: str = "text", order: str = "doc_id", min_bytes: int = 48, bits_per_row: int = 16, max_filter_mb: int = 64, max_broadcast_mb: int = 16, drop_emptied: bool = True, whole: bool = False,
) -> DataFrame:
    """df without the later copies of chunks of lines that repeat anywhere in it.

    Chunks are runs of at least two lines between content-defined boundaries, so
    that lines put before a passage shift nothing. Chunks of less than min_bytes
    or of blanks only are left alone. Of the same chunk, the occurrence with the
    lowest (order, hash of text, position) stays, within a document too.

    A chunk's boundaries depend on the lines around it, so that passages of few lines
    between other lines are mostly missed. With whole, every run of at least two
    lines and min_bytes that stands earlier is cut, whatever is around it: instead of
    chunks, the shortest runs from and up to each line are compared.

    Pass 1 sends the chunks' hashes to Bloom filters by range, and what possibly repeats
    becomes one filter (at most max_filter_mb, checked; beyond it more chunks move).
    Pass 2 sends only chunks that possibly repeat to where equal ones meet, with their
    bytes once a task; grouping is by the bytes themselves. What is to be cut is broadcast if it is measured to be
    below max_broadcast_mb, else joined: then rows without a cut, by a Bloom filter
    of the ids, do not shuffle.

    Null and empty texts and texts of one line stay as they are; a null order comes
    last. Rows with equal order and text count as one document and are cut alike.
    Documents of which nothing but blanks remains are dropped with drop_emptied,
    else kept as what remains. Order and all columns but text stay as they are.
    """
    spark = df.sparkSession
    parts = windows if whole else chunks
    src = df.select(col(order).alias("d"), F.xxhash64(col(text)).alias("h"), col(text).alias("t")).where(F.instr("t", "\n") > 0)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Kernel()
        for batch in batches:
            for part in pieces(batch, "t"):
                yield pa.record_batch([pa.array(parts(k, part.column(0), min_bytes)[1].view(np.int64))], ["c"])

    all_chunks = table(src.select("t").mapInArrow(hashes, "c long"), "chunks")
    packed, bits = repeat_filter(all_chunks, "c", all_chunks.count(), bits_per_row, max_filter_mb)
    shared = spark.sparkContext.broadcast(packed)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task sends the bytes of a chunk for its earliest occurrence only; whatever
        comes later is a copy of that for certain, and is sent without."""
        k, seen, held = Kernel(), {}, 0
        for batch in batches:
            for part in pieces(batch, "t"):
                b, c, s, e, doc = parts(k, part.column(2), min_bytes)
                keep = contains(shared.value, bits, c) if len(c) else np.zeros(0, bool)
                if not keep.any():
                    continue
                c, s, e, doc = c[keep], s[keep], e[keep], doc[keep]
                chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
                offs = bytes_of(part.column(2))[1]
                content = e - (b[e - 1] == 10)
                data = b.tobytes()
                raw = [data[x:y] for x, y in zip(s.tolist(), content.tolist())]
                d, h = part.column(0).to_pylist(), part.column(1).to_pylist()
                sent = np.ones(len(raw), bool)
                for i, (x, y, z) in enumerate(zip(raw, doc.tolist(), s.tolist())):
                    place = (d[y] is None, d[y], h[y], z - int(offs[y]))
                    first = seen.get(x)
                    if first is None or place < first:
                        seen[x] = place
                        held += len(x) + 256
                    else:
                        raw[i], sent[i] = None, place > first
                if held > MEMORY:
                    seen, held = {}, 0
                c, s, e, doc, raw = c[sent], s[sent], e[sent], doc[sent], [x for x, y in zip(raw, sent) if y]
                base = chars[offs[doc]]
                take = pa.array(doc)
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(c.view(np.int64)), pa.array((chars[s] - base).astype(np.int32)), pa.array((chars[e] - base).astype(np.int32)), pa.array(raw, pa.binary())],
                    ["d", "h", "c", "s", "e", "raw"],
                )

    kind = df.schema[order].dataType
    schema = T.StructType([T.StructField("d", kind), T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("raw", T.BinaryType())])
    own = F.when(F.col("raw").isNull(), F.xxhash64("d", "h", "s"))
    w = Window.partitionBy("c", "raw", own).orderBy(F.col("d").asc_nulls_last(), "h", "s")
    later = src.mapInArrow(candidates, schema).withColumn("n", F.rank().over(w)).where("n > 1 or raw is null")
    # runs may overlap or hold one another: what touches is one cut
    by = Window.partitionBy("d", "h").orderBy("s", "e")
    over = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(over.isNull() | (F.col("s") > over), 1).otherwise(0)).over(by)
    later = later.select("d", "h", "s", "e", island.alias("i")).groupBy("d", "h", "i").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cuts = table(later.groupBy("d", "h").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("cuts")), "cuts")

    names = [col(c) for c in df.columns]
    key, cut, d2 = fresh(df, "__key"), fresh(df, "__cuts"), fresh(df, "__d")
    keyed = df.withColumn(key, F.xxhash64(col(text)))
    right = cuts.select(F.col("d").alias(d2), F.col("h").alias(fresh(keyed, "__h")), F.col("cuts").alias(cut))
    on = col(order).eqNullSafe(F.col(d2)) & (F.col(key) == F.col(right.columns[1]))
    size = cuts.agg(F.count(F.lit(1)) * 40 + F.coalesce(F.sum(F.size("cuts") * 8), F.lit(0))).collect()[0][0]
    if size <= max_broadcast_mb << 20:
        joined = keyed.join(F.broadcast(right), on, "left")
        through = None
    else:
        both = F.xxhash64(F.col("d"), F.col("h"))
        ids = cuts.select(both.alias("k"))
        packed2, bits2 = plain_filter(ids, "k", ids.count(), bits_per_row, max_filter_mb)
        flag = fresh(keyed, "__flag")
        flagged = keyed.withColumn(flag, might_contain(df, packed2, bits2, F.xxhash64(col(order), F.col(key))))
        through = flagged.where(~F.col(flag)).select(*names)
        joined = flagged.where(F.col(flag)).join(right, on, "left")
    t = col(text)
    starts = F.concat(F.array(F.lit(0)), F.col(cut)["e"])
    stops = F.concat(F.col(cut)["s"], F.array(F.length(t)))
    rest = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(t, a + 1, b - a)), "")
    new = F.when(F.col(cut).isNull(), t).otherwise(rest)
    out = joined.withColumn(cut + "t", new)
    if drop_emptied:
        out = out.where(F.col(cut).isNull() | F.col(cut + "t").rlike(r"\S"))
    out = out.select(*[F.col(cut + "t").alias(c) if c == text else col(c) for c in df.columns])
    return out if through is None else through.unionAll(out)
