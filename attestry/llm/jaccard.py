"""N-gram Jaccard self-join as a blocked sparse matrix product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.bloom import might_contain, plain_filter
from attestry.llm.kernels import Kernel, U, bytes_of, give_back, mix, ngrams, owners, pieces, word_lut
from attestry.llm.shared import col, fresh, table

HASH = U((1 << 46) - 1)
KEY = U((1 << 52) - 1)
MASK32 = U((1 << 32) - 1)
CELLS = 1 << 19  # of a segment of the table of classes
SAMPLE = 8  # one of so many sets, by its signature, tells how frequent n-grams are
COUNT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("need", pa.int32())])


def hashed(k: Kernel, arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each document, and its number. A document of fewer than
    n words has one n-gram, all its words."""
    text, offs = bytes_of(pc.utf8_lower(arr))
    h, _, _, wo = k.words(text, offs, word_lut())
    g, ok = ngrams(h, wo, n)
    own = owners(wo)
    g, o = g[ok], own[ok]
    lengths = np.diff(wo)
    for short in range(1, n):
        docs = np.flatnonzero(lengths == short)
        if len(docs):
            g = np.concatenate([g, ngrams(h, wo, short)[0][wo[docs]]])
            o = np.concatenate([o, docs])
    return g, o


def grams(k: Kernel, arr: pa.Array, n: int, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document as sorted 52-bit keys, a class of frequency
    before 46 bits of hash, and the offsets of the documents in them."""
    g, o = hashed(k, arr, n)
    g = g >> U(18)
    if classes is not None and len(g):
        g |= classes[(g & U(len(classes) - 1)).astype(np.int64)].astype(U) << U(46)
    packed = np.sort((o.astype(U) << U(52)) | g)
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return packed & KEY, np.searchsorted(packed >> U(52), np.arange(len(arr) + 1).astype(U))


def whole(k: Kernel, arr: pa.Array, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Signature of each document and its distinct n-grams as 64-bit hashes."""
    g, o = hashed(k, arr, n)
    by = np.lexsort((g, o))
    g, o = g[by], o[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    docs = np.arange(len(arr) + 1)
    at = np.searchsorted(o, docs)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] >> U(18) != g[:-1] >> U(18)) | (o[1:] != o[:-1])
    return signatures(g[new] >> U(18), np.searchsorted(o[new], docs)), [g[x:y] for x, y in zip(at[:-1], at[1:])]


def bitmaps(keys: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bit for each n-gram of a set, at a hash of it; two to four times as many bits as
    n-grams, a power of two from 128 to 65536."""
    size = np.diff(at)
    bits = 1 << np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), 7, 16)
    base = np.concatenate([[0], np.cumsum(bits)])
    flat = np.zeros(base[-1], bool)
    flat[np.repeat(base[:-1], size) + (mix(keys & HASH).astype(np.int64) & np.repeat(bits - 1, size))] = True
    data = np.packbits(flat, bitorder="little").tobytes()
    return [data[x:y] for x, y in zip((base[:-1] >> 3).tolist(), (base[1:] >> 3).tolist())]


def possible(sig: np.ndarray, size: np.ndarray, bits: list[bytes], group: np.ndarray, side: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of partners()."""
    out = [(np.full(len(j), i), j) for i, j in partners(size, bits, group, side, t)]
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *out))


def partners(size: np.ndarray, bits: list[bytes], group: np.ndarray, side: np.ndarray, t: float, known: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """A row and others of its group, of the other side where sides are not -1, with which
    it may have a similarity of t, each pair once: each bit in which two bitmaps differ is
    an n-gram of one set only. Rows for which known gives the same are not compared."""
    wide = np.array([len(x) for x in bits])
    _, group = np.unique(group, return_inverse=True)
    for width in np.unique(wide).tolist():
        mine = np.flatnonzero(wide == width)
        # sizes that t allows have bitmaps that are at most so many times as wide
        other = np.flatnonzero((wide >= width) & (wide <= width * 2 ** np.ceil(np.log2(1 / t))))
        other = other[np.lexsort((other, size[other], group[other]))]
        m = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[i], "<u8").reshape(-1, width // 8), axis=0) for i in other])
        rank = group[other] * (1 << 32) + size[other]
        top = np.floor(size[mine] / t + 1e-9).astype(np.int64)
        lo, hi = np.searchsorted(rank, group[mine] * (1 << 32) + size[mine]), np.searchsorted(rank, group[mine] * (1 << 32) + top, "right")
        row = np.empty(len(wide), np.int64)
        row[other] = np.arange(len(other))
        for i, x, y in zip(mine.tolist(), lo.tolist(), hi.tolist()):
            if y - x < 2:
                continue
            j, against = other[x:y], m[x:y]
            if known:
                top = known()
                new = np.flatnonzero(top[j] != top[i])
                if not len(new):
                    continue
                if len(new) < len(j):
                    j, against = j[new], against[new]
            apart = np.bitwise_count(against ^ m[row[i]]).sum(axis=1, dtype=np.int64)
            good = (size[i] + size[j] - apart) // 2 >= required(size[i], size[j], t)
            good &= (j > i) | (size[j] > size[i])
            if side[i] >= 0:
                good &= side[j] != side[i]
            j = j[good]
            yield i, j


def signatures(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set of n-grams, whatever their class."""
    c = np.concatenate([np.zeros(1, U), np.cumsum(mix((keys & HASH) + U(0x9E3779B97F4A7C15)))])
    return mix((c[at[1:]] - c[at[:-1]]) + np.diff(at).astype(U) * U(0xD6E8FEB86659FD93))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[new], np.diff(np.concatenate([new, [len(sorted_values)]]))


def prefix_size(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def required(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def pair_counts(packed: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (lesser << 32 | greater) with an entry in one column, and in how
    many. packed: column << 32 | row, sorted; rows ascend by size, and sizes that
    rule t out form no pair."""
    key, doc = packed >> U(32), (packed & MASK32).astype(np.int64)
    buffer, held = [], 0
    total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0, np.int64))

    def fold(total: tuple[np.ndarray, np.ndarray], buffer: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, c = runs(np.sort(np.concatenate(buffer)))
        if not len(total[0]):
            return v, c
        v, c = np.concatenate([total[0], v]), np.concatenate([total[1], c])
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        return v[new], np.add.reduceat(c, new)

    i, d = np.flatnonzero(key[1:] == key[:-1]), 1
    while len(i):
        i = i[size[doc[i]] >= t * size[doc[i + d]] - 1e-9]
        for lo in range(0, len(i), 1 << 20):
            x = i[lo : lo + (1 << 20)]
            buffer.append((doc[x].astype(U) << U(32)) | doc[x + d].astype(U))
            held += len(x)
            if held >= 3 << 20:
                total, buffer, held = fold(total, buffer), [], 0
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i + d] == key[i]]
    return fold(total, buffer) if buffer else total


def block_product(tiles: pa.Table, t: float, hot: int) -> Iterator[tuple[np.ndarray, ...]]:
    """One block of columns of the incidence matrix times its transpose: (sig a, sig b,
    size a, size b, overlap) of pairs whose sizes allow t. Documents with the same set
    are one row. A column of more than hot rows gives, instead of its pairs, overlap 0
    for the links of its rows to the first of them in a chain of sizes that allow t."""
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in tiles[c].to_pylist()])
    sig, size, count, key = join("sig", U), join("size", np.int32).astype(np.int64), join("count", np.int32), join("keys", np.uint32)
    by = np.lexsort((sig, size))
    s = sig[by]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(len(sig), np.int64)
    rank[by] = np.cumsum(new) - 1
    first = np.zeros(len(sig), bool)
    first[by[new]] = True
    entry = np.repeat(first, count)
    packed = (key[entry].astype(U) << U(32)) | np.repeat(rank, count)[entry].astype(U)
    del key, entry
    packed.sort()
    sig, size = s[new], size[by][new]
    number = np.repeat(*(lambda c: (c, c))(runs(packed >> U(32))[1]))
    pairs, counts = pair_counts(packed[number <= hot], size, t)
    packed = packed[number > hot]
    if len(packed):
        key, doc = packed >> U(32), (packed & MASK32).astype(np.int64)
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (size[doc[:-1]] < t * size[doc[1:]] - 1e-9)])
        lead = doc[np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))]
        links, _ = runs(np.sort((lead.astype(U) << U(32)) | doc.astype(U)))
        links = links[(links >> U(32)) != (links & MASK32)]
        pairs, counts = np.concatenate([pairs, links]), np.concatenate([counts, np.zeros(len(links), np.int64)])
    a, b = (pairs >> U(32)).astype(np.int64), (pairs & MASK32).astype(np.int64)
    for lo in range(0, len(a), 1 << 18):
        x, y = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
        yield sig[x], sig[y], size[x], size[y], counts[lo : lo + (1 << 18)]


class Tile:
    """Entries (column, row) of some rows, by column."""

    def __init__(self, column: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(column, kind="stable")
        self.size, self.rows = size, len(size)
        self.row = np.repeat(np.arange(len(size)), size)[order]
        self.column, self.number = runs(column[order])
        self.start = np.cumsum(self.number) - self.number

    def dense(self, columns: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros((len(columns), self.rows), kind)
        n = self.number[columns]
        out[np.repeat(np.arange(len(columns)), n), self.row[spread(self.start[columns], n)]] = 1
        return out


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each of n places."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def overlaps(x: Tile, y: Tile) -> np.ndarray:
    """In how many columns each row of x meets each row of y: columns of many rows are
    multiplied as dense matrices, the pairs of the others are counted."""
    _, i, j = np.intersect1d(x.column, y.column, assume_unique=True, return_indices=True)
    work = x.number[i] * y.number[j]
    many = work * 150 > x.rows * y.rows
    kind = np.float32 if max(x.size.max(), y.size.max()) < 1 << 24 else np.float64
    out = np.zeros((x.rows, y.rows), kind)
    a, b = i[many], j[many]
    step = max(1, (1 << 22) // (x.rows + y.rows))
    for lo in range(0, len(a), step):
        out += x.dense(a[lo : lo + step], kind).T @ y.dense(b[lo : lo + step], kind)
    a, b, work = i[~many], j[~many], work[~many]
    ends = np.cumsum(work)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - work[lo] + (1 << 20), "right")))
        own, nth = np.repeat(np.arange(lo, hi), work[lo:hi]), spread(np.zeros(hi - lo, np.int64), work[lo:hi])
        n = y.number[b[own]]
        np.add.at(out.reshape(-1), x.row[x.start[a[own]] + nth // n] * y.rows + y.row[y.start[b[own]] + nth % n], kind(1))
        lo = hi
    return out


def exact_pairs(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, t: float, group: np.ndarray | None = None, rows: int = 1024, known: Callable[[], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(sig a, sig b, size a, size b, overlap) of all pairs of sets of one group, of both
    sides where sides are not -1, with a similarity of t, counted on whole sets: of a group,
    so many rows by size meet so many others at a time, but not if known gives the same for
    all of them."""
    size = np.array([len(x) for x in sets], np.int64)
    group = np.zeros(len(sets), np.int64) if group is None else group
    by = np.lexsort((size, group))
    edges = np.flatnonzero(np.diff(group[by])) + 1
    for mine in np.split(by, edges):
        parts = [mine[lo : lo + rows] for lo in range(0, len(mine), rows)]
        _, column = np.unique(np.concatenate([sets[i] for i in mine]), return_inverse=True)
        held = [Tile(c, size[p]) for c, p in zip(np.split(column, np.cumsum([size[p].sum() for p in parts])[:-1]), parts)]
        for i, p in enumerate(parts):
            for k in range(i, len(parts)):
                q = parts[k]
                if size[p[-1]] < t * size[q[0]] - 1e-9 or (p is not q and side[p[0]] >= 0 and len({*side[p].tolist(), *side[q].tolist()}) < 2):
                    continue
                if known and len(np.unique(known()[np.concatenate([p, q])])) < 2:
                    continue
                c = overlaps(held[i], held[k])
                good = c >= required(size[p][:, None], size[q][None, :], t)
                if p is q:
                    good = np.triu(good, 1)
                if side[p[0]] >= 0:
                    good &= side[p][:, None] != side[q][None, :]
                a, b = np.nonzero(good)
                if len(a):
                    yield sig[p[a]], sig[q[b]], size[p[a]], size[q[b]], c[a, b].astype(np.int64)


def _classes(found: DataFrame, entries: int, max_order_kb: int) -> np.ndarray:
    """A table of cells, found by an n-gram's hash, with a class by the logarithm of how
    many sets of the sample hold it. Of n-grams that share a cell the most frequent counts:
    beyond max_order_kb cells are shared more, and rare n-grams pass for frequent ones, not
    the other way round. Classes only set the order in which prefixes are taken.

    found: (x), sorted hashes, which meet by ranges of them of about a million."""
    shift = U(46 - max(0, (entries // SAMPLE >> 20).bit_length()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = np.frombuffer(data.as_buffer(), U)
                part, n = runs(x >> shift)
                yield pa.record_batch([pa.array(part.view(np.int64)), pa.array([y.tobytes() for y in np.split(x, np.cumsum(n)[:-1])], pa.binary())], ["part", "x"])

    def often(t: pa.Table) -> pa.Table:
        v, c = runs(np.sort(np.concatenate([np.frombuffer(x, U) for x in t["x"].to_pylist()])))
        give_back()
        return pa.table({"x": v[c > 1].view(np.int64), "c": np.minimum(2 * np.log2(c[c > 1]), 63).astype(np.int32)})

    sums = table(found.mapInArrow(cut, "part long, x binary").groupBy("part").applyInArrow(often, "x long, c int"), "often")
    cells = min(1 << max(10, (16 * sums.count()).bit_length()), 1 << (max_order_kb * 1024).bit_length() - 1)
    cell = F.col("x").bitwiseAND(F.lit(cells - 1).cast("long"))
    part = min(cells, CELLS)

    def fill(t: pa.Table) -> pa.Table:
        out = np.zeros(part, np.uint8)
        np.maximum.at(out, t["cell"].to_numpy() % part, t["c"].to_numpy().astype(np.uint8))
        return pa.table({"seg": pa.array([int(t["cell"][0].as_py()) // part]), "cells": pa.array([out.tobytes()], pa.binary())})

    top = sums.groupBy(cell.alias("cell")).agg(F.max("c").alias("c"))
    out = np.zeros(cells, np.uint8)
    for seg, data in top.groupBy(F.floor(F.col("cell") / part)).applyInArrow(fill, "seg long, cells binary").collect():  # no more than cells bytes
        out[seg * part : (seg + 1) * part] = np.frombuffer(data, np.uint8)
    return out


def blocked(nodes: DataFrame, weight: Column, most: int, in_bucket: int, total: int, near: bool = False) -> DataFrame:
    """(sig, label, bucket, side): buckets in which all pairs of the nodes (sig, label, size)
    of one label meet. A label of more than most in weight is cut into blocks of about most,
    by size, and each pair of its blocks is a bucket, with near only if they are the same or
    side by side; smaller ones share buckets."""
    heavy = nodes.groupBy("label").agg(F.sum(weight).alias("sum")).where(F.col("sum") > most).select("label")
    by = Window.partitionBy("label").orderBy("size", "sig")
    large = nodes.join(heavy, "label", "left_semi").withColumn("i", F.floor(F.sum(weight).over(by.rowsBetween(Window.unboundedPreceding, 0)) / most)).withColumn("last", F.max("i").over(Window.partitionBy("label")))
    low, high = (F.greatest(F.col("i") - 1, F.lit(0)), F.least(F.col("i") + 1, "last")) if near else (F.lit(0), F.col("last"))
    j = F.explode(F.sequence(low.cast("long"), high)).alias("j")
    side = F.when(F.col("i") == F.col("j"), -1).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("int").alias("side")
    pairs = large.select("sig", "label", "i", j).select("sig", "label", F.xxhash64("label", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), side)
    small = nodes.join(heavy, "label", "left_anti").select("sig", "label", F.pmod(F.xxhash64("label"), F.lit(max(1, total // in_bucket))).alias("bucket"), F.lit(-1).alias("side"))
    return pairs.unionAll(small)


def remaining(nodes: DataFrame, weight: Column, most: int) -> DataFrame:
    """(sig, label, part, bucket, side): buckets in which all pairs of the nodes (sig, label,
    size, part) of one label but different parts meet, of labels of more than most in weight.
    Two of its largest part need not meet, so blocks of all others meet these and each other."""
    parts = nodes.groupBy("label", "part").agg(F.sum(weight).alias("w"))
    main = parts.groupBy("label").agg(F.sum("w").alias("sum"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("w", "part")).alias("m")).where((F.col("sum") > most) & (F.col("parts") > 1))
    cut = nodes.join(main.select("label", F.col("m.part").alias("main")), "label").withColumn("own", F.col("part") != F.col("main"))
    by = Window.partitionBy("label", "own").orderBy("size", "sig").rowsBetween(Window.unboundedPreceding, 0)
    of = Window.partitionBy("label")
    cut = cut.withColumn("i", F.floor(F.sum(weight).over(by) / most)).withColumn("others", F.max(F.when(F.col("own"), F.col("i"))).over(of)).withColumn("mains", F.max(F.when(~F.col("own"), F.col("i"))).over(of))
    i, j = F.col("i"), F.col("j")

    def met(own: bool, last: str, kind: int, a: Column, b: Column, side: Column) -> DataFrame:
        each = cut.where(F.col("own") == own).select("sig", "label", "part", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(last))).alias("j"))
        return each.select("sig", "label", "part", F.xxhash64("label", F.lit(kind), a, b).alias("bucket"), side.cast("int").alias("side"))

    among = met(True, "others", 1, F.least(i, j), F.greatest(i, j), F.when(i == j, -1).when(i < j, 0).otherwise(1))
    return among.unionAll(met(True, "mains", 2, i, j, F.lit(0))).unionAll(met(False, "others", 2, j, i, F.lit(1)))


class Join:
    """Sets of n-grams of a table (sets: d, h, sig, size), rows without a word (wordless: d, h),
    representatives of sets that may have a partner (reps) and, of each set with a Jaccard
    similarity of at least t to a different one (linked: sig, label, links), the least sig
    of what such pairs connect it with and how many rows have such sets.

    Without count, linked has no links and may hold sets that are alone, and pairs of what
    is connected already are left out: of a large group first blocks side by side by size
    meet, then only what that leaves apart."""

    def __init__(self, df: DataFrame, text: str, doc_id: str, n: int, t: float, max_order_kb: int, block_entries: int, hot: int, bits_per_row: int, max_filter_mb: int, bucket_entries: int, bucket_sets: int = 1 << 14, count: bool = True) -> None:
        spark = df.sparkSession
        kind = df.schema[doc_id].dataType
        every = df.select(col(doc_id).alias("d"), F.xxhash64(col(text)).alias("h"), col(text).alias("t"))
        src = every.where(col("t").isNotNull())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Signatures of documents, and the n-grams of the sample."""
            k, held, count = Kernel(), [], 0
            names = ["d", "h", "sig", "size", "bits", "x"]

            def sample(held: list[np.ndarray], d: pa.Array) -> pa.RecordBatch:
                none = pa.nulls(1, pa.int64())
                return pa.record_batch([pa.nulls(1, d.type), none, none, none, pa.nulls(1, pa.binary()), pa.array([np.sort(np.concatenate(held)).tobytes()], pa.binary())], names)

            for batch in batches:
                for part in pieces(batch, "t"):
                    keys, at = grams(k, part.column(2), n, None)
                    size = np.diff(at)
                    sig = signatures(keys, at)
                    yield pa.record_batch([part.column(0), part.column(1), pa.array(sig.view(np.int64), mask=size == 0), pa.array(size), pa.array(bitmaps(keys, at), pa.binary()), pa.nulls(len(size), pa.binary())], names)
                    held.append(keys[np.repeat(mix(sig) % U(SAMPLE) == 0, size)])
                    count += len(held[-1])
                    if count >= 1 << 19:
                        yield sample(held, part.column(0))
                        held, count = [], 0
            if count:
                yield sample(held, part.column(0))

        long = lambda *names: [T.StructField(x, T.LongType()) for x in names]
        found = table(every.mapInArrow(scan, T.StructType([T.StructField("d", kind), *long("h", "sig", "size"), T.StructField("bits", T.BinaryType()), T.StructField("x", T.BinaryType())])), "ngrams")
        self.sets = found.where("sig is not null").select("d", "h", "sig", "size")
        self.wordless = found.where("size = 0").select("d", "h")
        entries, total = self.sets.agg(F.coalesce(F.sum(F.ceil(F.col("size") * (1 - t)) + 1), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
        classes = spark.sparkContext.broadcast(_classes(found.where("x is not null").select("x"), int(total), max_order_kb))
        self.classes = classes
        blocks = max(1, -(-int(entries) // block_entries))

        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The prefixes of a few million entries, cut by block of columns."""
            k, held, count = Kernel(), [], 0

            def flush(held: list) -> Iterator[pa.RecordBatch]:
                sig, size, p, key = (np.concatenate(x) for x in zip(*held))
                doc = np.repeat(np.arange(len(sig)), p)
                block = (mix(key & HASH) % U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                ends = np.searchsorted(block[order], np.arange(blocks + 1))
                for b in range(blocks):
                    x = order[ends[b] : ends[b + 1]]
                    if len(x):
                        own, c = runs(doc[x])
                        data = [sig[own].tobytes(), size[own].astype(np.int32).tobytes(), c.astype(np.int32).tobytes(), (key[x] & MASK32).astype(np.uint32).tobytes()]
                        yield pa.record_batch([pa.array([b]), *(pa.array([y], pa.binary()) for y in data)], ["block", "sig", "size", "count", "keys"])

            for batch in batches:
                for part in pieces(batch, "t"):
                    keys, at = grams(k, part.column(0), n, classes.value)
                    size = np.diff(at)
                    p = np.where(size > 0, prefix_size(size, t), 0)
                    first = np.arange(len(keys)) - np.repeat(at[:-1], size) < np.repeat(p, size)
                    held.append((signatures(keys, at), size, p, keys[first]))
                    count += int(p.sum())
                    if count >= 1 << 20:
                        yield from flush(held)
                        held, count = [], 0
            if held:
                yield from flush(held)

        def bounded(tiles: pa.Table) -> pa.Table:
            """Pairs, overlap counts and what their sum must reach; 0 asks for nothing."""
            found = [pa.table([a.view(np.int64), b.view(np.int64), c.astype(np.int32), np.where(c > 0, least(sa, sb), 0).astype(np.int32)], COUNT.names) for a, b, sa, sb, c in block_product(tiles, t, hot)]
            give_back()
            return pa.concat_tables(found) if found else COUNT.empty_table()

        def least(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
            return required(sa, sb, t) - np.maximum(sa - prefix_size(sa, t), sb - prefix_size(sb, t))

        counts = src.select("t").mapInArrow(tiles, "block long, sig binary, size binary, count binary, keys binary").groupBy("block").applyInArrow(bounded, "a long, b long, c int, need int")
        # a link counts 0 and needs 0, so it stays whatever the pair's other counts are
        sums = counts.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need"))
        links = table(sums.where(F.col("c") >= F.col("need")).select("a", "b"), "links")
        nodes = table(links.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "nodes")
        wanted, bits = plain_filter(nodes, "sig", nodes.count(), bits_per_row, max_filter_mb)
        few = found.where("sig is not null").where(might_contain(df, wanted, bits, F.col("sig"))).join(nodes, "sig", "left_semi").dropDuplicates(["d", "h", "sig"])
        firsts = [F.min(F.struct("d", "h")).alias("r"), F.min("d").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("bits").alias("bits")]
        self.reps = reps = table(few.groupBy("sig").agg(*firsts).select("sig", "r.d", "r.h", "least", "rows", "size", "bits"), "reps")

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each bucket, the forest of the pairs that the bitmaps let pass."""
            for sig, size, bits, label, side in buckets(batches):
                top, held, count = np.arange(len(sig)), [], 0
                for i, j in partners(size, bits, label, side, t, lambda: top):
                    held.append((np.full(len(j), i), j))
                    count += len(j)
                    if count >= 1 << 17:
                        top, held, count = merged(top, *map(np.concatenate, zip(*held))), [], 0
                if count:
                    top = merged(top, *map(np.concatenate, zip(*held)))
                node = np.flatnonzero(top != np.arange(len(top)))
                yield pa.record_batch([sig[node].view(np.int64), sig[top[node]].view(np.int64)], ["a", "b"])

        def grouped(edges: DataFrame, of: DataFrame) -> DataFrame:
            return components(edges, of).join(reps.select("sig", "size"), "sig")

        coarse = table(grouped(links, nodes), "groups")
        routed = blocked(coarse, F.lit(1), bucket_sets, 512, nodes.count()).join(reps.select("sig", "size", "bits"), "sig")
        routed = routed.select("bucket", "sig", "size", "bits", "label", "side").repartition("bucket").sortWithinPartitions("bucket")
        edges = table(routed.mapInArrow(refine, "a long, b long"), "edges")
        left = table(edges.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "left")
        refined, many = table(grouped(edges, left), "refined"), left.count()
        groups = blocked(refined, F.col("size"), bucket_entries, 512, many, not count).join(reps.select("sig", "rows"), "sig")
        groups = table(groups.withColumn("part", F.col("sig")), "buckets")

        keys = reps.join(left, "sig", "left_semi").select(F.xxhash64("d", "h").alias("k"))
        packed, bits = plain_filter(keys, "k", many, bits_per_row, max_filter_mb)
        chosen = src.where(might_contain(df, packed, bits, F.xxhash64("d", "h")))

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = Kernel()
            for batch in batches:
                for part in pieces(batch, "t"):
                    sig, sets = whole(k, part.column(0), n)
                    yield pa.record_batch([pa.array(sig.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["sig", "keys"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each bucket, the forest of its pairs and what each set has of partners there."""
            for sig, keys, number, label, side, part in buckets(batches):
                # a filter lets rows pass that are no representatives: equal sets come again
                _, first = np.unique(np.stack([sig, side.astype(U)], axis=1), axis=0, return_index=True)
                sig, number, rows = sig[first], number[first], len(first)
                _, alike, own = np.unique(part[first], return_index=True, return_inverse=True)
                top, links = alike[own], np.zeros(rows, np.int64)
                for a, b, *_ in exact_pairs(np.arange(rows), [np.frombuffer(keys[i], U) for i in first], side[first], t, label[first], known=None if count else lambda: top):
                    links += (np.bincount(a, number[b], rows) + np.bincount(b, number[a], rows)).astype(np.int64)
                    top = merged(top, a, b)
                some = np.flatnonzero(links if count else top != np.arange(rows))
                yield pa.record_batch([sig[some].view(np.int64), sig[top[some]].view(np.int64), links[some]], ["a", "b", "links"])

        def verified(groups: DataFrame, name: str) -> DataFrame:
            complete = chosen.select("t").mapInArrow(full, "sig long, keys binary").join(groups, "sig")
            complete = complete.select("bucket", "sig", "keys", "rows", "label", "side", "part").repartition("bucket").sortWithinPartitions("bucket")
            return table(complete.mapInArrow(verify, "a long, b long, links long"), name)

        exact = verified(groups, "exact")
        if count:
            sums = table(exact.groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("links")), "sums")
            self.linked = components(exact.where("a <> b"), sums.select("sig")).join(sums, "sig")
            return
        large = refined.groupBy("label").agg(F.sum("size").alias("sum")).where(F.col("sum") > bucket_entries)
        if not large.isEmpty():
            joined = components(exact, left).withColumnRenamed("label", "part")
            apart = table(remaining(refined.join(joined, "sig"), F.col("size"), bucket_entries).withColumn("rows", F.lit(1).cast("long")), "apart")
            if not apart.isEmpty():
                exact = exact.unionAll(verified(apart, "rest"))
        self.linked = components(exact, left)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns but the first, of the rows of one bucket after another: whole numbers
    as arrays, sig without a sign, bytes as a list."""
    held: list[pa.RecordBatch] = []

    def take() -> list:
        t = pa.Table.from_batches(held)
        return [t[c].to_pylist() if pa.types.is_binary(t.schema.field(c).type) else t[c].to_numpy().view(U) if c == "sig" else t[c].to_numpy().astype(np.int64) for c in t.column_names[1:]]

    for batch in batches:
        b = batch.column(0).to_numpy()
        edges = np.flatnonzero(b[1:] != b[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
            if held and held[-1].column(0)[0].as_py() != int(b[lo]):
                yield take()
                held.clear()
                give_back()
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield take()


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of the component of each."""
    nodes, _ = runs(np.sort(np.concatenate([a, b])))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[parent]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def merged(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """top, the least row of what each row is connected with, after the edges of a and b."""
    a, b = top[a], top[b]
    if (a == b).all():
        return top
    node, least = contract(a[a != b], b[a != b])
    to = np.arange(len(top))
    to[node] = least
    return to[top]


def components(edges: DataFrame, nodes: DataFrame, local_edges: int = 4 << 20) -> DataFrame:
    """(sig, label): the least sig of the connected component of each node.

    Each task first contracts its edges to a forest, of less edges than nodes. A
    forest that is measured to be at most local_edges is contracted in one task.
    Beyond that, labels go to neighbours' least labels and then to the label of the
    label, so that the number of rounds grows with the logarithm of a component's
    diameter; each round ends in a table in the shared folder."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) >= local_edges // 2:
                node, top = contract(a, b)
                a, b = node[node != top], top[node != top]
                if len(a) >= local_edges // 2:
                    yield pa.record_batch([a, b], ["sig", "label"])
                    a, b = a[:0], b[:0]
        node, top = contract(a, b)
        yield pa.record_batch([node[node != top], top[node != top]], ["sig", "label"])

    forest = table(edges.select("a", "b").mapInArrow(shrink, "sig long, label long"), "forest")
    if forest.count() <= local_edges:
        small = forest.coalesce(1).mapInArrow(shrink, "sig long, label long")
        return nodes.join(small, "sig", "left").select("sig", F.coalesce("label", "sig").alias("label"))
    both = table(forest.select(F.col("sig").alias("a"), F.col("label").alias("b")).unionAll(forest.select(F.col("label").alias("a"), F.col("sig").alias("b"))), "edges")
    labels = nodes.select("sig", F.col("sig").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels.sig == near.a, "left").select("sig", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        up = hooked.select(F.col("sig").alias("label"), F.col("label").alias("top"))
        step = table(hooked.join(up, "label", "left").select("sig", "old", F.coalesce("top", "label").alias("label")), "labels")
        labels = step.select("sig", "label")
        if step.where("old <> label").isEmpty():
            return labels


def jaccard_join(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3, threshold: float = 0.6,
    max_order_kb: int = 1 << 16, block_entries: int = 9 << 18, hot: int = 64, bits_per_row: int = 16, max_filter_mb: int = 64, bucket_entries: int = 1 << 19,
) -> DataFrame:
    """(doc_id, class_id, links) of each document: pairs of documents whose sets of word
    n-grams, without case and signs, have a Jaccard similarity of at least threshold are
    links; class_id is the least doc_id that links connect it with, links is how many
    other documents it has a link to, copies and documents with the same set included.

    Documents with the same set are one row of the incidence matrix. What it is
    multiplied for is never listed: a class of any size gives a row a document.

    The matrix of documents by n-grams is cut into blocks of columns of about
    block_entries entries. Of each row only the prefix that any partner must meet
    is multiplied, rare n-grams first; each block gives overlap counts, their sums
    drop pairs below the bound that sizes set. A column of more than hot rows only links
    its rows. What links or surviving pairs connect meets as bitmaps of its sets, of which
    each pair's overlap has a bound; what pairs within that bound connect meets with its
    whole sets, 64-bit hashes of all n-grams, and every pair is counted. A connected group of
    more than bucket_entries n-grams is cut into blocks, and each pair of blocks is worked
    on by itself: no task holds a group as a whole, and what travels grows with the
    documents, not with the pairs. All partners are found: there is no cap on them. A
    broadcast table of at most max_order_kb tells frequent n-grams, counted in the sets of
    which one in SAMPLE is taken, and only sets the order.

    Texts of fewer than n words have one n-gram, all their words. Null texts and
    texts without a word are alone in their classes, without links. Rows equal in doc_id
    and text are one document; different texts with one doc_id are documents of their own,
    with rows of their own. A class is named by the least doc_id that is not null, by null
    if it has none. An empty table gives no rows.
    """
    j = Join(df, text, doc_id, n, threshold, max_order_kb, block_entries, hot, bits_per_row, max_filter_mb, bucket_entries)
    members = j.sets.distinct()
    own = members.groupBy("sig").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("rows"))
    linked = table(j.linked.join(j.reps.select("sig", "least"), "sig"), "linked")
    classes = linked.groupBy("label").agg(F.min("least").alias("class_id"))
    classes = linked.join(classes, "label").select("sig", "class_id", "links")
    own = own.join(classes, "sig", "left").select("sig", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"))
    out = members.join(own, "sig").select(F.col("d").alias("doc_id"), "class_id", "links")
    return out.unionAll(j.wordless.distinct().select(F.col("d").alias("doc_id"), F.col("d").alias("class_id"), F.lit(0).cast("long").alias("links")))


def near_dedup(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 3, threshold: float = 0.6,
    max_order_kb: int = 1 << 16, block_entries: int = 9 << 18, hot: int = 64, bits_per_row: int = 16, max_filter_mb: int = 64, bucket_entries: int = 1 << 19, max_broadcast_mb: int = 16,
) -> DataFrame:
    """df with one document of each class of jaccard_join: the
    one with the least (doc_id, hash of text), nulls first.

    Texts that are null or without a word stay; rows equal in doc_id and text stay or
    go together. Only the ids to drop are joined, broadcast if they are measured to
    be below max_broadcast_mb. Classes need no number of links, so pairs of what is
    connected already are not counted.
    """
    j = Join(df, text, doc_id, n, threshold, max_order_kb, block_entries, hot, bits_per_row, max_filter_mb, bucket_entries, count=False)
    members = j.sets.distinct().join(j.linked.select("sig", "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    w = Window.partitionBy("label").orderBy("d", "h")
    gone = table(members.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("d", "h"), "gone")
    small = gone.count() * 24 <= max_broadcast_mb << 20
    key = fresh(df, "__h")
    right = gone.select(F.col("d").alias(fresh(df, "__d")), F.col("h").alias(key + "2"))
    keyed = df.withColumn(key, F.xxhash64(col(text)))
    on = col(doc_id).eqNullSafe(F.col(right.columns[0])) & (F.col(key) == F.col(key + "2"))
    return keyed.join(F.broadcast(right) if small else right, on, "left_anti").select(*[col(c) for c in df.columns])
