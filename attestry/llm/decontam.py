"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.kernels import STEP, Kernel, U, bytes_of, mix, owners, pieces, word_lut
from attestry.llm.shared import col, fresh

#: Fixed masks of eight read positions; a 0 ignores the token there. They serve items
#: longer than a window; shorter ones have blocks. Of all ways to differ in four of twenty
#: words, each leaves one of the masks whole somewhere (enumerated in the tests).
MASKS = ("1110110111", "11100010010111", "11110001000001011", "110100110111", "110010101111", "1110100001100011", "1011111011")
HITS = 1 << 20  # hits worked on at once


class Index(NamedTuple):
    """The test side: sorted seed hashes with item and position, tokens of all items."""

    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray
    tokens: np.ndarray
    offs: np.ndarray
    ids: list
    masks: tuple
    short: np.ndarray
    door: np.ndarray


def seeds(h: np.ndarray, wo: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the mask fits into one text, and the seed hash there."""
    n = len(mask)
    last = np.repeat(wo[1:], np.diff(wo))
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    g = np.full(len(h) - n + 1, hash_of(mask), U)
    for j, c in enumerate(mask):
        if c == "1":
            g = g * U(STEP) + h[j : len(h) - n + 1 + j]
    at = np.flatnonzero(np.arange(len(g)) + n <= last[: len(g)])
    return at, mix(g[at])


def hash_of(mask: str) -> int:
    return int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64)


def blocks(n: int, share: float) -> list[tuple[int, int]]:
    """(first word, words) of blocks that part n words: one more than words that may
    differ, so that one block at least is equal in whatever matches."""
    parts = min(n, n - int(np.ceil(share * n - 1e-9)) + 1)
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:])]


@cache
def complete(masks: tuple[str, ...], window: int, share: float) -> tuple[str, ...]:
    """masks, and one of as many ones as a run that whatever matches leaves equal, unless
    the masks are seen to leave out no way of differing in a window."""
    most = window - int(np.ceil(share * window - 1e-9))
    fits = [m for m in masks if len(m) <= window]
    if comb(window, most) <= 1 << 16:
        read = [sum(1 << (s + i) for i, c in enumerate(m) if c == "1") for m in fits for s in range(window - len(m) + 1)]
        left = np.array([sum(1 << i for i in c) for c in combinations(range(window), most)], np.int64 if window < 63 else object)
        for r in read:
            left = left[(left & r) != 0]
        if not len(left):
            return masks
    return tuple(dict.fromkeys((*masks, "1" * max(1, window // (most + 1)))))


def build_index(ids: list, texts: list[str | None], masks: tuple[str, ...], floor: int, window: int = 20, share: float = 0.8) -> Index:
    """Items of fewer than floor tokens are in no seed. Items of at most window
    tokens, which match as one window, have a seed for each of their blocks, by which
    none is missed; longer items have one wherever a mask fits."""
    k, masks = Kernel(), complete(tuple(masks), window, share)
    text, offs = bytes_of(pc.utf8_lower(pa.array(texts, pa.large_string())))
    h, _, _, wo = k.words(text, offs, word_lut())
    lengths = np.diff(wo)
    short = lengths <= window
    of: dict[int, list[np.ndarray]] = {}
    for n in np.unique(lengths[short & (lengths >= max(floor, 1))]).tolist():
        first = wo[:-1][lengths == n]
        for x, size in blocks(n, share):
            of.setdefault(size, []).append(first + x)
    own = owners(wo)
    seed, item, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    every = tuple(dict.fromkeys((*masks, *("1" * n for n in sorted(of)))))
    for mask in every:
        p, g = seeds(h, wo, mask)
        good = ~short[own[p]] & (lengths[own[p]] >= floor) if mask in masks else np.zeros(len(p), bool)
        if "0" not in mask and len(mask) in of:
            good |= np.isin(p, np.concatenate(of[len(mask)]))
        p, g = p[good], g[good]
        seed.append(g), item.append(own[p]), at.append(p - wo[own[p]])
    seed, item, at = np.concatenate(seed), np.concatenate(item), np.concatenate(at)
    order = np.argsort(seed, kind="stable")
    seed = seed[order]
    door = np.zeros(1 << 22, bool)
    door[(seed & U((1 << 22) - 1)).astype(np.int64)] = True
    return Index(seed, item[order], at[order], h, wo, list(ids), every, short, door)


def find(ix: Index, k: Kernel, arr: pa.Array, window: int, share: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, matches): of each text and item the best
    window, wherever at least share of its tokens agree on one diagonal."""
    text, offs = bytes_of(pc.utf8_lower(arr))
    h, _, _, wo = k.words(text, offs, word_lut())
    if not len(h) or not len(ix.seed):
        return []
    own, size = owners(wo), np.diff(ix.offs)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def offer(row: int, item: int, first: int, w: int, m: int) -> None:
        if (row, item) not in best or (m, -first) > (best[row, item][2], -best[row, item][0]):
            best[row, item] = (first, w, m)

    far = [np.zeros((0, 3), np.int64)]
    for mask in ix.masks:
        p, g = seeds(h, wo, mask)
        near = ix.door[(g & U((1 << 22) - 1)).astype(np.int64)]
        p, g = p[near], g[near]
        lo, hi = np.searchsorted(ix.seed, g, "left"), np.searchsorted(ix.seed, g, "right")
        p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(p):
            continue
        sums = np.cumsum(n)
        for part in np.split(np.arange(len(p)), np.unique(np.searchsorted(sums, np.arange(HITS, sums[-1], HITS)))):
            pn, pl = n[part], lo[part]
            at, entry = np.repeat(p[part], pn), np.repeat(pl - np.cumsum(pn) + pn, pn) + np.arange(pn.sum())
            item = ix.item[entry]
            found = np.stack([own[at], item, at - ix.at[entry]], axis=1)
            whole = ix.short[item]
            if not whole.all():
                far.append(np.unique(found[~whole], axis=0))
            # an item of one window: all its words against those of the text at once
            row, item, d = found[whole].T
            w = size[item]
            inside = (d >= wo[row]) & (d + w <= wo[row + 1])
            row, item, d, w = row[inside], item[inside], d[inside], w[inside]
            m = np.zeros(len(d), np.int64)
            for j in range(int(w.max()) if len(w) else 0):
                on = np.flatnonzero(w > j)
                m[on] += h[d[on] + j] == ix.tokens[ix.offs[item[on]] + j]
            for i in np.flatnonzero(m >= share * w - 1e-9).tolist():
                offer(int(row[i]), int(item[i]), int(d[i] - wo[row[i]]), int(w[i]), int(m[i]))
    for row, item, d in np.unique(np.concatenate(far), axis=0).tolist():
        a, b = int(ix.offs[item]), int(ix.offs[item + 1])
        lo, hi = max(int(wo[row]) - d, 0), min(int(wo[row + 1]) - d, b - a)
        same = np.concatenate([[0], np.cumsum(h[d + lo : d + hi] == ix.tokens[a + lo : a + hi])])
        w = min(window, b - a)
        if len(same) <= w:
            continue
        sums = same[w:] - same[:-w]
        i = int(sums.argmax())
        m = int(sums[i])
        if m >= share * w - 1e-9:
            offer(row, item, d + lo + i - int(wo[row]), w, m)
    return [(row, item, *x) for (row, item), x in sorted(best.items())]


def _slices(benchmark: DataFrame, item_id: str, text: str, max_index_mb: int) -> Iterator[tuple[list, list]]:
    """The benchmark in parts whose index stays below max_index_mb, each of which
    is broadcast in a pass of its own; a part is a hash range of the item's id."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(col(text))), F.lit(0))).collect()[0][0]
    # a word of six bytes makes four seeds of 24 bytes and a token of 8
    parts = max(1, -(-int(size) * 18 // (max_index_mb << 20)))
    for i in range(parts):
        part = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64(col(item_id)), F.lit(parts)) == i)
        rows = part.select(col(item_id), col(text)).where(col(text).isNotNull()).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        yield [r[0] for r in rows], [r[1] for r in rows]


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
    masks: tuple[str, ...] = MASKS, window: int = 20, share: float = 0.8, floor: int = 5, max_index_mb: int = 64,
) -> DataFrame:
    """(doc_id, item_id, first_word, words, matches) of each document and benchmark
    item with a window of min(window, length of the item) aligned words of which
    at least share are equal, without regard to case and signs.

    Seeds under fixed masks of both sides are joined: the benchmark's seeds are
    broadcast in parts of at most max_index_mb (checked), one pass a part; around
    each hit, the whole diagonal is compared word by word. Items of at most window
    words are parted into blocks of which one must be equal; for longer ones, masks that
    do not leave some mask whole whatever differs get a run of ones beside them that
    does (complete). So no window is missed. A sign of U+3000 to U+DFFF is a word.
    Several windows of one pair give the best one, the earliest of equals.

    Null and empty texts on either side match nothing, nor do items of fewer than
    floor words. Repeated documents each give their rows, except that rows equal in doc_id and item_id
    become one, with the most matches; a null id is reported as null. Empty tables
    give no rows. Other columns are not read.
    """
    kind = df.schema[doc_id].dataType
    item_kind = benchmark.schema[item_id].dataType
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", item_kind), *(T.StructField(c, T.IntegerType()) for c in ("first_word", "words", "matches"))])
    arrow_item = pa.int64() if item_kind == T.LongType() else None
    out = None
    for ids, texts in _slices(benchmark, item_id, item_text, max_index_mb):
        shared = df.sparkSession.sparkContext.broadcast(build_index(ids, texts, masks, floor, window, share))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            k, ix = Kernel(), shared.value
            for batch in batches:
                for part in pieces(batch, "t"):
                    found = find(ix, k, part.column(1), window, share)
                    if found:
                        row, item, *rest = map(list, zip(*found))
                        yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array([ix.ids[i] for i in item], arrow_item), *(pa.array(x, pa.int32()) for x in rest)], ["doc_id", "item_id", "first_word", "words", "matches"])

        part = df.select(col(doc_id).alias("d"), col(text).alias("t")).mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    best = F.max(F.struct("words", "matches", (-F.col("first_word")).alias("n"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.n")).alias("first_word"), "b.words", "b.matches")


def _leaks(shared: Broadcast, window: int, share: float) -> Callable:
    """Whether find finds anything in a text."""

    @F.arrow_udf("boolean")
    def leaks(arr: pa.Array) -> pa.Array:
        out, k, lo = np.zeros(len(arr), bool), Kernel(), 0
        for part in pieces(pa.record_batch([arr], ["t"]), "t"):
            for row, *_ in find(shared.value, k, part.column(0), window, share):
                out[lo + row] = True
            lo += part.num_rows
        return pa.array(out)

    return leaks


def decontaminate(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    masks: tuple[str, ...] = MASKS, window: int = 20, share: float = 0.8, floor: int = 5, max_index_mb: int = 64,
) -> DataFrame:
    """The rows of df in which find_contamination finds nothing, in all columns.

    A filter on each row by itself: nothing shuffles. Null and empty texts stay;
    repeated rows stay or go together; empty tables give all rows of df.
    """
    for ids, texts in _slices(benchmark, item_id, item_text, max_index_mb):
        shared = df.sparkSession.sparkContext.broadcast(build_index(ids, texts, masks, floor, window, share))

        flag = fresh(df, "__leaks")
        df = df.withColumn(flag, _leaks(shared, window, share)(F.coalesce(col(text), F.lit("")))).where(~F.col(flag)).drop(flag)
    return df
