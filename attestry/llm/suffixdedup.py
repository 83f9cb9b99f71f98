"""Substring dedup by suffix arrays and longest-previous-factor arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.bloom import repeated
from attestry.llm.kernels import Kernel, U, blank_lut, bytes_of, mix, ngrams, owners, pieces
from attestry.llm.shared import col, table

K = 16
PLACE = 28  # bits of a place in a piece of text
LEVELS = 8  # ranks of 1, 2, 4 ... 128 words
MEMORY = 24 << 20  # bytes of runs that a task remembers


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w in a row, by doubling."""
    m, have = g, 1
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[: len(g) - w + 1], m[w - have : w - have + len(g) - w + 1])


def super_mers(k: Kernel, arr: pa.Array, least: int) -> tuple:
    """Runs of windows of least words with one minimiser, the leftmost of the least
    n-grams: the bytes, word starts and ends, word offsets of documents; of each run
    the minimiser, its first window and how many, and its document."""
    text, offs = bytes_of(arr)
    h, starts, ends, wo = k.words(text, offs, blank_lut())
    if len(h) < least:
        none = np.zeros(0, np.int64)
        return text, starts, ends, wo, np.zeros(0, U), none, none, none
    size = min(K, least)
    g, _ = ngrams(h, wo, size)
    g = g[: len(g) - size + 1]
    low = U((1 << PLACE) - 1)
    p = (sliding_min((g & ~low) | np.arange(len(g)).astype(U), least - size + 1) & low).astype(np.int64)
    own = owners(wo)
    at = np.flatnonzero(np.arange(len(p)) + least <= wo[1:][own[: len(p)]])
    p, doc = p[at], own[at]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])])) if len(p) else at
    return text, starts, ends, wo, g[p[new]], at[new], np.diff(np.concatenate([new, [len(p)]])), doc[new]


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, the same for equal keys."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
    return out


def smaller(order: np.ndarray) -> np.ndarray:
    """Of each place, the nearest place before it with a smaller value, or -1: all
    places follow their links at once until none is left to follow."""
    p = np.arange(len(order)) - 1
    todo = np.arange(1, len(order))
    while len(todo):
        q = p[todo]
        todo = todo[(q >= 0) & (order[np.maximum(q, 0)] >= order[todo])]
        p[todo] = p[p[todo]]
    return p


def lpf(words: np.ndarray, text: np.ndarray, at: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor in words, and an index into at of where it stands
    before, for the suffixes at the given places. text numbers the text of each word;
    a suffix ends with its text. position: places in the order of the corpus."""
    n = len(words)
    ranks = [dense(words)]
    for level in range(1, LEVELS):
        step = 1 << (level - 1)
        r = ranks[-1]
        next_ = np.zeros(n, np.int64)
        if step < n:
            next_[: n - step] = np.where(text[step:] == text[: n - step], r[step:], 0)
        ranks.append(dense(r.astype(U) * U(n + 1) + next_.astype(U)))
    sa = np.lexsort((position, ranks[-1][at]))
    order = position[sa]
    before = smaller(order)
    back = smaller(order[::-1])
    after = np.where(back[::-1] < 0, -1, len(order) - 1 - back[::-1])
    best, source = np.zeros(len(sa), np.int64), np.full(len(sa), -1)
    last = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]])) + 1
    ends = last[np.searchsorted(last, np.arange(n), "right")]
    for other in (before, after):
        i = np.flatnonzero(other >= 0)
        a, b = at[sa[i]], at[sa[other[i]]]
        most = np.minimum(ends[a] - a, ends[b] - b)
        length = np.zeros(len(i), np.int64)
        for level in range(LEVELS - 1, -1, -1):
            # a rank tells equal words only if both stretches lie within their texts
            step = 1 << level
            while True:
                same = np.flatnonzero(length + step <= most)
                same = same[ranks[level][a[same] + length[same]] == ranks[level][b[same] + length[same]]]
                length[same] += step
                if level < LEVELS - 1 or not len(same):
                    break
        better = length > best[i]
        best[i[better]], source[i[better]] = length[better], sa[other[i[better]]]
    out, src = np.empty(len(sa), np.int64), np.empty(len(sa), np.int64)
    out[sa], src[sa] = best, source
    return out, src


def find_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50, batch_words: int = 1 << 19) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): the spans of characters in which a
    document repeats at least min_words words that stand earlier in the corpus, in
    the order of (doc_id, hash of text, position); first_doc_id is a document with an
    earlier copy of its beginning (of several any, by how the table is split). Words are what blanks separate, compared as they
    are. Removing the spans leaves the first copy of everything.

    The suffix array is distributed by minimisers: windows of min_words words with the
    same least 16-gram meet in one bucket, so equal windows always do. Only those
    windows travel whose 16-gram occurs again; that is found by Bloom filters over ranges
    of hashes, and documents are joined to it by id. In a bucket the suffix array
    comes from doubled ranks, and previous and next smaller positions in suffix order
    give each suffix its longest previous factor. Runs of the same words as an earlier
    one count as repeated without entering the suffix array: within a task, which sends
    of equal runs the earliest only, and again where they meet, where none is kept.

    A bucket is worked on in batches of batch_words words; the different runs of one
    minimiser are never parted, and lie in one task's memory.

    Null, empty and shorter texts have no spans. Repeats within a document count.
    Rows equal in doc_id and text are one document. A null doc_id comes last. An empty
    table gives no rows. Other columns are not read.
    """
    src = df.select(col(doc_id).alias("d"), F.xxhash64(col(doc_id), col(text)).alias("h"), col(text).alias("t")).where(F.octet_length("t") >= 2 * min_words - 1)
    kind = df.schema[doc_id].dataType

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Kernel()
        for batch in batches:
            for part in pieces(batch, "t"):
                *_, m, _, _, doc = super_mers(k, part.column(1), min_words)
                if len(m):
                    # once a document, so that equal rows don't count as a repetition
                    order = np.lexsort((m, doc))
                    m, doc = m[order], doc[order]
                    new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]))
                    n = np.diff(np.concatenate([new, [len(m)]]))
                    yield pa.record_batch([pa.array(m[new].view(np.int64)), part.column(0).take(pa.array(doc[new])), pa.array(n > 1)], ["m", "h", "within"])

    found = table(src.select("h", "t").mapInArrow(minimisers, "m long, h long, within boolean"), "minimisers")
    twice = F.explode(F.when(F.col("within"), F.array("m", "m")).otherwise(F.array("m")))
    again = repeated(found.select(twice.alias("m")), "m", found.count())
    # an m of many documents is a join of 16 bytes a row, which may be split
    wanted = found.select("m", "h").join(again, F.col("m") == F.col("k"), "left_semi").groupBy("h").agg(F.collect_set("m").alias("ms")).withColumnRenamed("h", "h2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs with their bytes; without, and with the earlier document as s, those that
        this task has sent for an earlier place."""
        k, seen, memory = Kernel(), {}, 0
        for batch in batches:
            for part in pieces(batch, "t"):
                b, starts, ends, wo, m, at, n, doc = super_mers(k, part.column(2), min_words)
                if not len(m):
                    continue
                ms = part.column(3)
                lengths = pc.list_value_length(ms).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(ms)), lengths).astype(U)
                keep = np.isin(mix(m + mix(doc.astype(U))), mix(ms.flatten().to_numpy().view(U) + mix(owner)))
                m, at, n, doc = m[keep], at[keep], n[keep], doc[keep]
                last = at + n + min_words - 2
                chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
                offs = bytes_of(part.column(2))[1]
                data = b.tobytes()
                raw = [data[x:y] for x, y in zip(starts[at].tolist(), ends[last].tolist())]
                d, h = part.column(0).to_pylist(), part.column(1).to_pylist()
                source, sent = np.full(len(raw), -1), np.ones(len(raw), bool)
                firsts = []
                for i, (x, y, w) in enumerate(zip(raw, doc.tolist(), (at - wo[doc]).tolist())):
                    place = (d[y] is None, d[y], h[y], w)
                    first = seen.get(x)
                    if first is None or place < first:
                        seen[x] = place
                        memory += len(x) + 300
                    else:
                        raw[i], sent[i], source[i] = None, place > first, len(firsts)
                        firsts.append(first[1])
                if memory > MEMORY:
                    seen, memory = {}, 0
                m, at, n, doc, last, source, raw = m[sent], at[sent], n[sent], doc[sent], last[sent], source[sent], [x for x, y in zip(raw, sent) if y]
                take, base = pa.array(doc), chars[offs[doc]]
                s = pa.array(firsts, part.column(0).type).take(pa.array([None if x < 0 else x for x in source.tolist()], pa.int64()))
                yield pa.record_batch(
                    [pa.array(m.view(np.int64)), part.column(0).take(take), part.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (at - wo[doc], last + 1 - wo[doc], chars[starts[at]] - base, chars[ends[last]] - base, n)), pa.array(raw, pa.binary()), s],
                    ["m", "d", "h", "w", "x", "c", "e", "n", "raw", "s"],
                )

    ints = lambda *names: [T.StructField(x, T.IntegerType()) for x in names]
    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("d", kind), T.StructField("h", T.LongType()), *ints("w", "x", "c", "e", "n"), T.StructField("raw", T.BinaryType()), T.StructField("s", kind)])
    hit = src.join(wanted, src.h == wanted.h2).select("d", "h", "t", "ms")
    mers = hit.mapInArrow(cut, schema).repartition(F.when(F.col("raw").isNull(), F.xxhash64("d", "h", "w")).otherwise(F.col("m"))).sortWithinPartitions(F.col("m"), F.col("raw"), F.col("d").asc_nulls_last(), F.col("h"), F.col("w"))

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, count, last = Kernel(), [], 0, None
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("raw")))
            if known.num_rows:
                yield known.select(SPAN)
            batch = batch.filter(pc.is_valid(batch.column("raw")))
            if not batch.num_rows:
                continue
            repeats, batch, last = collapse(k, batch, last)
            if repeats.num_rows:
                yield repeats
            if not batch.num_rows:
                continue
            at = 0
            m = batch.column(0).to_numpy()
            edges = np.flatnonzero(m[1:] != m[:-1]) + 1
            for stop in [*edges.tolist(), len(m)]:
                # a minimiser's rows may go on in the next batch: what is held is worked
                # on only when another minimiser begins
                if held and count >= batch_words and held[-1].column(0)[-1].as_py() != m[at]:
                    yield from spans(k, pa.Table.from_batches(held), min_words)
                    held, count = [], 0
                held.append(batch.slice(at, stop - at))
                count += (stop - at) * (min_words + 16)
                at = stop
        if held:
            yield from spans(k, pa.Table.from_batches(held), min_words)

    out = T.StructType([T.StructField("d", kind), T.StructField("h", T.LongType()), *ints("w", "x", "c", "e"), T.StructField("s", kind)])
    pieces_ = mers.mapInArrow(factors, out).distinct()
    w = Window.partitionBy("d", "h").orderBy("w", "x")
    over = F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(over.isNull() | (F.col("w") > over), 1).otherwise(0)).over(w)
    merged = pieces_.withColumn("i", island).groupBy("d", "h", "i").agg(F.min("c").alias("start"), F.max("e").alias("end"), (F.max("x") - F.min("w")).alias("n_words"), F.min_by("s", "w").alias("s"))
    return merged.select(F.col("d").alias("doc_id"), "start", "end", "n_words", F.col("s").alias("first_doc_id"))


SPAN = ["d", "h", "w", "x", "c", "e", "s"]


def collapse(k: Kernel, b: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, pa.RecordBatch, tuple]:
    """Of runs sorted by minimiser, bytes and place, after a run last: the repeated ones
    as spans, the first of each, and the last run. Equal rows count once."""
    raw, offs = bytes_of(b.column("raw"))
    m, h, w = (b.column(c).to_numpy() for c in ("m", "h", "w"))
    whole = k.ranges(k.prefix(raw), offs[:-1], offs[1:])
    same = np.concatenate([[last is not None and last[0] == m[0]], (m[1:] == m[:-1]) & (whole[1:] == whole[:-1]) & (np.diff(offs)[1:] == np.diff(offs)[:-1])])
    data = b.column("raw")
    for i in np.flatnonzero(same).tolist():  # hashes agree; now the bytes
        same[i] = data[i].as_py() == (data[i - 1].as_py() if i else last[1])
    d = b.column("d")
    again = same.copy()
    for i in np.flatnonzero(same).tolist():  # an equal row stands beside its twin
        again[i] = (h[i], w[i], d[i].as_py()) != ((h[i - 1], w[i - 1], d[i - 1].as_py()) if i else last[2:5])
    lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
    rows = np.flatnonzero(again)
    heads = pa.array(np.where(lead[rows] < 0, 0, lead[rows]))
    s = d.take(heads) if last is None or (lead[rows] >= 0).all() else pa.array([d[j].as_py() if j >= 0 else last[5] for j in lead[rows].tolist()], d.type)
    some = b.take(pa.array(rows)).select(SPAN[:-1])
    end = (int(m[-1]), data[-1].as_py(), h[-1], w[-1], d[-1].as_py(), d[int(lead[-1])].as_py() if lead[-1] >= 0 else last[5])
    return pa.record_batch([*some.columns, s], SPAN), b.filter(pa.array(~same)), end


def spans(k: Kernel, t: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Of different runs sorted by minimiser: the repeated stretches, by words (w to x) and
    characters (c to e) of their document, and where the first stands (s)."""
    t = t.combine_chunks()
    raw, offs = bytes_of(t["raw"])
    h, starts, ends, wo = k.words(raw, offs, blank_lut())
    w0, c0, n = t["w"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])

    def rows(row: np.ndarray, a: np.ndarray, b: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
        """Words a to b (in all words of t) of each row's run."""
        first = wo[row]
        base = c0[row] - chars[offs[row]]
        take, src = pa.array(row), pa.array(source)
        pick = lambda c, i: pc.take(t[c], i).combine_chunks()
        flat = lambda x: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        return pa.record_batch(
            [flat(pick("d", take)), flat(pick("h", take)), *(pa.array(x.astype(np.int32)) for x in (w0[row] + a - first, w0[row] + b - first, base + chars[starts[a]], base + chars[ends[b - 1]])), flat(pick("d", src))],
            SPAN,
        )

    keep = np.arange(t.num_rows)
    size = np.diff(wo)[keep]
    # words of the runs that are left, and the suffixes that begin a window
    number = np.repeat(np.arange(len(keep)), size)
    word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = wo[keep][number] + word
    at = np.flatnonzero(word < n[keep][number])
    by = pc.sort_indices(pa.table({"d": t["d"], "h": t["h"], "w": t["w"]}).take(pa.array(keep)), sort_keys=[("d", "ascending"), ("h", "ascending"), ("w", "ascending")], null_placement="at_end").to_numpy()
    rank = np.empty(len(keep), np.int64)
    rank[by] = np.arange(len(keep))
    position = (rank[number[at]] << 24) + word[at]
    length, source = lpf(h[place], number, at, position)
    # a run may end inside the match; of one run, stretches that overlap are one
    hit = np.flatnonzero(length >= least)
    if not len(hit):
        return
    run, a = number[at[hit]], word[at[hit]]
    b = a + length[hit]
    end = np.maximum.accumulate(b + run * (1 << 32)) - run * (1 << 32)
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (a[1:] > end[:-1])])
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(b, first)
    row = keep[run[first]]
    yield rows(row, wo[row] + a[first], wo[row] + stop, keep[number[at[source[hit[first]]]]])
