"""Vector best-fit packing of documents into training sequences."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.kernels import Kernel, bytes_of, pieces
from attestry.llm.shared import col, table

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Capacity(NamedTuple):
    """Of a bin: tokens, documents, and attention cost, the sum of squared lengths: at the
    default, half of what one document that fills the bin would cost."""

    tokens: int = 4096
    documents: int = 32
    attention: int = 4096 * 4096 // 2


def token_counter(path: str, pattern: str):
    """Counts byte-level BPE tokens of texts with the ranks in a .tiktoken file.

    The pattern never lets a token cross from a word into the blanks after it, so a
    text is the sum of its units, blanks and the word after them. Each different
    unit of a batch is encoded once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kernel, known = Kernel(), {}

    def count(arr: pa.Array) -> np.ndarray:
        text, offs = bytes_of(arr)
        if not len(text):
            return np.zeros(len(arr), np.int64)
        blank = BLANK[text]
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        first = offs[:-1][np.diff(offs) > 0]
        start[first] = True
        starts = np.flatnonzero(start)
        ends = np.concatenate([starts[1:], [len(text)]])
        h = kernel.ranges(kernel.prefix(text), starts, ends)
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        sample = order[new]
        data = text.tobytes()
        n = np.empty(len(sample), np.int64)
        for i, (x, a, b) in enumerate(zip(s[new].tolist(), starts[sample].tolist(), ends[sample].tolist())):
            c = known.get(x)
            if c is None:
                c = len(encoding.encode_ordinary(data[a:b].decode("utf-8", "replace")))
                if len(known) < 1 << 17:  # about 15 MB
                    known[x] = c
            n[i] = c
        each = np.empty(len(starts), np.int64)
        each[order] = n[np.cumsum(new) - 1]
        c = np.concatenate([[0], np.cumsum(each)])
        at = np.searchsorted(starts, offs)
        return c[at[1:]] - c[at[:-1]]

    return count


def best_fit(lengths: np.ndarray, cap: Capacity, rule: str, weights: tuple[float, float, float]) -> np.ndarray:
    """Bin of each item, items taken in the given order. Of the open bins in which an
    item fits under every capacity, dot takes the one with the largest weighted product
    of demand and residual, norm the one whose residual after it is smallest in the
    weighted norm; shares of capacity count, and the oldest of equal bins wins."""
    full = np.array(cap, float)
    w = np.array(weights)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1)
    residual = np.empty((max(len(lengths), 1), 3))
    live = np.empty(max(len(lengths), 1), np.int64)
    out = np.empty(len(lengths), np.int64)
    bins = opened = 0
    least = np.minimum.accumulate(demand[::-1], axis=0)[::-1]  # what the smallest item from here on needs
    for i, d in enumerate(demand):
        r = residual[:opened]
        fits = np.flatnonzero((r >= d).all(axis=1))
        if len(fits):
            if rule == "dot":
                at = fits[np.argmax((r[fits] / full) @ (w * d / full))]
            else:
                at = fits[np.argmin(((((r[fits] - d) / full) ** 2) * w).sum(axis=1))]
        else:
            at = opened
            residual[at], live[at] = full, bins
            bins, opened = bins + 1, opened + 1
        residual[at] -= d
        out[i] = live[at]
        if i + 1 < len(demand) and (residual[at] < least[i + 1]).any():  # nothing fits any more: closed
            residual[at : opened - 1], live[at : opened - 1] = residual[at + 1 : opened].copy(), live[at + 1 : opened].copy()
            opened -= 1
    return out


def pack(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.3),
    tokenizer: str | None = None, pattern: str | None = None, shard_pieces: int = 8192, longest: int = 2560,
) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, slot): the bin of each piece of
    each document; a document of more than longest tokens is cut into pieces of so many
    and a rest, and nothing of it is left out. longest stays below what fills a bin under
    any capacity, so that what it leaves of the others can be filled; it never exceeds
    the tokens of a bin or the root of its attention cost.

    Pieces are taken by falling length (ties by the hash of the id, then the piece) and
    put into the open bin that the rule, dot or norm, selects among those with room in
    tokens, documents and attention cost (the sum of squared lengths). Only ids and
    counts travel. Pieces are dealt to shards of about shard_pieces by a hash of id and
    text, as many shards as the data need, each packed by itself: more data give more
    shards, and only a shard's last bins stay underfull. bin_id is the shard << 32 plus
    the number in it; slot is the place in the bin.

    Tokens are those of the byte-level BPE in the file tokenizer, cut by pattern; by
    default a public vocabulary of 50,256 ranks. Null and empty texts have no tokens
    and are in no bin. Rows equal in id and text each have pieces of their own. A null
    id is kept as null. An empty table gives no rows. Other columns are not read.
    """
    if capacity.tokens < 1 or capacity.documents < 1 or capacity.attention < 1:
        raise ValueError("capacities must be positive")
    longest = min(longest, capacity.tokens, isqrt(capacity.attention))
    if longest < 1:
        raise ValueError("a piece has a token at least")
    path, cut = tokenizer, pattern
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if cut is None:
        import public_tokenizers

        cut = public_tokenizers.PATTERN
    kind = df.schema[doc_id].dataType
    src = df.where(F.octet_length(col(text)) > 0).select(col(doc_id).alias("d"), F.xxhash64(col(doc_id), col(text)).alias("h"), col(text).alias("t"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path, cut)
        for batch in batches:
            for part in pieces(batch, "t"):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(count(part.column(2)))], ["d", "h", "n"])

    counts = table(src.mapInArrow(measure, T.StructType([T.StructField("d", kind), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])), "counts")
    total = counts.agg(F.coalesce(F.sum(F.ceil(F.col("n") / longest)), F.lit(0))).collect()[0][0]
    shards = max(1, -(-int(total) // shard_pieces))

    def fill(t: pa.Table) -> pa.Table:
        n, h = t["n"].to_numpy(), t["h"].to_numpy()
        times = -(-n // longest)
        row = np.repeat(np.arange(len(n)), times)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        size = np.minimum(longest, n[row] - piece * longest)
        order = np.lexsort((piece, h[row], -size))
        bins = best_fit(size[order], capacity, rule, weights)
        by = np.argsort(bins, kind="stable")
        slot = np.empty(len(bins), np.int64)
        b = bins[by]
        new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        slot[by] = np.arange(len(b)) - np.repeat(new, np.diff(np.concatenate([new, [len(b)]])))
        row, piece, size = row[order], piece[order], size[order]
        shard = t["shard"].to_numpy()[0] << 32
        return pa.table([t["d"].take(pa.array(row)), *(pa.array(x) for x in (piece.astype(np.int32), piece * longest, size, shard + bins, slot.astype(np.int32)))], ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "slot"])

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("bin_id", T.LongType()), T.StructField("slot", T.IntegerType())])
    return counts.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInArrow(fill, out)
