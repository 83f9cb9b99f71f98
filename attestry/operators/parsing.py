"""Of parsed files: batches, page ranges, merges, spans and the digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import c, trim

MAX_FILES, MAX_BYTES, MAX_PAGES = 50, 256 << 20, 200


def group_batches(files: DataFrame, key: str, order: str, size: str, most: int = MAX_FILES, limit: int = MAX_BYTES) -> DataFrame:
    """files with batch, from 0: filled in order up to most files or limit bytes; a file
    above the limit is alone. Each key by itself, in one pass over its sorted rows."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, count, total = object(), 0, 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(key).to_pylist(), b.column(size).to_pylist()):
                n = n or 0
                if k != now:
                    now, batch, count, total = k, 0, 0, 0
                elif count >= most or (count and total + n > limit):
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + n
                out.append(batch)
            yield b.append_column("batch", pa.array(out, pa.int32()))

    ready = files.repartition(key).sortWithinPartitions(key, order)
    return ready.mapInArrow(fill, T.StructType([*files.schema.fields, T.StructField("batch", T.IntegerType())]))


def page_parts(files: DataFrame, pages: str = "pages", most: int = MAX_PAGES) -> DataFrame:
    """A row for each part of at most so many pages: part from 1, first_page, last_page
    (both from 1) and the offset of its pages."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.col(pages), F.lit(1)) - 1, F.lit(most))).alias("page_offset")
    return files.select("*", at).select("*", (F.floor(F.col("page_offset") / most) + 1).cast("int").alias("part"), (F.col("page_offset") + 1).alias("first_page"), F.least(F.col("page_offset") + most, F.col(pages)).alias("last_page"))


def merge_parts(parts: DataFrame, key: str = "doc") -> DataFrame:
    """Markdown of the parts (part, of, pages, markdown) in order, each under a comment."""
    head = F.format_string("<!-- source: %s; pages: %s; part: %d/%d -->\n\n%s", F.col(key), F.col("pages"), F.col("part"), F.col("of"), trim("markdown"))
    each = F.array_sort(F.collect_list(F.struct("part", head.alias("m"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(each, lambda p: p["m"]), "\n\n").alias("markdown"))


def merge_content_lists(parts: DataFrame, key: str = "doc") -> DataFrame:
    """Content lists of the parts (part, page_offset, content_list) as one, with pages
    of the whole."""
    shifted = F.transform("content_list", lambda b: b.withField("page_idx", b["page_idx"] + F.col("page_offset")))
    each = F.array_sort(F.collect_list(F.struct("part", shifted.alias("c"))))
    return parts.groupBy(key).agg(F.flatten(F.transform(each, lambda p: p["c"])).alias("content_list"))


def failures(parts: DataFrame, key: str = "doc") -> DataFrame:
    """Of parts (part, error): success unless all failed, and the errors in order."""
    lost = F.array_sort(F.filter(F.collect_list(F.struct("part", "error")), lambda p: p["error"].isNotNull()))
    return parts.groupBy(key).agg(F.bool_or(F.col("error").isNull()).alias("success"), F.array_join(F.transform(lost, lambda p: p["error"]), "; ").alias("error"))


def merge_results(parts: DataFrame, key: str = "doc") -> DataFrame:
    """Of parts (part, of, pages, page_offset, markdown, content_list, error), one row a
    document: what the good parts hold, in order, and what failures says of the others."""
    good = parts.where("error is null")
    return failures(parts, key).join(merge_parts(good, key), key, "left").join(merge_content_lists(good, key), key, "left")


def split_by_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with a cached result under their digest, and those without."""
    return files.join(cache, "digest", "inner"), files.join(cache.select("digest"), "digest", "left_anti")


def digest(content: Column | str) -> Column:
    return F.sha2(c(content).cast("binary"), 256)


def cache_path(sha: Column | str) -> Column:
    """Two levels; null for what is no digest."""
    return F.when(c(sha).rlike("^[0-9a-f]{64}$"), F.concat(F.substring(c(sha), 1, 2), F.lit("/"), c(sha)))


def stable_id(*parts: Column | str) -> Column:
    return F.sha1(F.concat_ws("::", *[c(p).cast("string") for p in parts]))


def normalize_spans(spans: Column | str, page_required: bool) -> Column:
    """Spans (type, start, end, page, title) with an end after the start, and a page if
    required; type and title trimmed, empty ones null."""
    clean = lambda x: F.nullif(trim(F.coalesce(x, F.lit(""))), F.lit(""))
    good = F.filter(c(spans), lambda s: F.coalesce((s["end"] > s["start"]) & (F.lit(not page_required) | s["page"].isNotNull()), F.lit(False)))
    return F.transform(good, lambda s: F.struct(clean(s["type"]).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["page"].alias("page"), clean(s["title"]).alias("title")))


def page_value(spans: Column | str, start: Column, end: Column) -> Column:
    """Pages that a stretch touches: "p", "p-q" or "". Spans lie with their document, so
    the interval join is within the row."""
    pages = F.transform(F.filter(c(spans), lambda s: (s["end"] > start) & (s["start"] < end) & s["page"].isNotNull()), lambda s: s["page"])
    lo, hi = F.array_min(pages), F.array_max(pages)
    return F.when((start < 0) | (end <= start) | lo.isNull(), "").when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))


def section_bounds(headings: Column | str, at: Column, length: Column) -> Column:
    """Struct of the last heading at or before a place (0 if none) and the next one after
    it (the end if none): an as-of join within the row."""
    lo = F.coalesce(F.array_max(F.filter(c(headings), lambda h: h <= at)), F.lit(0))
    hi = F.coalesce(F.array_min(F.filter(c(headings), lambda h: h > at)), length)
    return F.struct(lo.alias("section_start"), hi.alias("section_end"))


def spans_from_content(content: DataFrame, key: str = "doc") -> DataFrame:
    """Real page spans of content lists (doc, ord, page_idx, n_chars): where each page's
    blocks begin and end when joined by blank lines."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = content.withColumn("start", F.coalesce(F.sum(F.col("n_chars") + 2).over(w), F.lit(0)))
    return placed.groupBy(key, (F.col("page_idx") + 1).alias("page")).agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_chars")).alias("end"))
