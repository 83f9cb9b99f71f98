"""QA datasets: ingestion in one shape, filters, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.text import normalize_text, trim

QA = "id bigint, query string, answer array<string>, quotes array<string>, evidence array<struct<source_file:string,page:string,quote:string>>"


def flat_strings(v: Column, depth: int = 16) -> Column:
    """A variant that is a scalar or an array nested up to depth, as trimmed strings
    that are not empty. Only arrays unfold, never a string that looks like one."""
    unfold = lambda i: F.coalesce(F.try_variant_get(i, "$", "array<variant>"), F.array(i))
    items = unfold(v)
    for _ in range(depth - 1):
        items = F.flatten(F.transform(items, unfold))
    return F.filter(F.transform(items, lambda i: trim(F.coalesce(F.try_variant_get(i, "$", "string"), F.lit("")))), lambda s: s != "")


def canonical(lines: DataFrame, value: str = "value", ordinal: str = "ord") -> DataFrame:
    """ord and the columns of QA from lines of JSON. Answers may be scalars or nested;
    evidence may be objects or strings; positive stands in only where no quote is left.
    A line that is no JSON fails."""
    v = F.parse_json(F.col(value))
    d = lines.select(F.col(ordinal).alias("ord"), v.alias("v"))
    each = F.try_variant_get("v", "$.evidence", "array<string>")
    obj = lambda e, k: F.try_variant_get(F.try_parse_json(e), f"$.{k}", "string")
    is_obj = lambda e: F.coalesce(F.schema_of_variant(F.try_parse_json(e)).startswith("OBJECT"), F.lit(False))
    quote = lambda e: trim(F.coalesce(F.when(is_obj(e), obj(e, "quote")).otherwise(e), F.lit("")))
    quotes = F.filter(F.transform(F.coalesce(each, F.array().cast("array<string>")), quote), lambda q: q != "")
    none = F.array().cast("array<string>")
    evidence = F.transform(F.filter(F.coalesce(each, none), is_obj), lambda e: F.struct(obj(e, "source_file").alias("source_file"), obj(e, "page").alias("page"), obj(e, "quote").alias("quote")))
    return d.select(
        "ord", F.try_variant_get("v", "$.id", "bigint").alias("id"), F.coalesce(F.try_variant_get("v", "$.query", "string"), F.lit("")).alias("query"),
        F.coalesce(flat_strings(F.try_variant_get("v", "$.answer", "variant")), none).alias("answer"),
        F.when(F.size(quotes) > 0, quotes).otherwise(F.coalesce(flat_strings(F.try_variant_get("v", "$.positive", "variant")), none)).alias("quotes"), evidence.alias("evidence"),
    )


def missing_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti").orderBy(key)


def filter_by_ids(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows with these ids; none given keeps all; an id that no row has is an error."""
    if not ids:
        return rows
    wanted = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{key} bigint")
    lost = [r[0] for r in missing_ids(rows, wanted, key).collect()]
    if lost:
        raise ValueError("Unknown QA ids: " + ", ".join(map(str, lost)))
    return rows.join(F.broadcast(wanted), key, "left_semi")  # as many as the caller listed


def first_seen(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key that is not empty."""
    w = Window.partitionBy("__key").orderBy(*order)
    return rows.withColumn("__key", key).where("__key <> ''").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__key", "__rn")


def distinct_quotes(rows: DataFrame) -> DataFrame:
    """(ord, pos, quote): quotes by their normal form, the first spelling of each."""
    each = rows.select("ord", F.posexplode("quotes").alias("pos", "quote"))
    return first_seen(each, normalize_text("quote"), "ord", "pos")


def joined(rows: DataFrame, text: Column, *order: str, sep: str = "\n\n", alias: str = "corpus") -> DataFrame:
    """One text of all rows in order; a document for a person or a service to read, so
    of a size that one row holds."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda s: s["t"]), sep).alias(alias))


def fallback_corpus(rows: DataFrame) -> DataFrame:
    return joined(distinct_quotes(rows), F.col("quote"), "ord", "pos")


def selected_corpus(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Source files of evidence in first-seen order, each with a heading; files (path,
    text) that exist; the distinct quotes where no file is left."""
    each = rows.select("ord", F.posexplode("evidence").alias("pos", "e")).select("ord", "pos", F.col("e.source_file").alias("path")).where("path <> ''")
    seen = each.groupBy("path").agg(F.min(F.struct("ord", "pos")).alias("at"))
    text = trim(F.coalesce("text", F.lit("")))
    found = seen.join(files.select("path", text.alias("text")), "path").where("text <> ''")
    head = F.concat(F.lit("# Source: "), F.element_at(F.split("path", "[/\\\\]"), -1), F.lit("\n\n"), F.col("text"))
    some = joined(found.select("at", head.alias("t")), F.col("t"), "at", sep="\n\n---\n\n")
    return some.where("corpus <> ''").unionAll(fallback_corpus(rows).join(some.where("corpus <> ''").select("corpus").limit(1), F.lit(True), "left_anti"))


def number_rows(rows: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    """Dense ids from 0 in order, the first limit rows. Without a limit rows are sorted by
    range, and numbered within each range from where those before it end: no task holds
    them all."""
    if limit:
        kept = rows.orderBy(*order).limit(limit)
        return kept.withColumn("id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    at = rows.sparkSession.sparkContext.defaultParallelism
    ranged = rows.repartitionByRange(max(at, 2), *order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").count().withColumn("__base", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__base")
    n = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__n", n).join(F.broadcast(sizes), "__part").withColumn("id", F.col("__n") + F.col("__base")).drop("__part", "__n", "__base")  # a row a range


def reject_reasons(rows: DataFrame, chunk: str = "chunk", quote: str = "quote", answers: str = "answer") -> DataFrame:
    """rows with reject: why a generated item does not hold, or null."""
    lost = F.filter(F.col(answers), lambda a: ~F.contains(F.col(quote), a))
    why = F.when(~F.contains(F.col(chunk), F.col(quote)), "evidence quote is not copied from source chunk").when(F.size(lost) > 0, F.concat(F.lit("answers not found in evidence quote: ['"), F.array_join(lost, "', '"), F.lit("']")))
    return rows.withColumn("reject", why)


def choose_model(models: DataFrame, preferred: str, blocked: str) -> DataFrame:
    """Of models (pos, id): the first that is preferred and not blocked, else the first not blocked."""
    return models.where(~F.col("id").rlike(blocked)).orderBy(~F.col("id").rlike(preferred), "pos").limit(1)


def default_model(models: DataFrame, preferred: str, blocked: str) -> str:
    """The id that choose_model finds; none left is an error."""
    found = choose_model(models, preferred, blocked).collect()
    if not found:
        raise ValueError("no model is left to choose from")
    return found[0]["id"]
