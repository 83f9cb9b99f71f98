"""Reading datasets, texts, reports and manifests, and writing them."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions.text import compact_whitespace, html_to_text, trim
from attestry.operators.dataset import canonical
from attestry.operators.parsing import normalize_spans

TEXT_EXTENSIONS = ("txt", "md", "markdown", "html", "htm", "csv", "tsv", "json", "jsonl", "xml", "yaml", "yml", "log", "rst", "tex", "ini", "cfg", "toml")
PARSER_EXTENSIONS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "png", "jpg", "jpeg", "jp2", "webp", "gif", "bmp", "html", "htm")


def without_bom(x: Column) -> Column:
    return F.regexp_replace(x, r"^﻿", "")


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of whole files, without a byte order mark."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), without_bom(F.col("value")).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, value) of the lines that are not blank, in file order. Files of lines
    are split by Spark: the order is that of the block and of the line in it, so no file
    has to fit into one row."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value"))
    return raw.select("path", F.struct("block", "n").alias("ord"), trim(without_bom(F.col("value"))).alias("value")).where("value <> ''")


def read_dataset(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """The QA dataset in JSON lines, in its one shape; the first limit lines if not 0.
    A line that is no JSON is an error."""
    lines = read_lines(spark, path).drop("path")
    return canonical(lines.orderBy("ord").limit(limit) if limit else lines)


def count_lines(spark: SparkSession, path: str) -> int:
    return read_lines(spark, path).count()


def read_json(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, json) with a null where a file holds no JSON, and no row for one that is not
    there."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, json variant")
    return read_text(spark, *there).select("path", F.try_parse_json("text").alias("json"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def read_inputs(spark: SparkSession, *paths: str, strip: bool = True) -> DataFrame:
    """(path, text) of text inputs by extension; HTML as text unless strip is off, which
    leaves it raw. Files that are blank are left out."""
    d = read_text(spark, *paths).where(extension(F.col("path")).isin(*TEXT_EXTENSIONS))
    html = extension(F.col("path")).isin("html", "htm")
    clean = F.when(html, html_to_text("text")).otherwise(compact_whitespace("text"))
    return d.where(clean != "").select("path", (clean if strip else F.col("text")).alias("text"))


def supported_by_parser(path: Column) -> Column:
    return extension(path).isin(*PARSER_EXTENSIONS)


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, length, modified) by path; none for a folder that does not exist. Contents
    are not read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, length bigint, modified timestamp")
    d = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return d.where(F.lower("path").endswith(suffix.lower())).orderBy("path")


def corpus_sections(text: Column) -> Column:
    """Of a corpus file: array of (source, text) by its "# Source:" headings."""
    parts = F.filter(F.split(text, r"(?m)^(?=# Source: )"), lambda p: p.startswith("# Source: "))
    return F.transform(parts, lambda p: F.struct(trim(F.regexp_extract(p, r"^# Source: ([^\n]*)", 1)).alias("source"), trim(F.regexp_replace(F.regexp_replace(p, r"^# Source: [^\n]*\n?", ""), r"\n---\s*$", "")).alias("text")))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue of a folder: name, path, rows, has_corpus, has_assets, updated_at, by
    name; reports are no datasets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    base = F.element_at(F.split("path", "/"), -1)
    named = files.select("path", "modificationTime", base.alias("base"))
    found = named.where(F.col("base").endswith(".json") & ~F.col("base").endswith(".report.json") & ~F.col("path").rlike("/(assets|reports)/")).withColumn("name", F.regexp_replace("base", r"\.json$", ""))
    have = named.where(F.col("base").rlike(r"\.corpus\.(md|txt)$")).select(F.regexp_replace("base", r"\.corpus\.(md|txt)$", "").alias("name")).distinct().withColumn("has_corpus", F.lit(True))
    assets = named.select(F.regexp_extract("path", r"/assets/([^/]+)/", 1).alias("name")).where("name <> ''").distinct().withColumn("has_assets", F.lit(True))
    lines = spark.read.text(folder, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("p"), trim("value").alias("v")).where("v <> ''").groupBy("p").agg(F.count(F.lit(1)).alias("rows"))
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    d = found.join(have, "name", "left").join(assets, "name", "left").join(lines.withColumn("base", tail(F.col("p"))).drop("p"), "base", "left")
    no = F.lit(False)
    return d.select("name", "path", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("has_corpus", no).alias("has_corpus"), F.coalesce("has_assets", no).alias("has_assets"), F.col("modificationTime").alias("updated_at")).orderBy(F.collate("name", "UNICODE"))


def reports(spark: SparkSession, folder: str, most: int = 80, rename: tuple[str, str] = ("", "")) -> DataFrame:
    """Index of the newest reports of a folder, with the totals of their summaries; rename
    (prefix, new prefix) changes the names shown."""
    d = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("updated_at"), F.try_parse_json("value").alias("v"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    return d.select(
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), f"^{rename[0]}" if rename[0] else "^(?!)", rename[1]).alias("name"), "path", F.coalesce(get("$.dataset_name"), get("$.dataset"), F.lit("")).alias("dataset"), F.coalesce(get("$.schema"), F.lit("")).alias("schema"),
        get("$.summary.qa_accuracy", "double").alias("qa_accuracy"), get("$.summary.qa_correct", "bigint").alias("qa_correct"), F.coalesce(get("$.summary.qa_total", "bigint"), get("$.summary.total", "bigint")).alias("qa_total"), "updated_at",
    ).transform(newest, most)


def newest(rows: DataFrame, most: int = 80) -> DataFrame:
    """The latest rows by updated_at, then by name."""
    return rows.orderBy(F.desc("updated_at"), "name").limit(most)


def asset_documents(spark: SparkSession, manifest: str, files: DataFrame, key: str = "markdown_files", layout: str = ".layout.json") -> DataFrame:
    """Markdown paths that a manifest lists under key for which the file and its layout file,
    of the same path and that ending, are there."""
    listed = read_json(spark, manifest).select(F.explode(F.try_variant_get("json", f"$.{key}", "array<string>")).alias("path"))
    with_layout = files.where(F.col("path").endswith(layout)).select(F.left("path", F.length("path") - len(layout)).alias("path"))
    return listed.join(files.select("path"), "path", "left_semi").join(with_layout, "path", "left_semi")


def sidecar_path(path: Column | str, ending: str = ".chunks.json") -> Column:
    return F.concat(path if isinstance(path, Column) else F.col(path), F.lit(ending))


def sidecar_summary(documents: DataFrame, files: DataFrame, ending: str = ".chunks.json") -> DataFrame:
    """One row: how many documents (path) there are, how many have a sidecar, and both lists."""
    have = documents.select("path", sidecar_path("path", ending).alias("s")).join(files.select(F.col("path").alias("s"), F.lit(True).alias("there")), "s", "left")
    return have.agg(F.count(F.lit(1)).alias("markdown_count"), F.count("there").alias("sidecar_count"), F.array_sort(F.collect_list("path")).alias("markdown_paths"), F.array_sort(F.collect_list(F.when(F.col("there"), F.col("s")))).alias("sidecar_paths"))


SPAN = "array<struct<type:string,start:int,end:int,page:int,title:string>>"


def read_metadata(spark: SparkSession, documents: DataFrame, *folders: str) -> DataFrame:
    """documents (path) with page_spans and semantic_spans of the first of path.meta.json and
    the stem's .meta.json that is JSON, under either spelling of the keys; empty if none is."""
    found = spark.read.text([f"{f.rstrip('/')}/*.meta.json" for f in folders], wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.try_parse_json(without_bom(F.col("value"))).alias("v")).where("v is not null")
    plain = lambda x: F.regexp_replace(x, "^file:/*", "/")
    names = documents.select("path", F.posexplode(F.array(F.concat("path", F.lit(".meta.json")), F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".meta.json")))).alias("pos", "at"))
    keyed = names.withColumn("at", plain(F.col("at"))).join(found.withColumn("at", plain(F.col("at"))), "at")
    first = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where("rn = 1").select("path", "v")
    get = lambda *keys: F.coalesce(*(F.try_variant_get("v", f"$.{k}", SPAN) for k in keys), F.array().cast(SPAN))
    out = documents.join(first, "path", "left")
    return out.select(*documents.columns, normalize_spans(get("page_spans", "pageSpans"), True).alias("page_spans"), normalize_spans(get("semantic_spans", "semanticSpans"), False).alias("semantic_spans"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Of candidates (name, priority, path) the first that is a file, for each name."""
    w = Window.partitionBy("name").orderBy("priority")
    return candidates.join(files.select("path"), "path", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def unique_names(files: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """name with _1, _2 ... before the extension where it occurs again."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """One JSON object a line, sorted by range, so that the parts follow one another."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    out.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A comparison for a spreadsheet: one file with a byte order mark, cells quoted only
    where they must be; nothing for no rows. For tables of a report's size."""
    got = rows.collect()
    if not got:
        return
    cell = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(x in s for x in '",\n') else s
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write("\n".join([",".join(rows.columns), *(",".join(quote(cell(v)) for v in r) for r in got)]) + "\n")


def write_json(payload: object, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, ensure_ascii=False, indent=2) + "\n")


def write_sidecars(chunks: DataFrame, path: str) -> None:
    """One row a document: its chunks in order, partitioned for lookup by document."""
    each = F.array_sort(F.collect_list(F.struct("doc_index2", *[c for c in chunks.columns if c not in ("doc", "doc_index2")])))
    chunks.groupBy("doc").agg(each.alias("chunks")).write.json(path)
