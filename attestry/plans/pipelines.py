"""Build, evaluate and compare, from tables and connectors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.llmjson import qa_items
from attestry.functions.text import compact_whitespace, strip_thinking, trim
from attestry.operators import parsing, scoring
from attestry.operators.chunking import markdown_chunks, sidecar, split_corpus
from attestry.operators.dataset import joined, number_rows, reject_reasons
from attestry.sources import files
from attestry.sources.connectors import Answerer, Generator, Judge, Parser, Retriever, answer_prompt
from attestry.sources.options import BuildOptions, timestamp_iso
from attestry.sources.tables import once


def chunk_corpus(inputs: DataFrame, max_chars: int = 1800, overlap: int = 180) -> DataFrame:
    """(source, chunk_no, chunk) of inputs (source, text)."""
    return inputs.select("source", F.posexplode(split_corpus("text", max_chars, overlap)).alias("chunk_no", "chunk"))


def build(inputs: DataFrame, generated: DataFrame, target: int, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """A QA dataset of up to target questions and the rejected items, from inputs (source,
    text) and what a generator answered for each chunk, generated (source, chunk_no,
    raw). Without validate, quotes and answers are taken as they are."""
    items = chunk_corpus(inputs).join(generated, ["source", "chunk_no"]).select("source", "chunk_no", "chunk", F.posexplode(qa_items(strip_thinking("raw"))).alias("item_no", "i")).select("source", "chunk_no", "chunk", "item_no", "i.*")
    judged = reject_reasons(items)
    good = judged.where("reject is null") if validate else judged
    rows = number_rows(good, "source", "chunk_no", "item_no", limit=target)
    evidence = F.array(F.struct(F.col("source").alias("source_file"), F.lit("").alias("page"), F.col("quote")))
    return rows.select("id", "query", "answer", evidence.alias("evidence"), F.array("quote").alias("positive")), judged.where("reject is not null").drop("chunk")


BLOCK = "array<struct<type:string,text:string,page_idx:int,table_body:string>>"


def parsed_inputs(spark: SparkSession, paths: list[str], parser: Parser | None, cache: str | None) -> tuple[DataFrame, DataFrame]:
    """(ord, path, markdown, content_list) of inputs and (path, error) of those that failed.

    Files that a parser takes are looked up by their digest in the cache, a Parquet table by
    the digest's first two signs; those that are not there are parsed, once, and added to
    it. Cached come first, then fresh, then local texts, each by path."""
    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    texts = files.read_inputs(spark, *paths, strip=False).select("path", F.col("text").alias("markdown"), F.lit(None).cast("string").alias("content_list"))
    none = spark.createDataFrame([], "path string, error string")
    if parser is None:
        return texts.select(F.struct(F.lit(2).alias("kind"), "path").alias("ord"), "*"), none
    mine = content.where(files.supported_by_parser(F.col("path"))).withColumn("digest", parsing.digest("content"))
    known = spark.read.parquet(cache).select("digest", "markdown", "content_list") if cache and files._exists(spark, f"{cache}/*") else spark.createDataFrame([], "digest string, markdown string, content_list string")
    cached, fresh = parsing.split_by_cache(mine, known.dropDuplicates(["digest"]))
    one = fresh.dropDuplicates(["digest"])
    got = once(parser.parse(one.select("path", "content")).select("path", "markdown", F.col("content_list").cast("string").alias("content_list"), "error").join(one.select("path", "digest"), "path"), "parsed")
    good = got.where("error is null and markdown is not null").select("digest", "markdown", "content_list")
    # read what was cached before anything is added
    cached = once(cached.select("path", "markdown", "content_list"), "cached")
    if cache:
        good.withColumn("shard", F.substring("digest", 1, 2)).write.mode("append").partitionBy("shard").parquet(cache)
    new = fresh.select("path", "digest").join(good, "digest").select("path", "markdown", "content_list")
    local = texts.join(mine.select("path"), "path", "left_anti")
    parts = [d.select(F.struct(F.lit(i).alias("kind"), "path").alias("ord"), "path", "markdown", "content_list") for i, d in enumerate((cached, new, local))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), got.where("error is not null or markdown is null").select("path", F.coalesce("error", F.lit("no result")).alias("error"))


def assembled(inputs: DataFrame) -> DataFrame:
    """One row: the corpus of inputs (ord, path, markdown), each under a comment that names
    its file."""
    base = F.element_at(F.split("path", "/"), -1)
    section = F.concat(F.lit("<!-- source: "), base, F.lit(" -->\n\n"), trim("markdown"))
    return joined(inputs.where(trim("markdown") != "").select("ord", section.alias("t")), F.col("t"), "ord").select(compact_whitespace("corpus").alias("corpus"))


def build_from_files(spark: SparkSession, paths: list[str], folder: str, options: BuildOptions, generator: Generator, parser: Parser | None = None, cache: str | None = None) -> dict:
    """A dataset in folder (name.json, its corpus, report and assets) from files; the report.

    Inputs are parsed or read, put together as a corpus, cut, and given to the generator;
    what it makes is validated. Markdown inputs also become chunk sidecars, with the pages
    that their content lists tell. A file that fails is in the report; no text is an error."""
    inputs, failed = parsed_inputs(spark, paths, parser if options.parse else None, cache)
    inputs = once(inputs, "inputs")
    corpus = assembled(inputs).collect()[0]["corpus"]  # a text for people and services to read
    if not corpus:
        raise ValueError("the inputs hold no text")
    name, assets = options.dataset, os.path.join(folder, "assets", options.dataset)
    os.makedirs(assets, exist_ok=True)
    corpus_path = os.path.join(folder, f"{name}.corpus.md")
    with open(corpus_path, "w", encoding="utf-8") as f:
        f.write(corpus)
    sources = spark.createDataFrame([(f"{name}.corpus.md", corpus)], "source string, text string")
    generated = once(generator.generate(chunk_corpus(sources)), "generated")
    qa, rejected = build(sources, generated.select("source", "chunk_no", "raw"), options.target_count, options.validate)
    qa = once(qa, "qa")
    dataset_path = os.path.join(folder, f"{name}.json")
    rows = [r[0] for r in qa.orderBy("id").select(F.to_json(F.struct("id", "query", "answer", "evidence", "positive"))).collect()]  # at most target_count
    with open(dataset_path, "w", encoding="utf-8") as f:
        f.write("".join(r + "\n" for r in rows))
    blocks = inputs.where("content_list is not null").select("path", F.posexplode(F.from_json("content_list", BLOCK)).alias("ord", "b"))
    pages = parsing.spans_from_content(blocks.select(F.col("path").alias("doc"), "ord", F.col("b.page_idx").alias("page_idx"), F.length(F.coalesce("b.text", "b.table_body", F.lit(""))).alias("n_chars")))
    spans = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "page"))).alias("s")).select(F.col("doc").alias("path"), F.transform("s", lambda x: F.struct(F.lit(None).cast("string").alias("type"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["page"].cast("int").alias("page"), F.lit(None).cast("string").alias("title"))).alias("page_spans"))
    docs = inputs.join(spans, "path", "left").select(F.element_at(F.split("path", "/"), -1).alias("doc"), F.col("markdown").alias("text"), F.coalesce("page_spans", F.array().cast(files.SPAN)).alias("page_spans"), F.array().cast(files.SPAN).alias("semantic_spans"))
    chunks = os.path.join(assets, f"chunks-{timestamp_iso()}".replace(":", ""))
    files.write_sidecars(sidecar(markdown_chunks(docs, name)), f"file://{os.path.abspath(chunks)}")
    report = {
        "schema": "attestry-build-1", "dataset_name": name, "created_at": timestamp_iso(), "dataset_path": dataset_path, "corpus_path": corpus_path, "qa_count": len(rows),
        "rejected": [r.asDict() for r in rejected.groupBy("reject").count().orderBy("reject").collect()], "failed": [r.asDict() for r in failed.orderBy("path").collect()],
        "generator_errors": [r[0] for r in generated.where("error is not null").select("error").distinct().orderBy("error").collect()] if "error" in generated.columns else [],
    }
    files.write_json(report, f"{dataset_path}.report.json")
    files.write_json({"schema": "attestry-assets-1", "dataset_name": name, "original_files": list(paths), "markdown_files": [r[0] for r in inputs.orderBy("ord").select("path").collect()], "chunk_folder": chunks, "dataset_path": dataset_path, "corpus_path": corpus_path}, os.path.join(assets, "manifest.json"))
    return report


def report_of(results: DataFrame, dataset: str, platform: str, flat: bool = False) -> dict:
    """An evaluation report: header, summary and results."""
    summary = scoring.summarize(results, flat=flat).collect()[0].asDict()
    import json

    rows = [json.loads(r[0]) for r in results.orderBy("id").select(F.to_json(F.struct(*[c for c in results.columns if c != "hits"]))).collect()]  # a report is one file
    return {"schema": "attestry-evaluation-1", "dataset": dataset, "platform": platform, "created_at": timestamp_iso(), "summary": summary, "results": rows}


def evaluate(qa: DataFrame, retriever: Retriever, answerer: Answerer | None, judge: Judge | None, stop_at_quota: bool = True, platform: str = "a") -> DataFrame:
    """Result rows of a dataset (id, query, answers, quotes) on one platform.

    The rule decides first; only what it rejects is judged. Failed answers are rows: with
    stop_at_quota, none follow the first used-up quota, which is marked, and other
    failures count as wrong answers; without, failures have no verdict. A search that
    failed is an error of its question, which has no hits.

    What a service says is written once to a table in the shared folder, so that each
    question is searched, answered and judged once, whatever is done with the result, and
    what is judged is what was answered. The result is such a table too."""
    said = once(retriever.search(qa.select("id", "query")), "hits")
    lost = said.where("error is not null").groupBy("id").agg(F.min("error").alias("search_error")) if "error" in said.columns else None
    hits = said.where("error is null").drop("error") if lost is not None else said
    lists = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "content"))).alias("hits"))
    ready = qa.join(lists, "id", "left")
    ready = ready.join(lost, "id", "left") if lost is not None else ready.withColumn("search_error", F.lit(None).cast("string"))
    texts = F.coalesce(F.transform("hits", lambda h: h["content"]), F.array().cast("array<string>"))
    rows = once(ready.withColumn("retrieval", scoring.retrieval(texts, "quotes", "answers")), "retrieved")
    if answerer is None:
        return rows.withColumn("platform", F.lit(platform))
    prompts = rows.select("id", answer_prompt("query", "hits").alias("prompt"))
    answers = once(answerer.answer(prompts), "answers")
    got = rows.join(answers, "id", "left").join(prompts.select("id", F.length("prompt").alias("prompt_chars")), "id")
    if stop_at_quota:
        first = got.where("error_kind = 'quota'").agg(F.min("id").alias("stop"))
        got = got.join(F.broadcast(first), F.col("stop").isNull() | (F.col("id") <= F.col("stop"))).drop("stop")  # one row
    failed = F.col("error").isNotNull()
    fine = got.where(~failed)
    asked = fine.where(~scoring.answer_correct("prediction", "answers")).select("id", "query", "answers", "quotes", "prediction")
    verdicts = once(judge.judge(asked), "verdicts") if judge else None
    scored = scoring.score_answers(fine, verdicts)
    kind = "struct<correct:boolean,reason:string>"
    quota = F.col("error_kind") == "quota"
    marked = got.where(failed).withColumn("answer_correct", F.lit(False if stop_at_quota else None).cast("boolean")).withColumn("answer_judge_method", F.when(quota & F.lit(stop_at_quota), scoring.QUOTA_ERROR).otherwise(scoring.ANSWER_ERROR if stop_at_quota else "error")).withColumn("answer_judge", F.lit(None).cast(kind))
    return once(scored.unionByName(marked).withColumn("platform", F.lit(platform)), "results")


def compare(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The comparison of two platforms' result rows, and the winner: of equals, the one of
    the first table."""
    both = a.withColumn("ord", F.lit(0)).unionByName(b.withColumn("ord", F.lit(1)), allowMissingColumns=True)
    table = scoring.compare(scoring.summarize(both, "platform", "ord"))
    return table, scoring.winner(table)
