"""python -m attestry VERB: build a dataset from files, evaluate a platform, compare two,
chunk Markdown, list datasets and reports, delete a dataset, or run a query over a folder
of Parquet tables. --recorded names a folder with what services said before (hits,
predictions, judgements, generated and parsed, as Parquet) in place of services."""

from __future__ import annotations

import argparse
import os


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attestry", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    q = sub.add_parser("query", help="run a query of the engine")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--out", help="Parquet path; default: show")
    k = sub.add_parser("chunk", help="chunks of Markdown files, with the spans of their .meta.json")
    k.add_argument("paths", nargs="+")
    k.add_argument("--label", default="corpus")
    k.add_argument("--out")
    for verb in ("datasets", "reports"):
        sub.add_parser(verb).add_argument("folder")
    d = sub.add_parser("delete", help="a dataset with all that belongs to it")
    d.add_argument("folder")
    d.add_argument("--dataset", required=True)
    d.add_argument("--reports", default="")
    b = sub.add_parser("build", help="a dataset from files")
    b.add_argument("folder", help="where datasets are")
    b.add_argument("--input", required=True, help="files, with commas between")
    b.add_argument("--dataset", default="dataset")
    b.add_argument("--target-count")
    b.add_argument("--questions-per-chunk")
    b.add_argument("--no-parse", action="store_true")
    b.add_argument("--no-validate", action="store_true")
    b.add_argument("--cache")
    for verb in ("evaluate", "compare"):
        e = sub.add_parser(verb)
        e.add_argument("folder", help="where datasets are")
        for x in ("dataset", "dataset-path", "limit", "ids", "output", "document-count", "judge-mode", "timeout", "max-tokens"):
            e.add_argument("--" + x)
        e.add_argument("--kind", choices=("a", "b"), default="a", help="a: a used-up quota ends it; b: failures have no verdict")
        for x in ("api-base", "api-key", "second-api-base", "second-api-key", "search-path"):
            e.add_argument("--" + x)
    for e in (b, *(sub.choices[v] for v in ("evaluate", "compare"))):
        e.add_argument("--recorded")
        e.add_argument("--provider", default="custom")
        e.add_argument("--model")
        e.add_argument("--config", help="a saved provider")
    return p


def main(argv: list[str] | None = None) -> object:
    args = parser().parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from attestry.operators import dataset as qa_rows
    from attestry.plans import pipelines
    from attestry.sources import connectors, files, options

    spark = SparkSession.builder.getOrCreate()
    given = {k: v for k, v in vars(args).items() if v is not None and v is not False}

    def recorded() -> connectors.Recorded:
        read = lambda x: spark.read.parquet(os.path.join(args.recorded, f"{x}.parquet")) if os.path.exists(os.path.join(args.recorded, f"{x}.parquet")) else None
        return connectors.Recorded(*(read(x) for x in ("hits", "predictions", "judgements", "parsed", "generated")))

    def provider() -> connectors.Provider:
        base = connectors.preset(args.provider)
        base = connectors.load_provider(args.config, base) if args.config else base
        return connectors.provider_from({"model": args.model}, base) if args.model else base

    def evaluated(kind: str, api: str):
        o = options.EvalOptions.of((options.SECOND if kind == "b" else {}) | given)
        path, _ = options.resolve(args.folder, o.dataset, o.dataset_path, o.corpus_path)
        rows = files.read_dataset(spark, path, o.limit)
        rows = qa_rows.filter_by_ids(rows, [int(x) for x in options.as_list(o.ids)])
        qa = rows.select("id", "query", F.col("answer").alias("answers"), "quotes")
        if args.recorded:
            services = [recorded()] * 3
        else:
            k = max(1, min(20, o.document_count))
            key = given.get(f"{api}api_key", "")
            services = [connectors.HttpRetriever(given.get(f"{api}api_base", o.api_base) + given.get("search_path", "/search"), {"Authorization": f"Bearer {key}"} if key else {}, k, o.timeout), connectors.HttpAnswerer(provider(), o.timeout), connectors.HttpJudge(provider(), o.timeout)]
        judge = None if o.judge_mode == "rule" else services[2]
        return o, pipelines.evaluate(qa, services[0], services[1], judge, o.stop_at_quota, kind)

    if args.verb == "query":
        from attestry.plans.queries import QUERIES

        out = QUERIES[args.name](spark, args.folder)
    elif args.verb == "chunk":
        from attestry.operators.chunking import markdown_chunks

        docs = files.read_text(spark, *args.paths)
        folders = sorted({os.path.dirname(os.path.abspath(x)) for x in args.paths})
        with_meta = [x for x in folders if any(n.endswith(".meta.json") for n in os.listdir(x))]
        docs = files.read_metadata(spark, docs, *with_meta) if with_meta else docs.select("*", F.array().cast(files.SPAN).alias("page_spans"), F.array().cast(files.SPAN).alias("semantic_spans"))
        out = markdown_chunks(docs.withColumn("doc", F.element_at(F.split("path", "/"), -1)), args.label)
    elif args.verb == "build":
        o = options.BuildOptions.of(given | {"parse": not args.no_parse, "validate": not args.no_validate})
        service = recorded() if args.recorded else connectors.HttpGenerator(provider(), o.questions_per_chunk, o.timeout)
        parse = service if args.recorded and service.parsed is not None else None
        report = pipelines.build_from_files(spark, [os.path.abspath(x) for x in options.as_list(args.input)], args.folder, o, service, parse, args.cache)
        print(f"{report['qa_count']} questions in {report['dataset_path']}")
        return report
    elif args.verb == "evaluate":
        o, results = evaluated(args.kind, "")
        report = pipelines.report_of(results, o.dataset, args.kind, flat=args.kind == "b")
        files.write_json(report, o.output or os.path.join(args.folder, "reports", f"{args.kind}_{o.dataset}_{options.timestamp_compact()}.json"))
        print(f"qa_accuracy {report['summary']['qa_accuracy']:.4f} ({report['summary']['qa_correct']}/{report['summary']['qa_total']})")
        return report
    elif args.verb == "compare":
        (o, a), (_, b) = evaluated("a", ""), evaluated("b", "second_")
        table, best = pipelines.compare(a, b)
        stem = o.output or os.path.join(args.folder, "reports", f"compare_{o.dataset}_{options.timestamp_compact()}")
        files.write_csv(table, f"{stem}.csv")
        summary = {"dataset": o.dataset, "platforms": [r.asDict() for r in table.orderBy("ord").collect()], "winner_by_qa_accuracy": best.collect()[0]["platform"]}
        files.write_json(summary, f"{stem}.json")
        print(f"winner {summary['winner_by_qa_accuracy']}")
        return summary
    elif args.verb == "delete":
        gone = options.delete_dataset(args.folder, args.reports or os.path.join(args.folder, "reports"), args.dataset)
        print("\n".join(gone))
        return gone
    else:
        out = getattr(files, args.verb)(spark, args.folder)
    if getattr(args, "out", None):
        out.write.parquet(args.out)
    else:
        out.show(50, truncate=80)
    return out


if __name__ == "__main__":
    main()
