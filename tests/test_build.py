"""Datasets from files and the verbs of the command line, on recorded services; parser,
platform, options and names."""

import io
import json
import os
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from attestry.__main__ import main
from attestry.functions import text
from attestry.plans import pipelines
from attestry.sources import connectors, files, options

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def archive(md, blocks=None):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x/a.md", "other")
        z.writestr("x/full.md", md)
        if blocks is not None:
            z.writestr("x/1_content_list.json", json.dumps(blocks))
    return b.getvalue()


class Service:
    """A parser in memory, for one task; counts what it is asked."""

    def __init__(self, folder):
        self.folder = folder

    def send(self, url, headers, body, timeout):
        if body is not None:
            files_ = json.loads(body)["files"]
            with open(f"{self.folder}/asked", "a") as f:
                f.write("".join(x["name"] + "\n" for x in files_))
            return 200, json.dumps({"batch_id": "b" + "-".join(x["name"] for x in files_), "file_urls": ["put:" + x["name"] for x in files_]})
        names = url.rsplit("/b", 1)[1].split("-")
        return 200, json.dumps({"results": [{"data_id": str(i), "file_name": n, "state": "failed" if "bad" in n else "done", "error": "unreadable", "archive_url": "get:" + n} for i, n in enumerate(names)]})

    def transfer(self, url, data, timeout):
        return b"" if data is not None else archive(f"# Title\n\nPears are green, says {url[-5:]}.", [{"type": "text", "text": "Title", "page_idx": 0}, {"type": "text", "text": "Pears are green, and so on.", "page_idx": 1}])


QUESTIONS = json.dumps([{"query": "Which colour?", "answer": ["green"], "evidence_quote": "Pears are green"}, {"query": "x", "answer": ["red"], "evidence_quote": "invented"}])


def test_build_from_files(spark, tmp_path):
    src, out, cache = tmp_path / "in", tmp_path / "out", str(tmp_path / "cache")
    src.mkdir()
    (src / "a.pdf").write_bytes(b"%PDF one")
    (src / "copy.pdf").write_bytes(b"%PDF one")
    (src / "bad.pdf").write_bytes(b"%PDF two")
    (src / "n.txt").write_text("\ufeffPlums are blue.\r\n\r\n\r\n\r\nThey are.")
    service = Service(str(tmp_path))
    parser = connectors.HttpParser("http://p", send=service.send, transfer=service.transfer, wait=lambda s: None)
    generator = connectors.Recorded(generated=spark.createDataFrame([(0, QUESTIONS)], "chunk_no int, raw string"))
    paths = sorted(str(p) for p in src.iterdir())
    report = pipelines.build_from_files(spark, paths, str(out), options.BuildOptions("ds", 5), generator, parser, cache)
    assert report["qa_count"] == 1 and [f["error"] for f in report["failed"]] == ["unreadable"]
    assert [r["reject"] for r in report["rejected"]] == ["evidence quote is not copied from source chunk"]
    corpus = (out / "ds.corpus.md").read_text()
    assert corpus.count("Pears are green") == 2 and corpus.index("source: a.pdf") < corpus.index("source: copy.pdf") < corpus.index("source: n.txt") and "\n\n\n" not in corpus
    assert files.read_dataset(spark, str(out / "ds.json")).collect()[0].quotes == ["Pears are green"]
    chunks = spark.read.json(json.loads((out / "assets/ds/manifest.json").read_text())["chunk_folder"]).select("doc", F.col("chunks")[0]["page"].alias("page"))
    assert {r.doc: r.page for r in chunks.collect()} == {"a.pdf": "1-2", "copy.pdf": "1-2", "n.txt": ""}
    asked = (tmp_path / "asked").read_text().split()
    assert len(asked) == 2  # equal files are parsed once
    again = pipelines.build_from_files(spark, paths, str(out), options.BuildOptions("ds", 5), generator, parser, cache)
    assert again["qa_count"] == 1 and len((tmp_path / "asked").read_text().split()) == 3  # only what failed is asked again
    with pytest.raises(ValueError, match="no text"):
        (src / "e.txt").write_text(" ")
        pipelines.build_from_files(spark, [str(src / "e.txt")], str(out), options.BuildOptions("e"), generator)


def test_verbs(spark, tmp_path):
    rec, data = tmp_path / "rec", str(tmp_path / "data")
    (tmp_path / "in.txt").write_text("Pears are green.")
    spark.createDataFrame([(0, QUESTIONS)], "chunk_no int, raw string").write.parquet(f"{rec}/generated.parquet")
    spark.createDataFrame([(0, 1, "t", "x Pears are green y")], "id long, rank int, title string, content string").write.parquet(f"{rec}/hits.parquet")
    spark.createDataFrame([(0, "They are green.", None, None)], "id long, prediction string, error string, error_kind string").write.parquet(f"{rec}/predictions.parquet")
    spark.createDataFrame([], "id long, correct boolean, reason string").write.parquet(f"{rec}/judgements.parquet")
    assert main(["build", data, "--input", str(tmp_path / "in.txt"), "--dataset", "d1", "--recorded", str(rec)])["qa_count"] == 1
    got = main(["evaluate", data, "--dataset", "d1", "--recorded", str(rec)])
    assert got["summary"]["qa_accuracy"] == 1.0 and got["summary"]["evidence_hit_rate"] == 1.0 and got["results"][0]["answer_correct"] is True
    assert main(["evaluate", data, "--dataset", "d1", "--kind", "b", "--judge-mode", "rule", "--ids", "0", "--recorded", str(rec)])["summary"]["qa_total"] == 1
    both = main(["compare", data, "--dataset", "d1", "--recorded", str(rec)])
    assert both["winner_by_qa_accuracy"] == "a" and [p["platform"] for p in both["platforms"]] == ["a", "b"]
    assert sorted(os.listdir(f"{data}/reports"))[0].startswith("a_d1_")
    assert [r["name"] for r in main(["datasets", data]).collect()] == ["d1"]
    md = tmp_path / "m.md"
    md.write_text("# One\n\n" + "word " * 80)
    (tmp_path / "m.md.meta.json").write_text(json.dumps({"pageSpans": [{"page": 4, "start": 0, "end": 900}, {"start": 1, "end": 2}]}))
    assert [r.page for r in main(["chunk", str(md)]).collect()] == ["4"]
    gone = main(["delete", data, "--dataset", "d1"])
    assert len(gone) >= 6 and not os.path.exists(f"{data}/d1.json") and not os.path.exists(f"{data}/assets/d1")
    with pytest.raises(ValueError):
        main(["delete", data, "--dataset", "../d1"])


def test_services_are_asked_once(spark, tmp_path):
    """One search, one answer and at most one verdict with one repair for a question,
    whatever is done with the result."""
    log = str(tmp_path / "calls")

    def send(url, headers, body, timeout):
        m = json.loads(body)
        q = m["messages"][0]["content"] if "messages" in m else "search " + m["query"]
        with open(log, "a") as f:
            f.write(q.split()[0] + "\n")
        if q.startswith("search"):
            return (500, "down") if q.endswith("q3") else (200, json.dumps({"results": [{"content": "noise"}, {"pageContent": "evidence number " + q[-1], "metadata": {"source": "s"}}]}))
        out = "no json" if q.startswith("Does") and "q1" in q else '{"correct": true}' if q.startswith(("Does", "Turn")) else "wrong" if "q1" in q or "q2" in q else "answer 0"
        return 200, json.dumps({"choices": [{"message": {"content": out}}]})

    qa = spark.createDataFrame([(i, f"q{i}", [f"answer {min(i, 1) * 3}"], [f"evidence number {i}"]) for i in range(4)], "id long, query string, answers array<string>, quotes array<string>")
    p = connectors.Provider("n", "http://h", "m")
    services = (connectors.HttpRetriever("http://s", send=send, delays=()), connectors.HttpAnswerer(p, send=send), connectors.HttpJudge(p, send=send))
    a = pipelines.evaluate(qa, *services, True, "a")
    b = pipelines.evaluate(qa, services[0], services[1], None, False, "b")
    table, best = pipelines.compare(a, b)
    for _ in range(2):
        rows = {r.id: r for r in a.collect()}
        table.collect(), best.collect(), pipelines.report_of(b, "d", "b")
    calls = open(log).read().split()
    assert {x: calls.count(x) for x in set(calls)} == {"search": 8, "Answer": 8, "Does": 2, "Turn": 1}
    assert [rows[i].answer_judge_method for i in range(4)] == ["rule", "model_judge", "model_judge", "rule"]
    assert rows[3].search_error.startswith("HTTP 500") and rows[3].retrieval.retrieved_count == 0 and rows[0].retrieval.first_evidence_rank == 2


def test_platform_models_and_messages(spark):
    bodies = {"/v1/knowledge-bases": {"knowledge_bases": [{"id": "k", "name": "N"}]}, "/v1/models": {"data": [{"id": "m1"}, {"name": "m2"}, {"id": "m1"}]}, "/health": {}}

    def send(url, headers, body, timeout):
        path = url.removeprefix("http://h")
        if body is None:
            return (200, json.dumps(bodies[path])) if path in bodies else (404, "none")
        if path.endswith("/messages"):
            return 200, json.dumps({"content": [{"type": "text", "text": " A "}]})
        return (400, "use messages") if path.endswith("completions") else (200, json.dumps({"id": 7}))

    h = connectors.HttpPlatform("http://h/", send=send)
    assert h.healthy() and not h.healthy("/x") and h.knowledge_bases(spark).collect()[0].name == "N" and h.upload("t", {"a.md": "x"}) == "7"
    p = connectors.Provider("n", "http://h", "m", fallback="use messages")
    assert connectors.list_models(p, send=send) == ["m1", "m2"]
    got = connectors.chat(spark.createDataFrame([(1, "[]")], "id int, m string"), "m", "out", p, 10, "answer", send=send, delays=()).collect()[0]
    assert got.out == "A" and got.error is None
    plain = connectors.chat(spark.createDataFrame([(1, "[]")], "id int, m string"), "m", "out", connectors.Provider("n", "http://h", "m"), 10, "answer", send=send, delays=()).collect()[0]
    assert plain.out is None and plain.error_kind == "error"
    u = spark.createDataFrame([('{"usage":{"prompt_tokens":3,"completion_tokens":4}}',), ('{"prompt_eval_count":1,"eval_count":2}',), ("x",)], "r string").select(connectors.usage("r").alias("u")).collect()
    assert [tuple(r.u) for r in u] == [(3, 4, 7), (1, 2, 3), (0, 0, 0)]
    assert connectors.preset("local").kind == "local" and set(connectors.PRESETS) >= {"custom"}


def test_saved_provider(tmp_path):
    p = connectors.Provider("n", "u", "m", ("m",), "abcdefghijkl")
    connectors.save_provider(p, str(tmp_path / "p.json"))
    assert connectors.load_provider(str(tmp_path / "p.json"), connectors.preset("custom")).api_key == "abcdefghijkl"
    assert connectors.load_provider(str(tmp_path / "none"), p) is p


def test_options_and_names(spark, tmp_path):
    o = options.EvalOptions.of({"documentCount": "7 hits", "apiBase": "u", "knowledgeBaseId": "a, b", "temperature": "0.5x", "stopAtQuota": "no", "limit": ""}, knowledge_base_id="knowledge_base_ids")
    assert (o.document_count, o.api_base, o.knowledge_base_ids, o.temperature, o.stop_at_quota, o.limit, o.timeout) == (7, "u", ("a", "b"), 0.5, False, 0, 900)
    assert options.dataset_name("a.b-1") == "a.b-1" and options.as_bool(None, True) and options.as_bool("on")
    for bad in ("", "..", "a/b", "a b"):
        with pytest.raises(ValueError):
            options.dataset_name(bad)
    assert options.inside(str(tmp_path / "x" / ".." / "y"), str(tmp_path)).endswith("/y")
    with pytest.raises(ValueError):
        options.inside(str(tmp_path / ".."), str(tmp_path))
    assert options.report_of("a_d_1.json", "d") and options.report_of("d_1.json", "d") and not options.report_of("ad_1.json", "d")
    (tmp_path / "n.json").write_text("{}")
    (tmp_path / "n.corpus.md").write_text("c")
    assert options.resolve(str(tmp_path), "n")[1].endswith("n.corpus.md")
    (tmp_path / "n.corpus.txt").write_text("c")
    assert options.resolve(str(tmp_path), "n")[1].endswith("n.corpus.txt")
    (tmp_path / "n.json.report.json").write_text(json.dumps({"corpus": str(tmp_path / "n.corpus.md")}))
    assert options.resolve(str(tmp_path), "n")[1].endswith("n.corpus.md")
    with pytest.raises(FileNotFoundError):
        options.resolve(str(tmp_path), "none")
    (tmp_path / "key").write_text("k1\n")
    assert options.key_from("", "NO_SUCH_VARIABLE_X", str(tmp_path / "key")) == "k1" and options.key_from(" g ") == "g"
    assert options.upload_name("a.pdf") == "a.pdf" and options.upload_name("é.pdf").endswith(".pdf") and options.upload_name("é.p\u00fcf").endswith(".bin")
    assert options.artifact_stem("x/a b:c.pdf") == "a_b_c" and options.zip_member_name("..\\x//y.md") == "x__y.md" and options.zip_member_name("") == "artifact"
    at = options.datetime(2024, 1, 2, 3, 4, 5, tzinfo=options.timezone.utc)
    assert options.timestamp_compact(at) == "20240102_030405" and options.timestamp_iso(at) == "2024-01-02T03:04:05+0000"
    row = spark.sql("SELECT timestamp'2024-01-02 03:04:05' t, 'a b/é' p").select(options.iso_column("t").alias("i"), options.compact_column("t").alias("c"), options.download_url("p").alias("d"), options.data_id("p").alias("x")).collect()[0]
    assert tuple(row)[:3] == ("2024-01-02T03:04:05+0000", "20240102_030405", "/download?path=a%20b%2F%C3%A9") and len(row.x) == 32 and options.download_path("a b/é") == row.d
    parts = spark.createDataFrame([("i1", "é.pdf", 0), ("i2", "é.pdf", 1), ("i3", "b.pdf", 2)], "data_id string, upload_name string, ord int")
    names = spark.createDataFrame([("é.pdf",), (options.upload_name("é.pdf"),), ("c",)], "file_name string")
    assert {r.file_name: r.data_id for r in options.id_by_file_name(names, parts).collect()} == {"é.pdf": "i1", options.upload_name("é.pdf"): "i1", "c": None}


def test_catalogue_of_assets(spark, tmp_path):
    for x in ("a.md", "a.md.lay.json", "b.md", "a.md.chunks.json"):
        (tmp_path / x).write_text("{}")
    (tmp_path / "manifest.json").write_text(json.dumps({"docs": [f"file:{tmp_path}/a.md", f"file:{tmp_path}/b.md", "c.md"]}))
    there = files.list_files(spark, str(tmp_path))
    docs = files.asset_documents(spark, str(tmp_path / "manifest.json"), there, "docs", ".lay.json")
    assert [r.path.rsplit("/", 1)[1] for r in docs.collect()] == ["a.md"]
    s = files.sidecar_summary(docs, there).collect()[0]
    assert (s.markdown_count, s.sidecar_count) == (1, 1)
    assert files.read_json(spark, str(tmp_path / "none.json")).count() == 0
    q = spark.createDataFrame([(402, ""), (400, "Request limit"), (400, "额度不足"), (429, "busy"), (200, "ok")], "s int, b string")
    assert [r[0] for r in q.select(text.quota_error(F.col("s"), "b")).collect()] == [True, True, True, False, False]
    assert [connectors.is_quota(r.s, r.b) for r in q.collect()] == [True, True, True, False, False]
