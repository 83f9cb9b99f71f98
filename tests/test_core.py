"""Semantics on authored cases: answers, evidence, JSON, chunks, files, connectors."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestry.functions import llmjson, text
from attestry.operators import chunking, dataset, parsing, scoring
from attestry.plans import pipelines
from attestry.sources import connectors, files
from attestry.streaming import jobs


def one(spark, column, **values):
    """column over a row of these values."""
    kinds = {k: ("array<string>" if isinstance(v, list) else "string") for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    "prediction,answers,want",
    [
        ("会议于 2022年1月3日 10:30 召开[1]。", ["2022年1月3日", "10:30"], True),
        ("2022年1月4日", ["2022年1月3日"], True),  # eight ninths of the characters are enough
        ("与此无关", ["2022年1月3日"], False),
        ("x", [], False),
        ("It costs 5.00%", ["5%"], True),
        ("", ["a"], False),
        ("short", ["shor"], True),
        ("abcdef", ["abcdeg"], False),
        (None, [None], False),
        ("ＡＢＣ１２３４５６７", ["abc1234567"], True),
    ],
)
def test_answer_rule(spark, prediction, answers, want):
    assert one(spark, text.answer_correct("p", "a"), p=prediction, a=answers) is want


def test_normal_forms(spark):
    assert one(spark, text.normalize_text("x"), x=" Ａ b　 C﻿ ") == "abc"
    assert one(spark, text.compact_answer("x"), x="答案（1）甲，乙") == "答案1甲,乙"
    assert one(spark, text.compact_answer(text.normalize_answer("x")), x="答案（1）甲，乙") == "答案甲,乙"
    assert one(spark, text.strip_thinking("x"), x=" <think>a\nb</THINK> c ") == "c"
    assert one(spark, text.html_to_text("x"), x="<p>a&amp;lt;b</p><script>x</script>\r\n\n\n\n c") == "a<b \n\n c"
    assert one(spark, text.parse_ids("x"), x="1, 12abc,, x,-3") == [1, 12, None, -3]
    assert one(spark, text.sanitize_filename("x"), x="a/b:c  d") == "a_b_c d"
    assert one(spark, text.sanitize_dataset_name("x"), x=" . ") == "dataset"
    assert [one(spark, text.json_bool("x"), x=v) for v in ("true", "0", "2", "对", "no", None)] == [True, False, True, True, False, False]


def test_retrieval_measures(spark):
    q = "the evidence quote that is certainly long enough"
    r = one(spark, scoring.retrieval("h", "q", "a"), h=["nothing", "x " + q + " y"], q=[q], a=["zzz"])
    assert (r.evidence_hit, r.evidence_recall, r.evidence_precision, r.mrr, r.first_evidence_rank, r.retrieved_count) == (True, 1.0, 0.5, 0.5, 2, 2)
    r = one(spark, scoring.retrieval("h", "q", "a"), h=["all of ZZZ here"], q=["other"], a=["zzz"])
    assert r.evidence_hit and r.first_evidence_rank == 1
    r = one(spark, scoring.retrieval("h", "q", "a"), h=[], q=[], a=[])
    assert not r.evidence_hit and r.first_evidence_rank is None and r.evidence_precision == 0 and r.retrieved_count == 0
    r = one(spark, scoring.retrieval("h", "q", "a"), h=["abc"], q=["abc", "ab", "c"], a=[])
    assert r.evidence_precision == 3.0 and r.evidence_recall == 1.0


def test_summary_of_nothing(spark):
    kind = "retrieval struct<evidence_hit:boolean,evidence_recall:double,mrr:double,retrieved_count:int>, answer_correct boolean, answer_judge_method string"
    row = scoring.summarize(spark.createDataFrame([], kind)).collect()[0]
    assert row.total == 0 and row.qa_accuracy == 0.0 and row.mrr == 0.0


def test_json(spark):
    fence = "```json\n{\"correct\": \"yes\", \"reason\": \"ok\",}\n```"
    assert json.loads(one(spark, llmjson.extract_object("x"), x=fence)) == {"correct": "yes", "reason": "ok"}
    v = one(spark, llmjson.judge_verdict("x"), x="<think>{}</think>Sure: {\"correct\": true, \"reason\": \" a } b \"} end")
    assert v.correct is True and v.reason == "a } b"
    assert one(spark, llmjson.extract_object("x"), x="no object") is None
    assert one(spark, llmjson.extract_object("x"), x="[1]") is None
    for raw in ('[{"query": "q", "answer": ["a"], "quote": "z"}]', 'Here: {"items": [{"question": "q", "answers": "a", "evidence_quote": "z"}, {"query": ""}]}', 'x [{"query":"q","answer":"a","evidence":"z"},] y'):
        got = one(spark, llmjson.qa_items("x"), x=raw)
        assert [(i.query, i.answer, i.quote) for i in got] == [("q", ["a"], "z")]
    assert one(spark, llmjson.message_text("x"), x='{"choices":[{"message":{"content":" hi "}}]}') == "hi"


def test_dataset(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text('﻿{"id": 0, "query": "a", "answer": "x", "evidence": [{"source_file": "s.md", "page": 1, "quote": " q "}, "plain"]}\r\n\r\n{"id": 1, "query": "b", "answer": [["y"], 2], "evidence": [], "positive": ["p", ["r"]]}\n', encoding="utf-8")
    rows = sorted(files.read_dataset(spark, str(p)).collect(), key=lambda r: r.id)
    assert [(r.id, r.answer, r.quotes) for r in rows] == [(0, ["x"], ["q", "plain"]), (1, ["y", "2"], ["p", "r"])]
    assert [r.id for r in files.read_dataset(spark, str(p), 1).collect()] == [0]
    assert files.count_lines(spark, str(p)) == 2
    d = files.read_dataset(spark, str(p))
    assert dataset.fallback_corpus(d).collect()[0].corpus == "q\n\nplain\n\np\n\nr"
    sources = spark.createDataFrame([("s.md", " body ")], "path string, text string")
    assert dataset.selected_corpus(d, sources).collect()[0].corpus == "# Source: s.md\n\nbody"
    assert dataset.selected_corpus(d, sources.limit(0)).collect()[0].corpus.startswith("q\n\n")
    assert [r.id for r in dataset.filter_by_ids(d, [1]).collect()] == [1]
    with pytest.raises(ValueError, match="Unknown QA ids: 7, 9"):
        dataset.filter_by_ids(d, [9, 1, 7])
    p.write_text("{bad\n")
    with pytest.raises(Exception):
        files.read_dataset(spark, str(p)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "x.corpus.md").write_text("c")
    (tmp_path / "x.json.report.json").write_text("{}")
    got = files.datasets(spark, str(tmp_path)).collect()
    assert [(r["name"], r["rows"], r["has_corpus"], r["has_assets"]) for r in got] == [("x", 2, True, False)]
    r = tmp_path / "r"
    r.mkdir()
    (r / "a.json").write_text(json.dumps({"dataset": "d", "summary": {"qa_accuracy": 0.5, "total": 4}}, indent=1))
    assert [(x.name, x.dataset, x.qa_total) for x in files.reports(spark, str(r)).collect()] == [("a.json", "d", 4)]
    out = tmp_path / "o.csv"
    files.write_csv(spark.createDataFrame([('a,"b', True, 1.5)], "x string, y boolean, z double"), str(out))
    assert out.read_bytes() == b'\xef\xbb\xbfx,y,z\n"a,""b",true,1.5\n'
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), ".MD").collect()] == ["x.corpus.md"]
    names = spark.createDataFrame([("1", "a.md"), ("2", "a.md"), ("3", "b")], "path string, name string")
    assert sorted(r.unique_name for r in files.unique_names(names).collect()) == ["a.md", "a_1.md", "b"]


def test_chunks():
    md = "# One\n\n" + "word " * 60 + "\n\n## Two\n\n" + "tok " * 80
    rows = list(chunking.chunk_rows("a.md", md, "l", [{"page": 3, "start": 0, "end": 10_000}], None))
    assert [(r[2], r[3], r[5]) for r in rows] == [(1, "a.md", "3"), (2, "a.md", "3")]
    assert "".join(r[4] for r in rows).startswith("# One") and chunking.heading_only("## x\n\n")
    table = "<table>" + "".join(f"<tr><td>{i} cell text</td></tr>\n" for i in range(9000)) + "</table>"
    rows = list(chunking.chunk_rows("t.md", table, "l", None, [{"type": "table", "start": 0, "end": len(table)}]))
    assert rows[0][6] == "display" and rows[0][8:10] == (0, len(table)) and rows[1][2] == Decimal("1.0002") and rows[1][11] == 2 and rows[-1][12] == len(rows)
    assert list(chunking.chunk_rows("e", None, "l", None, None)) == []
    assert all(chunking.tokens(p) <= 40 for p in chunking.fit("一二三四五" * 100 + "\n" + "x" * 500, 40))
    text_ = "intro\n\n![a](b.png)\n\ncaption\n\n# H\n\nrest"
    assert [t for t, *_ in chunking.atomic(text_, [{"type": "image", "start": text_.index("caption"), "end": text_.index("caption") + 7}, {"type": "x", "start": 0, "end": 4}])] == ["![a](b.png)\n\ncaption"]


def test_tokens_agree(spark):
    for s in ("", "Hello it's 12.5", "汉字 and é 1,000-2", "a b\t!"):
        assert one(spark, text.estimate_tokens("x"), x=s) == chunking.tokens(s)


def test_parsing(spark):
    f = spark.createDataFrame([("k", i, n) for i, n in enumerate([5, 300, 1, 1, 1])], "k string, i int, n int")
    assert [r.batch for r in sorted(parsing.group_batches(f, "k", "i", "n", most=2, limit=100).collect(), key=lambda r: r.i)] == [0, 1, 2, 2, 3]
    p = spark.createDataFrame([("d", 1, 0, None), ("d", 2, 200, "bad")], "doc string, part int, page_offset int, error string")
    assert tuple(parsing.failures(p).collect()[0]) == ("d", True, "bad")
    c = p.withColumn("content_list", F.array(F.struct(F.lit("text").alias("type"), F.lit(3).alias("page_idx"))))
    assert [b.page_idx for b in parsing.merge_content_lists(c).collect()[0].content_list] == [3, 203]
    spans = F.array(*[F.struct(F.lit(None).cast("string").alias("type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(g).alias("page"), F.lit(" t ").alias("title")) for a, b, g in ((0, 5, 1), (5, 9, 2), (7, 7, 3))])
    assert [(s.start, s.title) for s in one(spark, parsing.normalize_spans(spans, True))] == [(0, "t"), (5, "t")]
    assert one(spark, parsing.page_value(spans, F.lit(4), F.lit(6))) == "1-2" and one(spark, parsing.page_value(spans, F.lit(-1), F.lit(6))) == ""
    cached, fresh = parsing.split_by_cache(spark.createDataFrame([("a", "x"), ("b", "y")], "path string, digest string"), spark.createDataFrame([("x", "md")], "digest string, markdown string"))
    assert [r.path for r in cached.collect()] == ["a"] and [r.path for r in fresh.collect()] == ["b"]


def test_urls_and_retries():
    assert connectors.chat_url("http://h") == "http://h/v1/chat/completions" and connectors.chat_url("http://h/v1/") == "http://h/v1/chat/completions"
    assert connectors.models_url("http://h/v1/chat/completions") == "http://h/v1/models" and connectors.local_url("", "tags") == "http://localhost:11434/api/tags"
    p = connectors.provider_from({"apiUrl": "u", "model": "m", "apiKey": "abcdefghij", "models": "x\ny"})
    assert p.models == ("m", "x", "y") and p.masked().api_key == "abcd...ghij" and connectors.provider_from({"apiKey": "***"}, p).api_key == "abcdefghij"
    answers = [(429, "slow"), (503, ""), (200, '{"ok": 1}')]
    assert connectors.call("u", {}, {}, 1, lambda *a: answers.pop(0), (0, 0, 0)) == {"ok": 1}
    with pytest.raises(connectors.QuotaExhausted):
        connectors.call("u", {}, {}, 1, lambda *a: (402, "no"), (0,))
    with pytest.raises(connectors.QuotaExhausted):
        connectors.call("u", {}, {}, 1, lambda *a: (429, "busy"), (0,))
    with pytest.raises(connectors.HttpError):
        connectors.call("u", {}, {}, 1, lambda *a: (404, "x"), (0,))
    states = [{"a": "running", "b": "done"}, {"a": "failed", "b": "done"}]
    seen = []
    assert connectors.poll(lambda: states.pop(0), seen.append, lambda i: seen.append("!" + i), sleep=lambda s: None) == [] and seen == ["b", "!a"]


def test_evaluate_and_compare(spark):
    qa = spark.createDataFrame([(i, f"q{i}", [f"answer {i}"], [f"evidence quote number {i} with some more words"]) for i in range(4)], "id long, query string, answers array<string>, quotes array<string>")
    hits = spark.createDataFrame([(i, r, "t", f"evidence quote number {i} with some more words" if r == i + 1 else "noise") for i in range(3) for r in (1, 2, 3)], "id long, rank int, title string, content string")
    said = spark.createDataFrame([(0, "answer 0", None, None), (1, "wrong", None, None), (2, None, "402", "quota"), (3, "answer 3", None, None)], "id long, prediction string, error string, error_kind string")
    ruled = spark.createDataFrame([(1, True, "same")], "id long, correct boolean, reason string")
    rec = connectors.Recorded(hits, said, ruled)
    a = pipelines.evaluate(qa, rec, rec, rec, True, "a")
    rows = {r.id: r for r in a.collect()}
    assert {i: (r.answer_correct, r.answer_judge_method) for i, r in rows.items()} == {0: (True, "rule"), 1: (True, "model_judge"), 2: (False, "api_quota_exhausted")}
    assert [rows[i].retrieval.first_evidence_rank for i in range(3)] == [1, 2, 3]
    b = pipelines.evaluate(qa, rec, rec, None, False, "b")
    assert {r.id: r.answer_correct for r in b.collect()} == {0: True, 1: False, 2: None, 3: True}
    table, best = pipelines.compare(a, b)
    got = {r.platform: (r.qa_accuracy_percent, r.qa_total) for r in table.collect()}
    assert got == {"a": (66.67, 3), "b": (66.67, 3)} and best.collect()[0].platform == "a"


def test_http_answerer_and_judge(spark):
    def send(url, headers, body, timeout):
        q = json.loads(body)["messages"][0]["content"]
        out = "not json" if q.startswith("Does") and "p1" in q else '{"correct": true, "reason": "r"}' if q.startswith(("Does", "Turn")) else "<think>x</think>A"
        return 200, json.dumps({"choices": [{"message": {"content": out}}]})

    p = connectors.Provider("n", "http://h", "m")
    prompts = spark.createDataFrame([(1, "x")], "id long, prompt string")
    assert connectors.HttpAnswerer(p, send=send).answer(prompts).collect()[0].prediction == "A"
    rows = spark.createDataFrame([(1, "q", ["a"], ["e"], "p1"), (2, "q", ["a"], ["e"], "p2")], "id long, query string, answers array<string>, quotes array<string>, prediction string")
    assert {r.id: r.correct for r in connectors.HttpJudge(p, send=send).judge(rows).collect()} == {1: True, 2: True}
    docs = spark.createDataFrame([(1, "apples and pears"), (2, "plums")], "doc long, text string")
    hits = connectors.OverlapRetriever(docs, 1).search(spark.createDataFrame([(7, "Which pears?")], "id long, query string")).collect()
    assert [(h.id, h.rank, h.title) for h in hits] == [(7, 1, "1")]


def test_build(spark):
    inputs = spark.createDataFrame([("s.md", "Pears are green.\n\nPlums are blue.")], "source string, text string")
    raw = '{"items": [{"query": "pears?", "answer": "green", "quote": "Pears are green."}, {"query": "x?", "answer": "red", "quote": "Plums are blue."}, {"query": "y?", "answer": "z", "quote": "invented"}]}'
    generated = spark.createDataFrame([("s.md", 0, raw)], "source string, chunk_no int, raw string")
    qa, rejected = pipelines.build(inputs, generated, 10)
    assert [(r.id, r.query, r.positive) for r in qa.collect()] == [(0, "pears?", ["Pears are green."])]
    assert sorted(r.reject for r in rejected.collect()) == ["answers not found in evidence quote: ['red']", "evidence quote is not copied from source chunk"]
    assert pipelines.build(inputs, generated, 2, validate=False)[0].count() == 2


def test_job_states(spark, tmp_path):
    rows = [("j", "build", i, "log", f"l{i}") for i in range(30)] + [("j", "build", 30, "failed", ""), ("j", "build", 31, "log", "late"), ("k", "compare", 0, "log", "a")]
    events = spark.createDataFrame(rows, "job_id string, kind string, seq long, event string, line string")
    want = {r.job_id: (r.status, r.lines, r.progress, len(r.logs)) for r in jobs.latest_states(events).collect()}
    assert want == {"j": ("failed", 30, 95, 30), "k": ("running", 1, 7, 1)}
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.job_states(spark.readStream.schema(events.schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.job_id: (r.status, r.lines, r.progress, len(r.logs)) for r in spark.table("states").collect()} == want


def test_sql_functions(spark):
    from attestry.sqlfuncs import register

    assert len(register(spark)) == 8
    row = spark.sql("SELECT attestry_normalize_text(' Ａ b') a, attestry_trim('　x ') b, attestry_percent(0.66666D) c, attestry_estimate_tokens('a b') d, attestry_compact_whitespace('a \t b\r\n\r\n\r\n\r\nc') e").collect()[0]
    assert tuple(row) == ("ab", "x", 66.67, 3, "a b\n\nc")


def test_token_kernel_against_single_texts():
    import random

    import pyarrow as pa

    rng = random.Random(9)
    parts = ["a", "Bc", "'", "1", "23", ".", ",", "_", "-", "/", ":", " ", "\n", "\t", "é", "ß", "汉", "字", "鿿", "㐀", "　", " ", " ", " ", "﻿", "😀", "!", "\x0b", "\x1c", "ü'a"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(3000)]
    words, dense = text.token_weights(pa.array(texts))
    for t, w, d in zip(texts, words.tolist(), dense.tolist()):
        assert (w, d) == chunking.weights(t), repr(t)
    assert text.token_weights(pa.array(["", None]))[0].tolist() == [0, 0] and len(text.token_weights(pa.array([], pa.string()))[0]) == 0


def test_fit_against_counting_anew():
    """Sums of weights are those of the joined text at every step."""
    import random

    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choices(["word ", "x\n", "\n\n", "12.5 ", "汉字", "字。", "it's ", "long" * 9, "w?"], k=60))
        for budget in (5, 17, 60):
            got = chunking.fit(t, budget)
            assert all(chunking.tokens(p) <= budget for p in got)
            assert "".join("".join(got).split()) == "".join(t.split())


def test_repair_and_flattening(spark):
    assert one(spark, llmjson.repair("x"), x='{"a": "x\\d", }') == '{"a": "x\\\\d"}'
    assert json.loads(one(spark, llmjson.extract_object("x"), x='{"a": "x\\d"}')) == {"a": "x\\d"}
    assert one(spark, llmjson.extract_object("x"), x='{"a": NaN} {"b": 1}') == '{"b": 1}'
    assert one(spark, llmjson.extract_object("x"), x='{"a": "{"} tail') == '{"a": "{"}'
    for raw, want in (('"[2022]"', ["[2022]"]), ("[2022]", ["2022"]), ('["a", ["b", [["c", [[[["d"]]]]]]]]', ["a", "b", "c", "d"]), ('"{}"', ["{}"]), ("null", []), ('[" ", "x "]', ["x"])):
        assert one(spark, dataset.flat_strings(F.parse_json("x")), x=raw) == want


def test_match_pairs_against_every_pair(spark):
    import random

    rng = random.Random(3)
    hits = [(i, "".join(rng.choices("ab ", k=rng.randrange(0, 60)))) for i in range(120)]
    quotes = [(i, "".join(rng.choices("ab ", k=rng.choice([1, 3, 9, 26, 50])))) for i in range(60)] + [(99, None)]
    quotes += [(200 + i, hits[i][1][3:40]) for i in range(20)] + [(300 + i, "x" + hits[i][1] + "y") for i in range(20)]
    norm = lambda s: "".join((s or "").split())
    want = set()
    for i, h in hits:
        for j, q in quotes:
            a, b = norm(h), norm(q)
            if a and b and ((b[:24] if len(b) >= 24 else b) in a or a in b):
                want.add((j, i))
    h, q = spark.createDataFrame(hits, "hit long, text string"), spark.createDataFrame(quotes, "item long, quote string")
    rows = [(r.item, r.hit) for r in scoring.match_pairs(h, q, "text", "quote").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert scoring.match_pairs(h.limit(0), q, "text", "quote").count() == scoring.match_pairs(h, q.limit(0), "text", "quote").count() == 0


def test_rows_numbered_by_range(spark):
    d = spark.range(0, 500).select(((F.col("id") * 37) % 500).alias("x"), F.lit(1).alias("y"))
    for limit in (None, 40):
        got = dataset.number_rows(d, "x", limit=limit).collect()
        assert sorted((r.id, r.x) for r in got) == [(i, i) for i in range(limit or 500)]
    assert dataset.number_rows(d.limit(0), "x").count() == 0


def test_what_is_computed_once(spark):
    from attestry.sources.tables import once, remover

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = once(spark.range(10).mapInArrow(count, "id long"), "t")
    assert t.count() == t.count() == 10 and t.agg(F.sum("id")).collect()[0][0] == 45 and seen.value == 10
    folder = t.inputFiles()[0].rsplit("/", 2)[0]
    remover(spark, folder)()
    with pytest.raises(Exception):
        t.select(F.max("id")).collect()


def test_small_operators(spark):
    models = spark.createDataFrame([(0, "x-embed"), (1, "b"), (2, "good")], "pos int, id string")
    assert dataset.default_model(models, "good", "embed") == "good" and dataset.default_model(models, "none", "embed") == "b"
    with pytest.raises(ValueError):
        dataset.default_model(models, "good", ".")
    parts = spark.createDataFrame([("d", 1, 2, "1-2", 0, "one", None), ("d", 2, 2, "3-4", 2, None, "lost"), ("e", 1, 1, "1", 0, None, "gone")], "doc string, part int, of int, pages string, page_offset int, markdown string, error string")
    got = {r.doc: r for r in parsing.merge_results(parts.withColumn("content_list", F.array(F.struct(F.lit(1).alias("page_idx"))))).collect()}
    assert got["d"].success and got["d"].error == "lost" and got["d"].markdown.endswith("part: 1/2 -->\n\none") and [b.page_idx for b in got["d"].content_list] == [1]
    assert not got["e"].success and got["e"].markdown is None
    hits = F.array(*[F.struct(F.lit(a).alias("title"), F.lit(b).alias("content"), F.lit(k).alias("kb")) for a, b, k in (("t", "c1", "K"), ("", " ", "K"), ("", "c3", ""))])
    assert "[1] K / t\nc1\n\n[3]\nc3\n" in one(spark, connectors.answer_prompt(F.lit("q"), hits, "kb")) and "[1] t\nc1" in one(spark, connectors.answer_prompt(F.lit("q"), hits))
    events = spark.createDataFrame([("j", "build", 0, "log", "a")], "job_id string, kind string, seq long, event string, line string")
    assert [r.status for r in jobs.latest_states(events.unionAll(jobs.cancel(spark, "j", 1))).collect()] == ["cancelled"]
    none = "array<struct<type:string,start:int,end:int,page:int,title:string>>"
    docs = spark.createDataFrame([("a", "# T\n\nbody"), ("b", "x")], "doc string, text string").withColumn("page_spans", F.array().cast(none)).withColumn("semantic_spans", F.when(F.col("doc") == "b", F.array(F.struct(F.lit("table").alias("type"), F.lit(None).cast("int").alias("start"), F.lit(2).alias("end"), F.lit(1).alias("page"), F.lit("").alias("title")))).otherwise(F.array().cast(none)))
    assert sorted((r.doc, r.fragmentRole) for r in chunking.markdown_chunks(docs, "l", skip=True).collect()) == [("a", None), ("b", "error")]
