"""Outside services as table functions: parser, retriever, answerer and judge.

Each takes a DataFrame and gives one back. Recorded ones join a table of what a
service said, so that runs repeat; HTTP ones call the service from the executors, a
few requests at a time, and turn failures into rows.
"""

from __future__ import annotations

import io
import json
import os
import re
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import QUOTA, c, split_list, text, trim
from attestry.sources.tables import once

DELAYS = (2.0, 6.0, 12.0)
NO_CONTEXT = "未检索到可用资料。"


class QuotaExhausted(Exception):
    pass


class HttpError(Exception):
    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"HTTP {status}: {body[:1000]}")
        self.status, self.body = status, body


@dataclass(frozen=True)
class Provider:
    """A chat service. kind: "chat" for the common completions protocol, "local" for a
    local runner with its own; token_field names the budget's field."""

    name: str
    url: str
    model: str
    models: tuple[str, ...] = ()
    api_key: str = ""
    auth: str = "bearer"
    kind: str = "chat"
    max_tokens: int = 4096
    temperature: float = 0.0
    top_p: float = 0.95
    context: int = 8192
    token_field: str = "max_tokens"
    extra: dict = field(default_factory=dict)
    fallback: str = ""

    def masked(self) -> Provider:
        k = self.api_key
        return replace(self, api_key=f"{k[:4]}...{k[-4:]}" if len(k) > 8 else "***" if k else "")

    def headers(self) -> dict[str, str]:
        auth = {"bearer": {"Authorization": f"Bearer {self.api_key}"}, "api-key": {"api-key": self.api_key}}.get(self.auth, {})
        return {"Content-Type": "application/json"} | (auth if self.api_key else {})

    def endpoint(self) -> str:
        return local_url(self.url, "chat") if self.kind == "local" else chat_url(self.url)

    def payload(self, messages: list[dict], budget: int | None, purpose: str) -> dict:
        budget = budget or self.max_tokens
        body = {"model": self.model, "messages": messages, "stream": False}
        if self.kind == "local":
            body |= {"think": False, "options": {"num_ctx": context_length(self.context), "num_predict": budget}}
            return body | ({"format": "json"} if purpose.startswith("judge") or purpose == "dataset generation" else {})
        return body | {"temperature": self.temperature, "top_p": self.top_p, self.token_field: budget} | self.extra


#: name: (url, variable of the key, models); more by save_provider.
PRESETS = {
    "deepseek": ("https://api.deepseek.com/v1", "DEEPSEEK_API_KEY", ("deepseek-chat", "deepseek-reasoner")),
    "dashscope": ("https://dashscope.aliyuncs.com/compatible-mode/v1", "DASHSCOPE_API_KEY", ("qwen-plus", "qwen-turbo", "qwen-max")),
    "siliconflow": ("https://api.siliconflow.cn/v1", "SILICONFLOW_API_KEY", ("Qwen/Qwen3-8B",)),
    "local": ("http://localhost:11434/v1", "", ("qwen3:8b", "llama3.2")),
    "custom": ("https://api.example.com/v1", "CUSTOM_API_KEY", ("custom-model",)),
}


def preset(name: str) -> Provider:
    """A provider by name, with the key that its variable holds."""
    url, variable, models = PRESETS[name]
    return Provider(name, url, models[0], models, os.environ.get(variable, "") if variable else "", kind="local" if name == "local" else "chat")


def save_provider(provider: Provider, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(provider), f, ensure_ascii=False, indent=2)


def load_provider(path: str, default: Provider) -> Provider:
    """The saved provider, or the default where none can be read."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            return provider_from(json.load(f), default)
    except (OSError, ValueError):
        return default


def list_models(provider: Provider, timeout: float = 20, send: Callable | None = None) -> list[str]:
    """Names of the models that a service offers, each once, in its order; none is an error."""
    url = local_url(provider.url, "tags") if provider.kind == "local" else models_url(provider.url)
    status, body = (send or http)(url, provider.headers(), None, timeout)
    if status >= 400:
        raise HttpError(status, body)
    data = json.loads(body or "{}")
    items = data if isinstance(data, list) else data.get("models" if provider.kind == "local" else "data") or []
    names = [str((x.get("name") or x.get("model") or x.get("id") or "") if isinstance(x, dict) else x).strip() for x in items]
    out = list(dict.fromkeys(n for n in names if n))
    if not out:
        raise ValueError(f"{provider.name} offers no models")
    return out


def usage(x: Column | str) -> Column:
    """Struct of prompt, completion and total tokens of a chat response as JSON, of either
    protocol; what is missing counts 0."""
    v = F.try_parse_json(c(x))
    get = lambda *paths: F.coalesce(*(F.try_variant_get(v, p, "bigint") for p in paths), F.lit(0).cast("bigint"))
    p, o = get("$.usage.prompt_tokens", "$.prompt_eval_count"), get("$.usage.completion_tokens", "$.eval_count")
    return F.struct(p.alias("prompt_tokens"), o.alias("completion_tokens"), F.coalesce(F.try_variant_get(v, "$.usage.total_tokens", "bigint"), p + o).alias("total_tokens"))


def provider_from(options: dict, saved: Provider | None = None) -> Provider:
    """Options under either spelling (apiUrl, api_url ...); an empty or masked key leaves
    the saved one."""
    snake = {re.sub(r"([A-Z])", r"_\1", k).lower(): v for k, v in options.items()}
    base = saved or Provider(snake.get("name", "custom"), "", "")
    names = {"api_url": "url", "provider_name": "name", "auth_type": "auth", "extra_body": "extra"}
    known = {names.get(k, k): v for k, v in snake.items() if names.get(k, k) in Provider.__dataclass_fields__ and v not in (None, "")}
    if "models" in known:
        known["models"] = tuple(x for x in (known["models"] if isinstance(known["models"], (list, tuple)) else re.split(r"[\n,]+", known["models"])) if x.strip())
    if re.fullmatch(r"\*{3}|.{4}\.{3}.{4}", known.get("api_key", "")):
        known.pop("api_key")
    out = replace(base, **known)
    return out if not out.model or out.model in out.models else replace(out, models=(out.model, *out.models))


def context_length(n: object) -> int:
    try:
        n = int(n)
    except (TypeError, ValueError):
        return 8192
    return n if 4096 <= n <= 262144 else 8192


VERSIONED = re.compile(r"(?:/v1|/v2|/api/paas/v4)$")


def chat_url(url: str) -> str:
    v = url.strip().rstrip("/")
    if not v or v.endswith("/chat/completions"):
        return v
    if VERSIONED.search(v):
        return v + "/chat/completions"
    for n in ("/v1/", "/v2/"):
        if n in v:
            return v.replace(n, f"{n}chat/completions/", 1)
    return v if "/v1" in v or "/v2" in v else v + "/v1/chat/completions"


def models_url(url: str) -> str:
    v = url.strip().rstrip("/").removesuffix("/chat/completions")
    if not v or v.endswith("/models"):
        return v
    if VERSIONED.search(v):
        return v + "/models"
    for n in ("/v1/", "/v2/"):
        if n in v:
            return v.split(n, 1)[0] + n + "models"
    return v + ("/models" if "/v1" in v or "/v2" in v else "/v1/models")


def local_url(url: str, what: str) -> str:
    v = (url or "http://localhost:11434/v1").strip().rstrip("/")
    for suffix in ("/v1/chat/completions", "/v1/models", "/v1", "/api/chat", "/api/tags"):
        if v.endswith(suffix):
            v = v.removesuffix(suffix)
            break
    return f"{v.rstrip('/')}/api/{what}"


def is_quota(status: int, body: str) -> bool:
    low = body.lower()
    return status == 402 or any(p in low for p in QUOTA)


Transport = Callable[[str, dict, bytes | None, float], tuple[int, str]]


def http(url: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def call(url: str, headers: dict, payload: dict, timeout: float, send: Transport = http, delays: tuple[float, ...] = DELAYS) -> dict:
    """The JSON answer. Busy and failing services are asked again after the delays; a
    used-up quota is not, nor is a busy service after the last."""
    body, last = json.dumps(payload).encode(), ""
    for delay in (*delays, None):
        try:
            status, answer = send(url, headers, body, timeout)
        except OSError as e:
            status, answer = 0, str(e)
        if status >= 400 and is_quota(status, answer[:800]):
            raise QuotaExhausted(f"HTTP {status} {answer[:800]}")
        if 200 <= status < 400:
            try:
                return json.loads(answer or "{}")
            except ValueError as e:
                status, answer = 0, str(e)
        last = f"HTTP {status} {answer[:300]}"
        if delay is None:
            break
        time.sleep(delay)
    if last.startswith("HTTP 429"):
        raise QuotaExhausted(last)
    raise HttpError(int(last.split()[1]), last)


def message_of(data: dict) -> str:
    parts = data.get("content")
    if isinstance(parts, list):  # the protocol of messages
        return "".join(str(p.get("text") or "") for p in parts if isinstance(p, dict)).strip()
    m = ((data.get("choices") or [{}])[0] or {}).get("message") or data.get("message") or {}
    return (m.get("content") if m.get("content") is not None else m.get("reasoning_content") or "").strip()


def chat(df: DataFrame, messages: Column | str, out: str, provider: Provider, budget: int, purpose: str, timeout: float = 300, parallel: int = 4, send: Transport = http, delays: tuple[float, ...] = DELAYS) -> DataFrame:
    """df with out (the answer), error and error_kind (quota or error) of a request for
    each row; messages is JSON. parallel bounds the requests of a task at a time. Where a
    provider names an error as its fallback, that one is tried under /messages."""
    from pyspark.sql import types as T

    ready, names = df.withColumn("__messages", c(messages)), df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.StringType()) for x in (out, "error", "error_kind"))])

    def ask(m: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            body = provider.payload(json.loads(m or "[]"), budget, purpose)
            try:
                return message_of(call(provider.endpoint(), provider.headers(), body, timeout, send, delays)), None, None
            except HttpError as e:
                if not provider.fallback or provider.fallback not in str(e):
                    raise
                other = provider.endpoint().replace("/chat/completions", "/messages")
                return message_of(call(other, provider.headers(), body, timeout, send, delays)), None, None
        except QuotaExhausted as e:
            return None, str(e), "quota"
        except Exception as e:
            return None, str(e), "error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                got = list(pool.map(ask, b.column("__messages").to_pylist()))
                cols = [b.column(x) for x in names] + [pa.array(list(x), pa.string()) for x in (zip(*got) if got else ((), (), ()))]
                yield pa.record_batch(cols, [*names, out, "error", "error_kind"])

    return ready.mapInArrow(run, schema)


class Retriever(Protocol):
    def search(self, questions: DataFrame) -> DataFrame:
        """questions (id, query) to hits (id, rank, title, content), and, if it can fail,
        rows with id and error alone."""


class Generator(Protocol):
    def generate(self, chunks: DataFrame) -> DataFrame:
        """chunks (source, chunk_no, chunk) to (source, chunk_no, raw)."""


class Answerer(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame:
        """prompts (id, prompt) to (id, prediction, error, error_kind)."""


class Judge(Protocol):
    def judge(self, rows: DataFrame) -> DataFrame:
        """rows (id, query, answers, quotes, prediction) to (id, correct, reason)."""


class Parser(Protocol):
    def parse(self, files: DataFrame) -> DataFrame:
        """files (path, content) to (path, markdown, content_list, error)."""


@dataclass
class Recorded:
    """What services said before, by id, number of chunk or name of file."""

    hits: DataFrame | None = None
    predictions: DataFrame | None = None
    judgements: DataFrame | None = None
    parsed: DataFrame | None = None
    generated: DataFrame | None = None

    def generate(self, chunks: DataFrame) -> DataFrame:
        """By chunk_no, whatever the source."""
        return chunks.select("source", "chunk_no").join(self.generated.select("chunk_no", "raw"), "chunk_no", "left").select("source", "chunk_no", "raw")

    def search(self, questions: DataFrame) -> DataFrame:
        return self.hits.join(questions.select("id"), "id", "left_semi")

    def answer(self, prompts: DataFrame) -> DataFrame:
        lost = F.lit("no recorded answer")
        p = prompts.select("id").join(self.predictions, "id", "left")
        none = F.col("prediction").isNull() & F.col("error").isNull()
        return p.select("id", "prediction", F.when(none, lost).otherwise(F.col("error")).alias("error"), F.when(none, F.lit("error")).otherwise(F.col("error_kind")).alias("error_kind"))

    def judge(self, rows: DataFrame) -> DataFrame:
        return self.judgements.join(rows.select("id"), "id", "left_semi")

    def parse(self, files: DataFrame) -> DataFrame:
        base = F.element_at(F.split("path", "/"), -1)
        return files.select("path", base.alias("name")).join(self.parsed, "name", "left").drop("name")


@dataclass
class HttpGenerator:
    """Questions for chunks: a model that answers with a JSON array of query, answer and
    evidence_quote for each."""

    provider: Provider
    per_chunk: int = 3
    timeout: float = 300
    send: Transport = http

    def generate(self, chunks: DataFrame) -> DataFrame:
        """chunks (source, chunk_no, chunk) to (source, chunk_no, raw, error)."""
        ask = F.concat(
            F.lit(f"Write {self.per_chunk} questions that the text below answers by itself, in its language. Keep answers short: names, numbers, dates, places, items. evidence_quote is copied from the text word for word and proves the answer. Invent nothing."),
            F.lit(' Return a JSON array only: [{"query": "...", "answer": ["..."], "evidence_quote": "..."}]\n\nText:\n'), F.col("chunk"),
        )
        m = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit("You write exact, traceable test questions, as JSON only.").alias("content")), F.struct(F.lit("user").alias("role"), ask.alias("content"))))
        got = chat(chunks.select("source", "chunk_no", "chunk"), m, "raw", self.provider, 1800, "dataset generation", self.timeout, send=self.send)
        return got.select("source", "chunk_no", "raw", "error")


@dataclass
class HttpPlatform:
    """What a retrieval platform offers beside search, asked by the driver."""

    url: str
    headers: dict = field(default_factory=dict)
    timeout: float = 60
    send: Transport = http

    def get(self, path: str) -> dict | list:
        status, body = self.send(self.url.rstrip("/") + path, self.headers, None, self.timeout)
        if status >= 400:
            raise HttpError(status, body)
        return json.loads(body or "{}")

    def healthy(self, path: str = "/health") -> bool:
        try:
            return self.get(path) is not None
        except (OSError, ValueError, HttpError):
            return False

    def _rows(self, path: str, spark) -> DataFrame:
        data = self.get(path)
        items = data if isinstance(data, list) else next((data[k] for k in ("knowledge_bases", "data", "items", "results") if isinstance(data.get(k), list)), [])
        rows = [(i, str(x.get("id") or ""), str(x.get("name") or x.get("id") or "")) for i, x in enumerate(items) if isinstance(x, dict)]
        return spark.createDataFrame(rows, "pos int, id string, name string")

    def knowledge_bases(self, spark, path: str = "/v1/knowledge-bases") -> DataFrame:
        return self._rows(path, spark)

    def models(self, spark, path: str = "/v1/models") -> DataFrame:
        return self._rows(path, spark)

    def upload(self, title: str, files: dict[str, str], path: str = "/api/kb") -> str:
        """The id of a new knowledge base that holds the files (name: Markdown)."""
        made = call(self.url.rstrip("/") + path, self.headers | {"Content-Type": "application/json"}, {"title": title}, self.timeout, self.send, ())
        ident = str(made.get("id") or (made.get("data") or {}).get("id") or "")
        if not ident:
            raise ValueError("the platform gave no id")
        for name, text_ in files.items():
            call(f"{self.url.rstrip('/')}{path}/{ident}/documents", self.headers | {"Content-Type": "application/json"}, {"name": name, "content": text_}, self.timeout, self.send, ())
        return ident


def unpack(data: bytes) -> tuple[str, str | None]:
    """Markdown and content list (JSON) of a parser's archive: full.md before any other, and
    the file of blocks by its name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if not n.endswith("/"))
        base = lambda n: n.rsplit("/", 1)[-1].lower()
        md = sorted((n for n in names if n.lower().endswith(".md")), key=lambda n: (base(n) != "full.md", n))
        blocks = [n for n in names if base(n).endswith("content_list.json")]
        if not md:
            raise ValueError("no Markdown in the archive")
        read = lambda n: z.read(n).decode("utf-8-sig", "replace")
        return read(md[0]), read(blocks[0]) if blocks else None


@dataclass
class HttpParser:
    """A parsing service with batches: it gives a place to send each file to, works on them,
    and offers an archive for each. get and put take and give bytes."""

    url: str
    headers: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    interval: float = 3
    deadline: float = 1800
    timeout: float = 300
    send: Transport = http
    transfer: Callable[[str, bytes | None, float], bytes] | None = None
    wait: Callable[[float], None] = time.sleep

    def parse(self, files: DataFrame) -> DataFrame:
        """files (path, content) to (path, markdown, content_list, error), batch by batch."""
        from attestry.operators.parsing import group_batches
        from attestry.sources.options import upload_name

        me, delays = self, (2.0, 6.0)
        transfer = self.transfer or _transfer
        json_headers = self.headers | {"Content-Type": "application/json"}

        def work(names: list[str], contents: list[bytes]) -> list[tuple]:
            sent = [f"{i:03d}_{upload_name(n.rsplit('/', 1)[-1])}" for i, n in enumerate(names)]
            made = call(f"{me.url}/batch", json_headers, {"files": [{"name": s, "data_id": str(i)} for i, s in enumerate(sent)]} | me.options, me.timeout, me.send, delays)
            out: dict[str, tuple] = {}
            for i, place in enumerate(made["file_urls"]):
                transfer(place, contents[i], me.timeout)
            last: dict[str, dict] = {}

            def status() -> dict[str, str]:
                code, body = me.send(f"{me.url}/batch/{made['batch_id']}", me.headers, None, me.timeout)
                if code >= 400:
                    raise HttpError(code, body)
                for r in json.loads(body)["results"]:
                    last[str(r.get("data_id") or sent.index(r["file_name"]))] = r
                return {str(i): last.get(str(i), {}).get("state", "waiting") for i in range(len(names))}

            def done(i: str) -> None:
                try:
                    out[i] = (*unpack(transfer(last[i]["archive_url"], None, me.timeout)), None)
                except Exception as e:
                    out[i] = (None, None, str(e))

            left = poll(status, done, lambda i: out.update({i: (None, None, str(last[i].get("error") or "failed"))}), me.interval, me.deadline, me.wait)
            for i in left:
                out[i] = (None, None, "not done in time")
            return [(n, *out[str(i)]) for i, n in enumerate(names)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, str, bytes]] = []

            def flush() -> pa.RecordBatch:
                names, contents = [h[1] for h in held], [h[2] for h in held]
                try:
                    rows = work(names, contents)
                except Exception as e:  # a batch that fails is rows, as a file that fails is
                    rows = [(n, None, None, str(e)) for n in names]
                return pa.record_batch([pa.array(list(x), pa.string()) for x in zip(*rows)], ["path", "markdown", "content_list", "error"])

            for b in batches:
                for row in zip(*(b.column(x).to_pylist() for x in ("batch", "path", "content"))):
                    if held and held[0][0] != row[0]:
                        yield flush()
                        held.clear()
                    held.append(row)
            if held:
                yield flush()

        sized = files.select("path", "content", F.length("content").alias("size"), F.pmod(F.xxhash64("path"), F.lit(files.sparkSession.sparkContext.defaultParallelism)).alias("lane"))
        ready = group_batches(sized, "lane", "path", "size")
        return ready.mapInArrow(run, "path string, markdown string, content_list string, error string")


def _transfer(url: str, data: bytes | None, timeout: float) -> bytes:
    request = urllib.request.Request(url, data, method="PUT" if data is not None else "GET")
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read()


@dataclass
class HttpAnswerer:
    provider: Provider
    timeout: float = 300
    send: Transport = http

    def answer(self, prompts: DataFrame) -> DataFrame:
        from attestry.functions.text import strip_thinking

        m = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))
        got = chat(prompts.select("id", "prompt"), m, "prediction", self.provider, 2048, "answer", self.timeout, send=self.send)
        return got.select("id", F.when(F.col("prediction").isNotNull(), strip_thinking("prediction")).alias("prediction"), "error", "error_kind")


@dataclass
class HttpJudge:
    """A model that answers {"correct", "reason"}; what is no JSON is repaired once."""

    provider: Provider
    timeout: float = 300
    send: Transport = http

    def judge(self, rows: DataFrame) -> DataFrame:
        from attestry.functions.llmjson import judge_verdict

        content = F.concat(
            F.lit('Does the answer cover every key point of the reference? Other wording, other order, citation marks and harmless additions are fine; wrong or missing numbers, dates, names or list items are not. Answer only with JSON {"correct": true, "reason": "..."}.'),
            F.lit("\n\nQuestion: "), text("query"), F.lit("\n\nReference: "), F.to_json("answers"), F.lit("\n\nEvidence: "), F.to_json(F.slice("quotes", 1, 3)), F.lit("\n\nAnswer: "), text("prediction"),
        )
        m = F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))
        first = chat(rows.select("id", "query", "answers", "quotes", "prediction"), m, "raw", self.provider, 512, "judge", self.timeout, send=self.send)
        first = once(first.select("id", "raw", judge_verdict("raw").alias("v")), "judged")
        fix = F.concat(F.lit('Turn this into one valid JSON object {"correct": true, "reason": "..."} and return only that.\n\n'), F.substring(F.coalesce("raw", F.lit("")), 1, 4000))
        again = chat(first.where("v is null and raw is not null").select("id", "raw"), F.to_json(F.array(F.struct(F.lit("user").alias("role"), fix.alias("content")))), "raw2", self.provider, 256, "judge json repair", self.timeout, send=self.send)
        second = again.select("id", judge_verdict("raw2").alias("v"))
        return first.where("v is not null").select("id", "v").unionByName(second).select("id", F.coalesce("v.correct", F.lit(False)).alias("correct"), F.coalesce("v.reason", F.lit("")).alias("reason"))


@dataclass
class HttpRetriever:
    """A search service: POST {query, documentCount} to its url, hits under results, a few
    requests of a task at a time. A search that fails is a row with its error alone."""

    url: str
    headers: dict = field(default_factory=dict)
    k: int = 5
    timeout: float = 60
    send: Transport = http
    parallel: int = 4
    delays: tuple[float, ...] = DELAYS

    def search(self, questions: DataFrame) -> DataFrame:
        url, headers, k, timeout, send = self.url, self.headers | {"Content-Type": "application/json"}, max(1, min(20, self.k)), self.timeout, self.send
        parallel, delays = self.parallel, self.delays

        def ask(i: int, q: str) -> list[tuple]:
            try:
                found = call(url, headers, {"query": q, "documentCount": k}, timeout, send, delays)
            except Exception as e:
                return [(i, None, None, None, str(e))]
            out = []
            for rank, h in enumerate((found.get("results") or found.get("hits") or [])[:k], 1):
                meta = h.get("metadata") or {}
                out.append((i, rank, h.get("title") or meta.get("source") or meta.get("file") or meta.get("path") or "", h.get("content") or h.get("pageContent") or "", None))
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(parallel) as pool:
                for b in batches:
                    rows = [r for got in pool.map(ask, b.column(0).to_pylist(), b.column(1).to_pylist()) for r in got]
                    if rows:
                        yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["id", "rank", "title", "content", "error"])

        return questions.select("id", "query").mapInArrow(run, "id long, rank int, title string, content string, error string")


@dataclass
class OverlapRetriever:
    """A baseline that needs no service: documents (doc, text) by how many words of the
    question they share, rare words counting more. An inverted index joined by word."""

    docs: DataFrame
    k: int = 5

    def search(self, questions: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        words = lambda x: F.explode(F.array_distinct(split_list(F.lower(x), r"[^\p{L}\p{N}]+"))).alias("w")
        q = questions.select("id", words(F.col("query")))
        wanted = q.select("w").distinct()
        index = self.docs.select("doc", words(F.col("text"))).join(wanted, "w", "left_semi")
        weight = index.groupBy("w").agg((1 / F.log(F.count(F.lit(1)) + 1.5)).alias("x"))
        score = q.join(index, "w").join(weight, "w").groupBy("id", "doc").agg(F.sum("x").alias("s"))
        top = score.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "doc"))).where(F.col("rank") <= self.k)
        return top.join(self.docs, "doc").select("id", "rank", F.col("doc").cast("string").alias("title"), F.col("text").alias("content"))


def answer_prompt(query: Column | str, hits: Column | str, base: str | None = None) -> Column:
    """Numbered context of ranked hits (title, content), blank ones left out without
    renumbering the others. base names a field of hits with the knowledge base, which comes
    before the title."""

    def head(h: Column) -> Column:
        names = F.filter(F.array(*[trim(text(h[x])) for x in ([base] if base else []) + ["title"]]), lambda x: x != "")
        return F.when(F.size(names) > 0, F.concat(F.lit(" "), F.array_join(names, " / "))).otherwise("")

    each = F.filter(F.transform(c(hits), lambda h, i: F.when(trim(text(h["content"])) != "", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), head(h), F.lit("\n"), trim(text(h["content"]))))), lambda x: x.isNotNull())
    context = F.when(F.size(each) > 0, F.array_join(each, "\n\n")).otherwise(NO_CONTEXT)
    return F.concat(F.lit("Answer from the material below only, as briefly as possible. If it does not suffice, say so.\n\nMaterial:\n"), context, F.lit("\n\nQuestion: "), text(query))


def knowledge_base_names(hits: DataFrame, bases: DataFrame) -> DataFrame:
    """hits with knowledge_base_name of their knowledge_base_id, empty if unknown."""
    return hits.join(bases.select(F.col("id").alias("knowledge_base_id"), F.col("name").alias("knowledge_base_name")), "knowledge_base_id", "left").fillna("", ["knowledge_base_name"])


def poll(status: Callable[[], dict[str, str]], on_done: Callable[[str], None], on_failed: Callable[[str], None], interval: float = 3, deadline: float = 1800, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Asks until every id is done or failed, and handles each once; ids that are left at
    the deadline are returned."""
    seen: set[str] = set()
    waited = 0.0
    while True:
        now = status()
        for i, s in now.items():
            if i not in seen and s in ("done", "success", "failed", "error"):
                seen.add(i)
                (on_done if s in ("done", "success") else on_failed)(i)
        left = sorted(set(now) - seen)
        if not left or waited >= deadline:
            return left
        sleep(interval)
        waited += interval
