"""Options, names and paths: what comes from a command line or a request, made safe."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from dataclasses import dataclass, fields
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.text import c, text

TRUE = ("1", "true", "yes", "on")


def as_bool(value: object, default: bool = False) -> bool:
    return default if value is None else value if isinstance(value, bool) else str(value).strip().lower() in TRUE


def as_int(value: object, default: int = 0) -> int:
    """The whole number that a text begins with."""
    m = re.match(r"\s*([+-]?\d+)", str(value if value is not None else ""))
    return int(m[1]) if m else default


def as_float(value: object, default: float = 0.0) -> float:
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", str(value if value is not None else ""))
    return float(m[1]) if m else default


def as_list(value: object) -> list[str]:
    parts = value if isinstance(value, (list, tuple)) else re.split(r"[,\n]", str(value or ""))
    return [p for p in (str(x).strip() for x in parts) if p]


@dataclass(frozen=True)
class Options:
    """Made by of(payload), from the names of the fields in snake or camel case and the
    aliases; what is missing or does not parse is the default."""

    @classmethod
    def of(cls, payload: dict, **aliases: str):
        snake = {re.sub(r"(?<!^)([A-Z])", r"_\1", k).lower().replace("-", "_"): v for k, v in payload.items() if v is not None and v != ""}
        snake |= {to: snake[k] for k, to in aliases.items() if k in snake and to not in snake}
        read = {"bool": as_bool, "int": as_int, "float": as_float, "tuple[str, ...]": lambda v, d: tuple(as_list(v)), "str": lambda v, d: str(v)}
        return cls(**{f.name: read[f.type](snake[f.name], f.default) for f in fields(cls) if f.name in snake})


@dataclass(frozen=True)
class BuildOptions(Options):
    dataset: str = "dataset"
    target_count: int = 20
    questions_per_chunk: int = 3
    timeout: int = 300
    parse: bool = True
    validate: bool = True


@dataclass(frozen=True)
class EvalOptions(Options):
    dataset: str = "dataset"
    dataset_path: str = ""
    corpus_path: str = ""
    api_base: str = "http://127.0.0.1:3335"
    api_key: str = ""
    knowledge_base_ids: tuple[str, ...] = ()
    model: str = ""
    document_count: int = 20
    limit: int = 0
    ids: str = ""
    output: str = ""
    mode: str = "qa"
    judge_mode: str = "rule_then_model"
    timeout: int = 900
    temperature: float = 0.0
    max_tokens: int = 1024
    stop_at_quota: bool = True


#: The second kind of platform: fewer seconds, and failures that are no verdicts.
SECOND = {"api_base": "http://127.0.0.1:23333", "timeout": 300, "document_count": 5, "stop_at_quota": False}


def dataset_name(name: str) -> str:
    """The name, if it is one that needs no cleaning; else an error."""
    if not re.fullmatch(r"[A-Za-z0-9_.\-]+", name or "") or name in (".", ".."):
        raise ValueError(f"not a dataset's name: {name!r}")
    return name


def inside(path: str, *roots: str) -> str:
    """The real path, if it lies in one of the roots; else an error."""
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise ValueError(f"outside of {', '.join(roots)}: {real}")
    return real


def report_of(filename: str, dataset: str) -> bool:
    return filename.startswith(f"{dataset}_") or f"_{dataset}_" in filename


def resolve(folder: str, name: str, dataset: str = "", corpus: str = "") -> tuple[str, str | None]:
    """Paths of a dataset and of its corpus: given ones first; else name.json of the folder,
    and the corpus that its build report names, name.corpus.txt or name.corpus.md."""
    found = os.path.abspath(dataset or os.path.join(folder, f"{name}.json"))
    for path, given in ((found, True), (corpus and os.path.abspath(corpus), corpus)):
        if given and not os.path.exists(path):
            raise FileNotFoundError(path)
    if corpus:
        return found, os.path.abspath(corpus)
    stem = os.path.join(folder, Path(found).stem)
    try:
        report = json.loads(Path(f"{stem}.json.report.json").read_text("utf-8-sig"))
    except (OSError, ValueError):
        report = {}
    named = [str(report.get(k) or "").strip() for k in ("corpus_path", "corpus", "corpus_source")] if isinstance(report, dict) else []
    return found, next((os.path.abspath(x) for x in [*filter(None, named), f"{stem}.corpus.txt", f"{stem}.corpus.md"] if os.path.exists(x)), None)


def delete_dataset(folder: str, reports: str, name: str) -> list[str]:
    """A dataset, its corpora, report and assets, and the evaluation reports whose name or
    content names it; the paths that were there."""
    dataset_name(name)
    own = [os.path.join(folder, name + x) for x in (".json", ".json.report.json", ".corpus.txt", ".corpus.md")]
    for path in sorted(Path(reports).glob("*.json")) if os.path.isdir(reports) else []:
        try:
            payload = json.loads(path.read_text("utf-8-sig"))
        except (OSError, ValueError):
            payload = {}
        if report_of(path.name, name) or isinstance(payload, dict) and name in (payload.get("dataset"), payload.get("dataset_name")):
            own.append(str(path))
    gone = []
    for path in own:
        if os.path.isfile(inside(path, folder, reports)):
            os.remove(path)
            gone.append(path)
    assets = os.path.join(folder, "assets", name)
    if os.path.isdir(inside(assets, folder)):
        import shutil

        shutil.rmtree(assets)
        gone.append(assets)
    return gone


def key_from(given: str = "", variable: str = "", path: str = "") -> str:
    """A key as given, else of the environment, else the first line of a file."""
    if given.strip():
        return given.strip()
    if variable and os.environ.get(variable, "").strip():
        return os.environ[variable].strip()
    try:
        return Path(path).read_text("utf-8-sig").strip().splitlines()[0].strip() if path else ""
    except (OSError, IndexError):
        return ""


def timestamp_compact(at: datetime | None = None) -> str:
    return f"{at or datetime.now(timezone.utc):%Y%m%d_%H%M%S}"


def timestamp_iso(at: datetime | None = None) -> str:
    return f"{(at or datetime.now(timezone.utc)).astimezone(timezone.utc):%Y-%m-%dT%H:%M:%S%z}"


def iso_column(at: Column | str) -> Column:
    return F.date_format(c(at), "yyyy-MM-dd'T'HH:mm:ssxx")


def compact_column(at: Column | str) -> Column:
    return F.date_format(c(at), "yyyyMMdd_HHmmss")


def data_id(value: Column | str, *salt: Column | str) -> Column:
    """An id of 32 signs; the same for the same value and salt."""
    return F.md5(F.concat_ws(":", *[text(x) for x in (value, *salt)]))


def upload_name(name: str) -> str:
    """A name in ASCII: others are encoded, with their ending if that is plain."""
    if name.isascii():
        return name
    ending = PurePosixPath(name).suffix
    coded = base64.b64encode(name.encode()).decode()
    return re.sub("[/+=]", "_", coded)[:180] + (ending if re.fullmatch(r"[A-Za-z0-9.]+", ending) else ".bin")


def file_name(name: str, default: str = "file") -> str:
    clean = re.sub(r'[\x00-\x1f<>:"|?*]+', "_", re.sub(r"[\\/]+", "_", name))
    return re.sub(r"\s+", " ", clean).strip() or default


def artifact_stem(path: str) -> str:
    return re.sub(r"\s+", "_", file_name(PurePosixPath(path).stem, "parsed"))[:120]


def zip_member_name(name: str) -> str:
    return file_name("__".join(p for p in re.split(r"[\\/]", name) if p not in ("", ".", "..")), "artifact")[:180]


def id_by_file_name(files, parts):
    """files (file_name) with the data_id of the part (data_id, upload_name, ord) whose name,
    plain or encoded, it is; the first of several; null if there is none."""
    coded = F.udf(upload_name, "string")
    names = parts.select("data_id", "ord", F.explode(F.array_distinct(F.array("upload_name", coded("upload_name")))).alias("file_name"))
    first = names.groupBy("file_name").agg(F.min_by("data_id", "ord").alias("data_id"))
    return files.join(first, "file_name", "left")


def download_url(path: Column | str) -> Column:
    return F.when(text(path) == "", "").otherwise(F.concat(F.lit("/download?path="), F.replace(F.url_encode(text(path)), F.lit("+"), F.lit("%20"))))


def download_path(path: str) -> str:
    return f"/download?path={quote(path, safe='')}" if path else ""


def digest_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
