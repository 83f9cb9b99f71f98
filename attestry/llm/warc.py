"""WARC files: a writer, and a reader that salvages what damage has left."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.shared import col, new_path

CHUNK = 1 << 18
HEADERS = 16 << 20  # bytes of a record's headers at most
VERSION = re.compile(rb"WARC/\d\.\d{1,4}\r\n")
SCHEMA = "path string, kind string, start long, end long, offset long, type string, record_id string, uri string, date string, payload binary, reason string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("offset", pa.int64()), *((c, pa.string()) for c in ("type", "record_id", "uri", "date")), ("payload", pa.binary()), ("reason", pa.string())])


def record(uri: str, payload: bytes, ident: str, date: str = "2024-01-01T00:00:00Z", kind: str = "resource") -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    one = lambda s: re.sub(r"[\r\n]+", " ", s)
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:record:{one(ident)}>\r\nWARC-Target-URI: {one(uri)}\r\nWARC-Date: {date}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(Exception):
    """Why a check failed; at: where reading can go on if that is known."""

    def __init__(self, reason: str, at: int | None = None) -> None:
        super().__init__(reason)
        self.reason, self.at = reason, at


def parse(data: bytes) -> tuple[dict[str, str], int, int]:
    """Headers of a record at the start of data, where its block begins and ends. A line
    that begins with a blank goes on with the header before it."""
    if not VERSION.match(data):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        raise Bad("headers do not end")
    heads, name = {}, None
    for line in data[:stop].split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name is not None:
            heads[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header without a colon")
        name = name.strip().lower().decode("latin-1")
        heads[name] = value.strip().decode("utf-8", "replace")
    n = heads.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        raise Bad("no content length")
    if "warc-type" not in heads or "warc-record-id" not in heads:
        raise Bad("no type or id")
    return heads, stop + 4, stop + 4 + int(n)


def check(heads: dict[str, str], block: bytes, end: int) -> None:
    """The digest, in base 32 or 16, of any case; one of an unknown kind is not checked."""
    algorithm, _, want = heads.get("warc-block-digest", "").partition(":")
    kind = algorithm.strip().lower().replace("-", "")
    if kind in ("sha1", "sha256", "sha512", "md5"):
        got = hashlib.new(kind, block).digest()
        if want.strip().upper().rstrip("=") not in (base64.b32encode(got).decode().rstrip("="), got.hex().upper()):
            raise Bad("digest differs", end)


class Inflated:
    """What a member holds, read on as it is needed; going back begins anew."""

    def __init__(self, file: File, pos: int) -> None:
        self.file, self.pos = file, pos
        self.begin()

    def begin(self) -> None:
        self.stream, self.base, self.held = self.file.inflate(self.pos), 0, bytearray()

    def read_at(self, pos: int, n: int) -> bytes:
        if pos < self.base:
            self.begin()
        while self.base + len(self.held) < pos + n:
            piece, _ = next(self.stream, (b"", 0))
            if not piece:
                break
            self.held += piece
            past = min(pos - self.base, len(self.held))
            if past > CHUNK:
                del self.held[:past]
                self.base += past
        return bytes(self.held[pos - self.base : pos - self.base + n])


class File:
    """A window on a file of any size."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int, most: int = 1 << 30) -> None:
        self.read_at, self.size, self.most = read_at, size, most

    def at(self, pos: int, n: int) -> bytes:
        return self.read_at(pos, min(n, self.size - pos)) if pos < self.size else b""

    def plain(self, pos: int) -> tuple[dict[str, str], bytes, int]:
        head, n = self.at(pos, CHUNK), CHUNK
        while True:
            try:
                heads, a, b = parse(head)
                break
            except Bad as e:
                if e.reason != "headers do not end" or len(head) < n or n >= HEADERS:
                    raise
                n *= 4
                head = self.at(pos, n)
        if pos + b + 4 > self.size:
            raise Bad("file ends within the record")
        if b - a > self.most:
            raise Bad("record is larger than a row can be")
        block = head[a:b] if b <= len(head) else self.at(pos + a, b - a)
        if self.at(pos + b, 4) != b"\r\n\r\n":
            raise Bad("record does not end where its length says")
        check(heads, block, pos + b + 4)
        return heads, block, pos + b + 4

    def inflate(self, pos: int) -> Iterator[tuple[bytes, int]]:
        """Pieces of a member, of a bounded size, and where the file is read to."""
        z, at, data = zlib.decompressobj(31), pos, b""
        try:
            while not z.eof:
                if not data:
                    data = self.at(at, CHUNK)
                    at += len(data)
                    if not data:
                        raise Bad("file ends within the member")
                piece = z.decompress(data, 4 * CHUNK)
                data = z.unconsumed_tail
                yield piece, at - len(z.unused_data)
        except zlib.error as e:
            raise Bad("member is damaged: " + str(e)[:60]) from None

    def zipped(self, pos: int) -> tuple[Iterator[tuple], int, bool]:
        """What a whole member holds, as read gives it, its end, and whether it is small.
        The member is first read through for its own checksum."""
        if self.at(pos, 3) != b"\x1f\x8b\x08":
            raise Bad("no member")
        size, end, first, kept = 0, pos, b"", []
        for piece, end in self.inflate(pos):
            if len(first) < 5:
                first += piece[:5]
                if not b"WARC/".startswith(first[:5]):
                    raise Bad("member holds no record")
            size += len(piece)
            kept = [*kept, piece] if size <= 32 * CHUNK and kept is not None else None
        whole = b"".join(kept) if kept is not None else None
        inner = File((lambda p, n: whole[p : p + n]) if whole is not None else Inflated(self, pos).read_at, size, self.most)
        return inner.read(False), end, whole is not None

    def good(self, pos: int, packed: bool) -> int:
        """The end of what is whole at pos: a record, or a member that holds one."""
        if not packed:
            return self.plain(pos)[2]
        found, end, _ = self.zipped(pos)
        reason = "member holds no record"
        for kind, *_, why in found:
            if kind == "record":
                return end
            reason = why
        raise Bad(reason, end)

    def search(self, pos: int, packed: bool) -> int:
        """The next place from pos on where a whole record passes its checks, or the end."""
        while pos < self.size:
            data = self.at(pos, CHUNK + 16)
            if packed:
                i = data.find(b"\x1f\x8b\x08", 0, CHUNK + 2)
            else:
                m = VERSION.search(data)
                i = m.start() if m else -1
            if i < 0 or i >= CHUNK:
                pos += CHUNK
                continue
            try:
                self.good(pos + i, packed)
                return pos + i
            except Bad:
                pos += i + 1
        return self.size

    def read(self, packed: bool) -> Iterator[tuple]:
        """(kind, start, end, offset, headers, block, reason) of records and quarantined
        gaps, which together cover the file. What lies in one member has its start and
        end, and the offset in what the member holds."""
        pos, gap, reason = 0, None, ""
        while pos < self.size:
            try:
                if packed:
                    inside, end, small = self.zipped(pos)
                    if small:
                        inside = list(inside)
                        if all(x[0] != "record" for x in inside):
                            raise Bad(inside[0][-1] if inside else "member holds no record", end)
                    else:
                        self.good(pos, True)
                        inside = self.zipped(pos)[0]
                    found = ((kind, pos, end, start, *rest) for kind, start, _, _, *rest in inside)
                else:
                    heads, block, end = self.plain(pos)
                    found = [("record", pos, end, 0, heads, block, None)]
            except Bad as e:
                if gap is None:
                    gap, reason = pos, e.reason
                pos = self.search(e.at if e.at is not None else pos + 1, packed)
                continue
            if gap is not None:
                yield "gap", gap, pos, 0, {}, None, reason
                gap = None
            yield from found
            pos = end
        if gap is not None:
            yield "gap", gap, self.size, 0, {}, None, reason


def rows(path: str, f: File, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for kind, start, end, offset, heads, block, reason in f.read(path.endswith(".gz")):
        get = heads.get
        held.append((path, kind, start, end, offset, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-date"), block, reason))
        size += len(block or b"")
        if size >= most or len(held) >= 4096:
            yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, map(list, zip(*held)))), ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(FIELDS, map(list, zip(*held)))), ARROW)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records and quarantined gaps of WARC files, those that end in .gz in members of one
    record or more: path, kind (record or gap), start and end in the file's bytes, offset in
    what the member holds, type, record_id, uri, date, payload, and reason of a gap.

    A record passes if its version line, headers (folded ones too), length, end and, where
    given, digest hold, and its member's checksum. After a failure the reader searches for
    the next member or version line from which a whole record passes; the bytes between are
    a gap with the reason of the first failure. Records and gaps cover each file without
    overlap; within a whole member, those of it cover what it holds. A file is read by one
    task in a window, and a member in pieces: memory holds one record.

    Quarantined by size are only records of more than 1 GiB, which no row can hold, and
    headers of more than 16 MiB.

    An empty file and an empty list give no rows; a file of other data is one gap.
    Repeated paths are read again. A missing file is an error.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(list(paths))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, at = filesystem(shared.value[i])
                with fs.open_input_file(at) as f:
                    yield from rows(shared.value[i], File(lambda pos, n, f=f: f.read_at(n, pos), f.size()))

    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(read, SCHEMA)


def write_warc(df: DataFrame, folder: str | None = None, uri: str = "url", ident: str = "page_id", payload: str = "html", packed: bool = True, damage: Callable[[int, bytes], bytes] | None = None) -> list[str]:
    """Each partition of df as a WARC file in folder (default: in the shared one), and
    the paths. A file is written under a name of its attempt and then renamed, so
    a task that runs again leaves one whole file. damage, for tests, changes the bytes
    of a record given its number in the file. Null payloads are empty records."""
    folder = folder or new_path(df.sparkSession, "warc")
    ending = ".warc.gz" if packed else ".warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        name = f"{at}/part-{TaskContext.get().partitionId():06d}{ending}"
        own, number = f"{name}.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(own) as f:
            for batch in batches:
                for u, i, p in zip(*(c.to_pylist() for c in batch.columns)):
                    data = record(u or "", (p or "").encode() if not isinstance(p, bytes) else p, "" if i is None else str(i))
                    data = member(data) if packed else data
                    f.write(damage(number, data) if damage else data)
                    number += 1
        if number:
            fs.move(own, name)
            yield pa.record_batch([pa.array([folder.rstrip("/") + name[len(at) :]])], ["path"])
        else:
            fs.delete_file(own)

    done = df.select(col(uri), col(ident), col(payload)).mapInArrow(write, "path string")
    return sorted(r[0] for r in done.collect())  # a path a file


def harm(number: int, data: bytes) -> bytes:
    """Damage by the number of the record: a flipped byte, a lost tail, foreign bytes
    before it, or none."""
    if number % 50 == 7:
        at = len(data) // 2
        return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    if number % 50 == 23:
        return data[: len(data) * 2 // 3]
    if number % 50 == 41:
        return b"\x1f\x8b\x08lost bytes WARC/1.0\r\n" * 3 + data
    return data


def salvage_pages(pages: DataFrame) -> DataFrame:
    """pages written as compressed WARC files of which records are damaged (harm), and
    what read_warc recovers: page_id, url and html of records, and gaps, without paths.

    A null page_id stays null, a null url becomes an empty one, null and empty html an
    empty record; equal rows are records of their own, in no set order of files; an empty
    table gives no rows; other columns are not read."""
    got = read_warc(pages.sparkSession, write_warc(pages, damage=harm))
    return got.select(
        "kind", F.when(F.col("kind") == "record", F.expr("try_cast(regexp_extract(record_id, '^<urn:record:(-?[0-9]+)>$', 1) as bigint)")).alias("page_id"), F.col("uri").alias("url"), F.decode("payload", "UTF-8").alias("html"),
        F.element_at(F.split("path", "/"), -1).alias("file"), "start", "end", "offset", "reason",
    )
