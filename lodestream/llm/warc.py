"""WARC archives as a PySpark data source (format ``warc``), and writing pages to them with revisit records.

Reading plans one partition per stretch of a file; a manifest that the writer leaves holds record-aligned places at which
files may be entered, and files without one are read whole. Filters on record type and on header columns are pushed into
the source: headers are parsed first, and the payload of a record that is not wanted is skipped by its Content-Length and
never decoded (in a compressed file it is passed over as it is inflated, and not kept). With the option ``payload`` set to false no payload is read at all.

Writing (``write_pages``) puts a record for every page: of pages with equal payloads of at least ``min_revisit`` bytes the
one with the smallest page_id is a response, the others are revisits that name it; smaller ones are all responses.
Files get names of their own from each task attempt, and only those that a job commits are in its manifest, so a
lost executor or a second attempt leaves nothing behind that is read. Each job has a manifest of its own: readers take them all.
Large files of others can be given one (``index_archives``).

Defined cases: a null html is an empty payload; a null url is an empty target; very long payloads are one record each; rows that
repeat the page_id and payload of a response are responses too, and their records share an id, which is made of both; rows without a
page_id have none in the archive, and are responses; an empty table gives no files and an empty result; other columns, whatever
their names, are not written. Header bytes that aren't UTF-8 are taken as Latin-1; a body that isn't coded as its message says is given as
it was sent, and ``bad_coding`` is true; a number in a header that is none counts as missing.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from ._spark import new_path, spread_join

MANIFEST = "_manifest"
#: A file may be entered every so many bytes; files are closed beyond so many bytes.
STRETCH, FILE = 16 << 20, 128 << 20
_SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, page_id long, payload_digest string, payload_bytes long, refers_to long, payload binary, bad_coding boolean"
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "page_id": "WARC-Page-ID", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length", "refers_to": "WARC-Refers-To-Page-ID"}
_NUMBERS = {"page_id", "payload_bytes", "refers_to"}
_KINDS = {c: pa.int64() if c in _NUMBERS else pa.string() for c in _HEADERS} | {"payload": pa.binary(), "bad_coding": pa.bool_()}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class _Stretch(InputPartition):
    """A part of a file that begins and ends with whole records."""

    path: str
    begin: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, list[int]]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self._path = options["path"]
        self._payload = options.get("payload", "true").lower() != "false"
        self._filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self._filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, name = _store(self._path)
        if store.get_file_info(name).type == fs.FileType.File:
            return [_Stretch(self._path, 0, store.get_file_info(name).size)]
        found: list[InputPartition] = []
        infos = store.get_file_info(fs.FileSelector(name))
        manifests = sorted(x.base_name for x in infos if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))
        for manifest in manifests:
            with store.open_input_stream(f"{name}/{manifest}") as f:
                listed = json.loads(f.read())
            for file, places in listed:
                found += [_Stretch(f"{self._path}/{file}", a, b) for a, b in zip(places, places[1:]) if b > a]
        if not manifests:
            found += [_Stretch(f"{self._path}/{x.base_name}", 0, x.size) for x in infos if _archive(x.base_name)]
        return found or [_Stretch("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        for f in self._filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                ok = value is None
            elif isinstance(f, IsNotNull):
                ok = value is not None
            elif isinstance(f, EqualNullSafe):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value is not None and value in f.value
            else:
                ok = value is not None and value == f.value
            if not ok:
                return False
        return True

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, name = _store(partition.path)
        rows, size = [], 0
        with store.open_input_file(name) as raw:
            records = (_Inflated if name.endswith(".gz") else _Plain)(raw, partition)
            while (lines := records.head()) is not None:
                head = _fields(lines)
                row = {c: head.get(h.lower()) for c, h in _HEADERS.items()}
                for c in _NUMBERS:
                    row[c] = _number(row[c])
                wanted = self._wanted(row)
                block = records.body(int(head["content-length"]), wanted and self._payload and row["record_type"] != "revisit")
                if not wanted:
                    continue
                row["payload"], row["bad_coding"] = (None, False) if block is None else _payload(block, head)
                size += len(row["payload"] or b"")
                rows.append(row)
                if size > 8 << 20 or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


class _Plain:
    """Records of a stretch of a file. Headers are found in a small read-ahead; a block is fetched only if it is wanted."""

    def __init__(self, raw, stretch: _Stretch):
        self._raw, self._stretch, self._at = raw, stretch, stretch.begin
        self._base, self._ahead = stretch.begin, b""

    def head(self) -> list[str] | None:
        """The lines of the next record's header."""
        at = self._at
        if at >= self._stretch.end:
            return None
        if not self._base <= at < self._base + len(self._ahead) or (cut := self._ahead.find(b"\r\n\r\n", at - self._base)) < 0:
            step = 1 << 16
            while True:
                self._raw.seek(at)
                self._ahead, self._base = self._raw.read(step), at
                cut = self._ahead.find(b"\r\n\r\n")
                if cut >= 0 or len(self._ahead) < step:
                    break
                step *= 4
        lines = _lines(self._ahead[at - self._base : max(cut, 0)])
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"{self._stretch.path}: no record begins at {at}")
        self._at = self._base + cut + 4
        return lines

    def body(self, length: int, wanted: bool) -> bytes | None:
        """The record's block, or None if it is not wanted."""
        begin, self._at = self._at, self._at + length + 4
        if not wanted:
            return None
        if begin + length <= self._base + len(self._ahead):
            return self._ahead[begin - self._base : begin - self._base + length]
        self._raw.seek(begin)
        return self._raw.read(length)


class _Inflated:
    """Records of a stretch of a compressed file, which begins with a gzip member."""

    def __init__(self, raw, stretch: _Stretch):
        raw.seek(stretch.begin)
        self._raw, self._left, self._path = raw, stretch.end - stretch.begin, stretch.path
        self._member, self._ahead = zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        """What comes next in the inflated stream; empty at its end."""
        while True:
            if self._member.eof:
                rest, self._member = self._member.unused_data, zlib.decompressobj(31)
            else:
                rest = self._member.unconsumed_tail
                if not rest and (found := self._member.decompress(b"", 1 << 20)):
                    return found  # held back for want of room
            if not rest:
                rest = self._raw.read(min(1 << 16, self._left))
                self._left -= len(rest)
                if not rest:
                    return b""
            found = self._member.decompress(rest, 1 << 20)
            if found:
                return found

    def head(self) -> list[str] | None:
        while (cut := self._ahead.find(b"\r\n\r\n")) < 0:
            found = self._more()
            if not found:
                if self._ahead.strip():
                    raise ValueError(f"{self._path}: a record is cut short")
                return None
            self._ahead += found
        lines, self._ahead = _lines(self._ahead[:cut]), self._ahead[cut + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{self._path}: no record begins where one should")
        return lines

    def body(self, length: int, wanted: bool) -> bytes | None:
        parts, need = [], length + 4
        while True:
            part = self._ahead[:need]
            need -= len(part)
            self._ahead = self._ahead[len(part) :]
            if wanted:
                parts.append(part)
            if not need:
                return b"".join(parts)[:length] if wanted else None
            self._ahead = self._more()
            if not self._ahead:
                raise ValueError(f"{self._path}: a record is cut short")


def _archive(name: str) -> bool:
    return name.endswith((".warc", ".warc.gz"))


def _lines(head: bytes) -> list[str]:
    try:
        return head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        return head.decode("latin-1").split("\r\n")


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _number(value: str | None) -> int | None:
    try:
        found = None if value is None else int(value)
    except ValueError:
        return None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def _payload(block: bytes, head: dict[str, str]) -> tuple[bytes, bool]:
    """The payload of a block, and whether it is given as it was sent since it isn't coded as it says."""
    try:
        return _decode(block, head), False
    except (zlib.error, OSError, EOFError, ValueError):
        return block.partition(b"\r\n\r\n")[2], True


def _decode(block: bytes, head: dict[str, str]) -> bytes:
    """The payload of a record's block: an HTTP message's body, put together and inflated if need be, or the block itself."""
    if not head.get("content-type", "").startswith("application/http"):
        return block
    top, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        body = _unchunked(body)
    coding = fields.get(b"content-encoding")
    if coding in (b"gzip", b"x-gzip"):
        body = gzip.decompress(body)
    elif coding == b"deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:  # some servers leave out the wrapper
            body = zlib.decompress(body, -15)
    return body


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            break
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(parts)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in _KINDS.items()], list(_KINDS))


def _record(page_id: int | None, url: str, digest: str, length: int, refers: int | None, payload: bytes, level: int) -> bytes:
    def name(page: int | None) -> str:
        return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}|{digest}'.encode()).digest())}>"

    kind = "response" if refers is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "response":
        block = http + b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(payload, level) if level else http + b"\r\n" + payload
    else:
        block = http + b"\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {url}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    head += [] if page_id is None else [f"WARC-Page-ID: {page_id}"]
    head += [] if refers is None else [f"WARC-Refers-To: {name(refers)}", f"WARC-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self._path, self._level = options["path"], int(options.get("level", "1"))
        #: Compressed files have a gzip member for each record, and payloads as they are.
        self._gzip = options.get("gzip", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self._path)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, list[int]]] = []
        out, places, at = None, [0], 0
        try:
            for batch in iterator:
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "length", "refers_to", "payload"))
                for page_id, url, digest, length, refers, payload in zip(*columns, strict=True):
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc{'.gz' if self._gzip else ''}"
                        out, places, at = store.open_output_stream(f"{folder}/{name}", compression=None), [0], 0
                    clean = " ".join((url or "").split())
                    record = _record(page_id, clean, digest, length, refers, payload or b"", 0 if self._gzip else self._level)
                    record = gzip.compress(record, self._level) if self._gzip else record
                    out.write(record)
                    at += len(record)
                    if at - places[-1] >= STRETCH:
                        places.append(at)
                    if at >= FILE:
                        out.close()
                        files.append((name, [*places, at]))
                        out = None
            if out is not None:
                out.close()
                files.append((name, [*places, at]))
                out = None
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, folder = _store(self._path)
        store.create_dir(folder, recursive=True)
        listed = sorted(f for m in messages if m for f in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        store, folder = _store(self._path)
        for m in messages:
            for name, _ in m.files if m else []:
                store.delete_file(f"{folder}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``; options: payload (true, false), for writing level (0 to 9) and gzip (true, false)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark offer filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, level: int = 1, gzip: bool = False) -> str:
    """Write ``pages(page_id, url, html)`` as WARC files; returns the folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest"))
    # Only digests of two pages or more are joined, without payloads; the smallest page_id is found before the shuffle as far as it can be.
    many = rows.where((F.col("length") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = many.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).where("m > 1")
    refers = spread_join(many, first, ["digest"], "m").where("page_id <> first").groupBy("page_id", "digest").agg(F.max("first").alias("refers_to"))
    # Payloads are dealt out by page and digest, so equal ones are no hot key; rows that can't be revisits by where they stand.
    place = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    rows = rows.withColumns({"__page": F.coalesce("page_id", F.lit(0)), "__place": place})
    refers = refers.select(F.col("page_id").alias("__page"), F.lit(0).cast("long").alias("__place"), "digest", "refers_to")
    out = rows.join(refers, ["__page", "__place", "digest"], "left")
    out = out.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    out = out.select("page_id", "url", "digest", "length", "refers_to", "payload")
    out.write.format("warc").options(level=level, gzip=str(gzip).lower()).mode("append").save(folder)
    return folder


def index_archives(spark: SparkSession, folder: str) -> int:
    """Give the plain files of a folder that has no manifest one, so that they are read in parts; returns how many files there are.

    A task goes through a file from header to header by the records' lengths and reads no payload, so places are those where records
    begin, whatever payloads hold. Compressed files are listed whole. The driver gets a place for every ``STRETCH`` bytes.
    """
    store, name = _store(folder)
    names = sorted((x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(name)) if _archive(x.base_name))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), strict=True):
                own = [0]
                if not file.endswith(".gz"):
                    here, path = _store(f"{folder}/{file}")
                    with here.open_input_file(path) as raw:
                        records = _Plain(raw, _Stretch(path, 0, size))
                        while (lines := records.head()) is not None:
                            records.body(int(_fields(lines)["content-length"]), False)
                            if records._at - own[-1] >= STRETCH and records._at < size:
                                own.append(records._at)
                found.append([*own, size])
            yield pa.record_batch([batch.column("file"), pa.array(found, pa.list_(pa.int64()))], ["file", "places"])

    if not names:
        return 0
    files = spark.createDataFrame(names, "file string, size long").repartition(len(names))
    listed = sorted((r["file"], r["places"]) for r in files.mapInArrow(places, "file string, places array<long>").collect())
    with store.open_output_stream(f"{name}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
        out.write(json.dumps(listed).encode())
    return len(listed)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the archive's responses and revisits, in one pass.

    Responses are measured on the payloads read back; revisits have none, and their headers say what they refer to.
    """
    rows = read_warc(spark, folder).where("record_type in ('response', 'revisit')")
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    digest = F.coalesce(F.sha2("payload", 256), F.regexp_replace("payload_digest", "^sha256:", ""))
    return rows.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
