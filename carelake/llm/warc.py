"""WARC archives as a PySpark Python data source, read and written (format name ``warc_pages``).

Archives are WARC 1.1 with one gzip member per record. Each member carries its own length in the gzip header (the ``sl``
extra field), so a reader inflates a record's headers alone and steps over the rest without decoding it. Every commit writes a
manifest of its files with split points and the record types between them; files of lost or repeated tasks are in none. An
append adds a manifest; an overwrite adds one that names the manifests it replaces.

The reader plans splits from all manifests, takes predicates on record_type, page_id, target_uri and payload_digest, leaves
out splits without the wanted types, parses headers first and inflates a payload only where the headers pass (and never
with ``option("payload", "false")``).

A path without a manifest is read as ordinary archives: a .warc or .warc.gz file, or all those in a folder, each a split that is
read in order, whether a gzip member holds a record or all of them. Records of every type are rows; page_id and refers_to are only
known of our own records. The payload of a response is its body as it was sent, that of a resource or conversion its block.
A file that ends inside a record, or holds anything else, is an error that names it.

Defined results: a null html is an empty payload; a null url or page_id has no header; control characters in a url are
percent-encoded; rows that repeat the smallest page_id of a payload are all responses, and so are rows without an id if no
row of the payload has one; an empty table gives a manifest without files.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

MIN_REVISIT = 100
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
COLUMNS = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: What a writer takes: record_type, page_id, target_uri, payload_digest, payload_bytes, refers_to, and the payload of responses.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _uri(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def pack_record(r: dict) -> bytes:
    """One record as a gzip member that knows its length."""
    payload = r["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr((r['page_id'], r['target_uri'], r['payload_digest'])))}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if r["page_id"] is not None:
        lines.append(f"Page-Id: {r['page_id']}")
    if r["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(r['target_uri'])}")
    lines += [f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"Payload-Length: {r['payload_bytes']}"]
    if r["record_type"] == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"Refers-To-Page-Id: {r['refers_to']}"]
    block = http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    head = struct.pack("<2sBBIBBH2sHII", b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, len(body), len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


HEAD = struct.calcsize("<2sBBIBBH2sHII")


def member_length(head: bytes) -> int:
    magic, _, flags, *_, name, _, body, _ = struct.unpack("<2sBBIBBH2sHII", head)
    if magic != b"\x1f\x8b" or flags != 4 or name != b"sl":
        raise ValueError("not a record of an indexed archive")
    return HEAD + body + 8


def parse_headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    #: (start, end, record types) of each split
    splits: list = field(default_factory=list)


def _manifests(fs: pafs.FileSystem, root: str) -> list | None:
    """(file, splits) of all manifests that no other one replaces; None if there is no manifest."""
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return None
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name.startswith("manifest-") and info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    if not found:
        return None
    gone = {name for m in found.values() for name in m["replaces"]}
    return [tuple(x) for name in sorted(found) if name not in gone for x in found[name]["files"]]


def _archives(fs: pafs.FileSystem, root: str) -> list[str]:
    """What to append to the path for each ordinary archive."""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [""]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File)
    return [n.removeprefix(root) for n in names if n.endswith((".warc", ".warc.gz"))]


def _take(f: io.BufferedReader, n: int, path: str) -> bytes:
    got = f.read(n)
    if len(got) < n:
        raise ValueError(f"{path} ends inside a record")
    return got


def _skip(f: io.BufferedReader, n: int, path: str) -> None:
    while n:
        n -= len(_take(f, min(n, READ_BYTES), path))


def _next_headers(f: io.BufferedReader, path: str) -> dict[str, str] | None:
    """Lower-case names and values of the next record's headers; None at the end. A continued line belongs to the one before."""
    line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{path} holds something that is no record")
    out: dict[str, str] = {}
    name = ""
    while (line := f.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{path} ends inside a record")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            out[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    if "content-length" not in out or "warc-type" not in out:
        raise ValueError(f"{path} holds a record without a length or a type")
    return out


def _http_head(f: io.BufferedReader, length: int) -> bytes:
    """The status line and headers of an HTTP block, at most the block."""
    out = b""
    while len(out) < length and not out.endswith((b"\r\n\r\n", b"\n\n")):
        line = f.readline(length - len(out))
        if not line:
            break
        out += line
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"].rstrip("/"), str(options.get("payload", "true")).lower() == "true"
        self.equal: dict[str, set] = {}
        self.starts: list[str] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in ("record_type", "page_id", "target_uri", "payload_digest") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, values) & values
            elif name == "target_uri" and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            else:
                yield f

    def partitions(self):
        fs, root = _open(self.path)
        wanted, out = self.equal.get("record_type"), []
        manifests = _manifests(fs, root)
        if manifests is None:
            return [Split(f"{self.path}{name}", 0, -1) for name in _archives(fs, root)] or [Split("", 0, 0)]
        for name, splits in manifests:
            out += [Split(f"{self.path}/{name}", a, b) for a, b, types in splits if wanted is None or wanted & set(types)]
        return out or [Split("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        return all(row[k] in v for k, v in self.equal.items()) and all((row["target_uri"] or "").startswith(s) for s in self.starts)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        types = {"record_type": pa.string(), "page_id": pa.int64(), "target_uri": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], names=list(types))

        for row in self._rows(partition):
            rows.append(row)
            size += len(row["payload"] or b"") + 200
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        yield batch()

    def _plain_rows(self, path: str) -> Iterator[dict]:
        fs, name = _open(path)
        with fs.open_input_stream(name, compression=None) as f:
            records = io.BufferedReader(gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f, READ_BYTES)
            while (h := _next_headers(records, path)) is not None:
                length, kind = int(h["content-length"]), h["warc-type"]
                row = {
                    "record_type": kind, "page_id": int(h["page-id"]) if "page-id" in h else None, "target_uri": h.get("warc-target-uri", "").strip("<>") or None,
                    "payload_digest": h.get("warc-payload-digest", h.get("warc-block-digest", "")).removeprefix("sha256:") or None, "payload_bytes": None,
                    "refers_to": int(h["refers-to-page-id"]) if "refers-to-page-id" in h else None, "payload": None,
                }
                http = "application/http" in h.get("content-type", "")
                if not self._wanted(row):
                    _skip(records, length, path)
                else:
                    head = _http_head(records, length) if http else b""
                    row["payload_bytes"] = int(h["payload-length"]) if "payload-length" in h else length - len(head)
                    if self.payload and kind in ("response", "resource", "conversion"):
                        row["payload"] = _take(records, length - len(head), path)
                    else:
                        _skip(records, length - len(head), path)
                    yield row
                _skip(records, 4, path)

    def _rows(self, part: Split) -> Iterator[dict]:
        if not part.path:
            return
        if part.end < 0:
            yield from self._plain_rows(part.path)
            return
        fs, name = _open(part.path)
        with fs.open_input_file(name) as f:
            at, held, base = part.start, b"", part.start
            while at < part.end:
                if at + HEAD > base + len(held):
                    base, held = at, f.read_at(READ_BYTES, at)
                n = member_length(held[at - base : at - base + HEAD])
                if at + n > base + len(held):
                    base, held = at, f.read_at(max(n, READ_BYTES), at)
                body = memoryview(held)[at - base + HEAD : at - base + n - 8]
                inflate, raw, rest = zlib.decompressobj(-15), b"", body
                while b"\r\n\r\n" not in raw:  # the headers alone
                    raw += inflate.decompress(rest, 2048)
                    rest = inflate.unconsumed_tail
                h = parse_headers(raw[: raw.index(b"\r\n\r\n")])
                row = {
                    "record_type": h["WARC-Type"], "page_id": int(h["Page-Id"]) if "Page-Id" in h else None, "target_uri": h.get("WARC-Target-URI"),
                    "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(h["Payload-Length"]),
                    "refers_to": int(h["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in h else None, "payload": None,
                }
                if self._wanted(row):
                    if self.payload and row["record_type"] == "response":
                        raw += inflate.decompress(rest)
                        block = raw[raw.index(b"\r\n\r\n") + 4 :][: int(h["Content-Length"])]
                        row["payload"] = block[block.index(b"\r\n\r\n") + 4 :]
                    yield row
                at += n


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        name, out, splits, at, start, types = f"part-{uuid.uuid4().hex}.warc.gz", None, [], 0, 0, set()
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                record = pack_record(row)
                out.write(record)
                at += len(record)
                types.add(row["record_type"])
                if at - start >= SPLIT_BYTES:
                    splits.append((start, at, sorted(types)))
                    start, types = at, set()
        if out is None:
            return Written(None)
        out.close()
        if at > start:
            splits.append((start, at, sorted(types)))
        return Written(name, splits)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        there = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith("manifest-")]
        manifest = {"replaces": there if self.overwrite else [], "files": [(m.path, m.splits) for m in messages if m is not None and m.path]}
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(manifest).encode())

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(f"{root}/{m.path}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_pages"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The records of the pages: of equal payloads of at least ``min_revisit`` bytes the smallest page_id is the response."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), raw.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("payload_bytes") >= min_revisit).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(shared.where("n > 1 and first is not null"), F.col("payload_digest") == F.col("d"), "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri", "payload_digest", "payload_bytes",
        F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Write the pages; ``append`` adds to an archive, ``overwrite`` replaces what it holds."""
    _register(pages.sparkSession)
    to_records(pages).write.format("warc_pages").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    _register(spark)
    return spark.read.format("warc_pages").option("payload", str(payload).lower()).load(path)


def warc_report(spark: SparkSession, path: str) -> DataFrame:
    """What an archive holds, from its payloads where a record has one and from its headers where it revisits another."""
    response = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        "page_id", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
