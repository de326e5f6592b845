"""WARC archives with a capture index in two levels: sorted compressed blocks, and a sparse directory of them."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm.common import bound_batches, pick, settle, shared_dir

#: Smaller payloads are stored as often as they occur.
SHARED_BYTES = 100
#: Bytes after which a task begins another archive, and captures of one block of the index.
ARCHIVE_BYTES, BLOCK_LINES = 1 << 30, 512
#: Fixed value: the profile of a revisit that repeats a stored payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"

CAPTURES = "capture string, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# --- files


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class Output:
    """A new file, made with its folder when the first bytes come; counts what it holds."""

    def __init__(self, uri: str):
        system, path = _file(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.size, self.stream = uri, 0, system.open_output_stream(path, compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        """Offset and length of the data."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.stream.close()


class Input:
    """Range reads; the file read last stays open."""

    def __init__(self):
        self.uri, self.stream = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            system, path = _file(uri)
            self.uri, self.stream = uri, system.open_input_file(path)
        data = self.stream.read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{uri} ends before {offset + length}")
        return data


def _quoted(url: str | None) -> str:
    """The URL without characters that would end a header or a line of the index."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, path and query, then the page: the order of the index. The fragment and the port do not count.

    A text that is no URL stands under an empty host. A NULL URL is as an empty one; a NULL page_id comes first.
    """
    text = _quoted(url)
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(?::\d+)?([^#]*)", text)
    host, rest = found.groups() if found else ("", text.partition("#")[0])
    reversed_host = ",".join(reversed(host.lower().split(".")))
    page = "" if page_id is None else format(page_id + (1 << 63), "020d")
    return f"{reversed_host}){rest or '/'} {page}"


# --- records


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(headers: dict[str, str | int | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in {**headers, "Content-Length": len(block)}.items() if v is not None]
    return _member("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n")


def _shared_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}>"


def page_record(row: dict, own_id: str) -> bytes:
    """A response with its payload, or a revisit that names the response and holds the HTTP headers alone."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    shared = not revisit and row["payload_bytes"] >= SHARED_BYTES
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _shared_id(row["page_id"], row["payload_digest"]) if shared else own_id,
        "WARC-Date": CAPTURED,
        "WARC-Target-URI": _quoted(row["url"]) or "urn:x-url:none",
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-Id": row["page_id"],
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": _shared_id(row["refers_to"], row["payload_digest"]) if revisit else None,
    }
    return _record(headers, http if revisit else http + (row["html"] or "").encode())


def parse_record(data: bytes) -> dict:
    """The record of one gzip member; a damaged one raises."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].partition(":")[2]
    size, refers, page = len(payload), None, headers.get("X-Page-Id")
    if kind == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        refers = re.fullmatch(r"<urn:x-page:(.*):[0-9a-f]+>", headers["WARC-Refers-To"])[1]
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    url = headers["WARC-Target-URI"]
    return {
        "page_id": None if page is None else int(page), "url": None if url == "urn:x-url:none" else url,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": None if refers in (None, "none") else int(refers), "payload": None if kind == "revisit" else payload,
    }


# --- archives


def typed_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to: html is NULL in revisits.

    Digests that occur twice are found on rows without payloads, summed up before each shuffle. Only
    if there are any do payloads meet them, in a join that may split a digest.
    """
    base = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.coalesce("html", F.lit(""))
    rows = base.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    equal = rows.where(F.col("payload_bytes") >= SHARED_BYTES).groupBy("payload_digest", "page_id", "url").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url", "n")
    firsts = equal.groupBy("payload_digest").agg(F.min(order).alias("first"), F.sum("n").alias("all"))
    shared = settle(firsts.where("all > 1").select("payload_digest", "first"), "payloads")
    none = F.lit(None).cast("long").alias("refers_to")
    out = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    if shared.isEmpty():
        return rows.select(*out, F.lit("response").alias("record_type"), none)
    met = rows.join(shared, "payload_digest", "left")
    is_first = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    chosen = F.col("first").isNull() | is_first
    single = met.where(~F.coalesce(is_first & (F.col("first.n") > 1), F.lit(False))).select(
        "page_id", "url", F.when(chosen, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(chosen, "response").otherwise("revisit").alias("record_type"), F.when(~chosen, F.col("first.page_id")).alias("refers_to"),
    )
    repeated = shared.where("first.n > 1")
    if repeated.isEmpty():
        return single
    # Equal rows that stand first: one of them is the response, the others revisit it.
    one = rows.join(repeated, "payload_digest").where(is_first).groupBy("payload_digest", "payload_bytes", "page_id", "url").agg(F.first("html").alias("html"), F.count("*").cast("long").alias("n"))
    copies = one.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    again = F.col("copy") > 1
    return single.unionByName(
        copies.select(
            "page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
            F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("page_id")).alias("refers_to"),
        )
    )


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


_CAPTURES = pa.schema([("capture", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(records: DataFrame, root: str) -> DataFrame:
    """Every record as a gzip member of an archive under `root`; capture, file, offset and length of each.

    A task writes files of its own name, and only what a finished attempt wrote is in the result, so
    a repeated task leaves at most a file that nothing names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            out = None
            for n, row in enumerate(_rows(batches)):
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out = Output(f"{root}/archives/{name}.warc.gz")
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:x-archive:{name}>", "WARC-Date": CAPTURED, "Content-Type": "application/warc-fields"}
                    out.add(_record(info, b"format: WARC File Format 1.1\r\n"))
                at, length = out.add(page_record(row, f"<urn:x-record:{name}:{n}>"))
                yield capture_key(row["url"], row["page_id"]), out.uri, at, length
            if out is not None:
                out.close()

        yield from _batches(entries(), _CAPTURES)

    bound_batches(records.sparkSession)
    return settle(records.mapInArrow(run, CAPTURES), "captures")


# --- index


@dataclass(frozen=True)
class Part:
    """One sorted file of the index: blocks, then its directory of the blocks' first captures."""

    first: str
    last: str
    file: str
    offset: int
    length: int


@dataclass(frozen=True)
class CaptureIndex:
    """The parts in order; there are as many as shuffle partitions, whatever the number of captures."""

    spark: SparkSession
    parts: tuple[Part, ...]


def _ways(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def build_index(captures: DataFrame, root: str) -> CaptureIndex:
    """Sorts the captures over ranges; each range becomes a file of compressed blocks with a sparse directory."""
    spark = captures.sparkSession
    keys = ["capture", "file", "offset"]
    placed = captures.repartitionByRange(_ways(spark), *keys).sortWithinPartitions(*keys)
    schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines, first, last = None, [], [], None, None

        def flush() -> None:
            data = zlib.compress("\n".join(lines).encode(), 6)
            directory.append([lines[0].partition("\t")[0], *out.add(data)])
            lines.clear()

        for row in _rows(batches):
            if out is None:
                out, first = Output(f"{root}/index/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"), row["capture"]
            last = row["capture"]
            lines.append(f"{last}\t{row['file']}\t{row['offset']}\t{row['length']}")
            if len(lines) == BLOCK_LINES:
                flush()
        if out is not None:
            if lines:
                flush()
            at, length = out.add(zlib.compress(json.dumps(directory).encode(), 6))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "file": out.uri, "offset": at, "length": length}], schema)

    found = settle(placed.mapInArrow(run, "first string, last string, file string, offset long, length long"), "parts")
    return CaptureIndex(spark, tuple(Part(*r) for r in sorted(found.collect())))  # one row per shuffle partition


class PartReader:
    """Binary search in one part at a time; keeps its directory and the block read last."""

    def __init__(self, parts: tuple[Part, ...]):
        self.parts, self.input = parts, Input()
        self.part = self.block = -1
        self.reads = 0

    def _open(self, part: int) -> None:
        if part != self.part:
            p = self.parts[part]
            directory = json.loads(zlib.decompress(self.input.read(p.file, p.offset, p.length)))
            self.part, self.block, self.directory = part, -1, directory
            self.firsts = [entry[0] for entry in directory]

    def _lines(self, block: int) -> list[str]:
        if block != self.block:
            _, at, length = self.directory[block]
            self.lines = zlib.decompress(self.input.read(self.parts[self.part].file, at, length)).decode().split("\n")
            self.block, self.reads = block, self.reads + 1
        return self.lines

    def find(self, part: int, capture: str) -> Iterator[tuple[str, str, int, int]]:
        self._open(part)
        # The last block that begins before the capture may hold it, and all that begin with it do.
        block = max(0, bisect_left(self.firsts, capture) - 1)
        while block < len(self.firsts) and self.firsts[block] <= capture:
            lines = self._lines(block)
            for i in range(bisect_left(lines, f"{capture}\t"), len(lines)):
                found, file, at, length = lines[i].split("\t")
                if found != capture:
                    break
                yield capture, file, int(at), int(length)
            block += 1


def look_up(wanted: DataFrame, index: CaptureIndex) -> DataFrame:
    """The captures of every distinct (url, page_id) that is wanted.

    A capture is sent to the parts whose range holds it; a capture that fills several parts, to all of
    them. Tasks take ranges of (part, capture), so blocks are read in order, each once or so.
    """
    parts, ways = index.parts, _ways(index.spark)
    lasts = [p.last for p in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def routed() -> Iterator[tuple[int, str]]:
            for row in _rows(batches):
                capture = capture_key(row["url"], row["page_id"])
                part = bisect_left(lasts, capture)
                while part < len(parts) and parts[part].first <= capture:
                    yield part, capture
                    part += 1

        yield from _batches(routed(), pa.schema([("part", pa.int32()), ("capture", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PartReader(parts)
        yield from _batches((hit for row in _rows(batches) for hit in reader.find(row["part"], row["capture"])), _CAPTURES)

    asked = pick(wanted, "url", "page_id").withColumn("page_id", F.col("page_id").cast("long"))
    routed = asked.mapInArrow(route, "part int, capture string").distinct()
    placed = routed.repartitionByRange(ways, "part", "capture").sortWithinPartitions("part", "capture")
    return placed.mapInArrow(search, CAPTURES)


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the captures, by range reads in the order of the files."""
    keys = ["file", "offset"]
    placed = captures.repartitionByRange(_ways(captures.sparkSession), *keys).sortWithinPartitions(*keys)
    names = [f.split()[0] for f in RECORDS.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Input()

        def records() -> Iterator[tuple]:
            for row in _rows(batches):
                found = parse_record(source.read(row["file"], row["offset"], row["length"]))
                yield tuple(found[c] if payloads or c != "payload" else None for c in names)

        yield from _batches(records(), schema, 64 if payloads else 1024)

    return placed.mapInArrow(run, RECORDS)


def archive(pages: DataFrame, root: str | None = None) -> CaptureIndex:
    """Archives and index of a table with page_id, url and html under `root`, by default in the shared folder.

    Other columns are ignored. A NULL html is an empty payload. Of the rows with one payload of 100 bytes
    or more, the one with the smallest page_id is the response (NULL last, then by url), the others
    revisit it; smaller payloads are all responses. Of equal rows one is the response. An empty table
    makes no archive and an index without parts.
    """
    root = root or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return build_index(write_archives(typed_records(pages), root), root)


def archived_pages(pages: DataFrame, root: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives of the pages.

    Every page is looked up by its url and page_id in the index, and its records are read and checked
    against their digests; one row per row of the table. See `archive` for the cases.
    """
    captures = settle(look_up(pages, archive(pages, root)), "found")  # dealt out by ranges, for which Spark reads them twice
    found = read_records(captures, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
