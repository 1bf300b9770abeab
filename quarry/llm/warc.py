"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response becomes a ``metadata`` record (application/warc-fields: status, source HTTP headers, digests, title, links)
and, unless its content type says that it is no text, a ``conversion`` record (text/plain). Both keep what links them to
their source: WARC-Refers-To with its identifier, its target URI and date, and the payload digest of the source. Transfer
and content encodings are undone first (an encoding that is unknown or broken leaves the body as it is); links are resolved
against the page's address. Identifiers are name-based UUIDs, so that reruns agree.

Records that are no responses are passed over. A null block is empty; a response without a header end is all body; a null
URI or date is left out of the headers; control characters in header lines become blanks; pages of any length are taken
whole; repeated rows give repeated records; extra columns are ignored. An empty table gives an empty result. Rows are
independent and nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import itertools
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts

RECORD = "record_id string, type string, uri string, date string, headers array<struct<name: string, value: string>>, block binary"
PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
FIELDS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("headers", PAIRS), ("block", pa.binary())])
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, a fixed value of RFC 4122
UNSEEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template|svg|head)\b[^>]*>.*?</\1\s*>", re.S | re.I)
BREAKS = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|blockquote|pre)|br)\b[^>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
CONTROL = re.compile(r"[\x00-\x1f\x7f]+")
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)
BASE = re.compile(r"""<base\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(kind: str, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{of}')}>"


def plain_text(page: str) -> str:
    """What a reader sees of a page: a line for each block, without scripts, styles and comments."""
    text = html.unescape(TAG.sub("", BREAKS.sub("\n", UNSEEN.sub(" ", page))))
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def opened(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, HTTP headers and payload (without transfer encoding) of a response block."""
    head, end, body = block.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    if header(headers, "transfer-encoding").lower().endswith("chunked"):
        body = unchunked(body)
    return first, headers, body


def header(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = re.match(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(;|$)", body[at:line]) if line >= 0 else None
        if not size:
            return body  # not chunked, or cut off
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The payload without content encodings."""
    for coding in reversed([x.strip().lower() for x in header(headers, "content-encoding").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
            elif coding not in ("", "identity"):
                break
        except (OSError, EOFError, zlib.error):
            break
    return body


def is_text(headers: list[tuple[str, str]]) -> bool:
    kind = header(headers, "content-type").partition(";")[0].strip().lower()
    return not kind or kind.startswith("text/") or kind.endswith(("xml", "json", "javascript"))


def charset(headers: list[tuple[str, str]]) -> str:
    if m := re.search(r"charset=[\"']?([\w.:-]+)", header(headers, "content-type"), re.I):
        try:
            "".encode(m[1])
            return m[1]
        except LookupError:
            pass
    return "utf-8"


def one_line(x: str) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]+", " ", x).strip()


def outlinks(page: str, address: str | None) -> list[str]:
    """The targets of a page's links, resolved against its address or the base that it names."""
    base = address or ""
    if m := BASE.search(page):
        base = joined(base, html.unescape(next(x for x in m.groups() if x is not None)))
    return [joined(base, html.unescape(next(x for x in m if x))) for m in HREF.findall(page) if any(m)]


def joined(base: str, link: str) -> str:
    try:
        return urllib.parse.urljoin(base, one_line(link))
    except ValueError:  # no address at all
        return one_line(link)


def derived(source: dict) -> list[dict]:
    """The records of a response."""
    block, own = source["block"] or b"", {h["name"].lower(): h["value"] for h in source["headers"] or () if h and h["name"]}
    status, http, body = opened(block)
    page = decoded(http, body).decode(charset(http), "replace") if is_text(http) else ""
    payload = own.get("warc-payload-digest") or digest(body)
    title = TITLE.search(page)
    fields = [("source-status", status), *((f"source-header-{k}", v) for k, v in http), ("source-block-digest", own.get("warc-block-digest") or digest(block)), ("source-payload-digest", payload)]
    fields += [("title", one_line(html.unescape(title[1])))] if title else []
    fields += [("outlink", x) for x in outlinks(page, source["uri"])]
    metadata = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode()
    made = [("metadata", metadata, "application/warc-fields")]
    if is_text(http):
        made.append(("conversion", plain_text(page).encode(), "text/plain; charset=utf-8"))
    out = []
    for kind, data, content in made:
        link = [("WARC-Refers-To", source["record_id"]), ("WARC-Refers-To-Target-URI", source["uri"]), ("WARC-Refers-To-Date", source["date"])]
        rest = [("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", payload)]
        headers = [{"name": k, "value": v} for k, v in (*link, *rest) if v is not None]
        out.append({"record_id": named(kind, source["record_id"] or ""), "type": kind, "uri": source["uri"], "date": source["date"], "headers": headers, "block": data})
    return out


def derive(records: DataFrame) -> DataFrame:
    """Derived records, in the columns of RECORD, of the responses among ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_pylist([x for r in batch.to_pylist() for x in derived(r)], FIELDS)

    return records.filter("type = 'response'").select(*FIELDS.names).mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """WARC responses of a table of pages (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for r in batch.to_pylist():
                body = (r["html"] or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                headers = [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))]
                rows.append({"page_id": r["page_id"], "record_id": named("response", f"{r['page_id']} {r['url']}"), "type": "response", "uri": r["url"], "date": date, "headers": [{"name": k, "value": v} for k, v in headers], "block": block})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", batch.schema.field("page_id").type), *FIELDS]))

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, {RECORD}")


def serialised(record: dict) -> bytes:
    """A record in WARC/1.1, as a gzip member of its own."""
    block = record["block"] or b""
    fields = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Target-URI", record["uri"]), ("WARC-Date", record["date"])]
    fields += [(re.sub(r"[^!#-'*+.0-9A-Z^-z|~-]", "-", h["name"]), h["value"]) for h in record["headers"] or () if h and h["name"]]
    lines = ["WARC/1.1", *(f"{k}: {CONTROL.sub(' ', v)}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def parsed(stream) -> Iterator[dict]:
    """Records of an open, decompressed WARC stream, one at a time."""
    own = {"warc-type": "type", "warc-record-id": "record_id", "warc-target-uri": "uri", "warc-date": "date"}
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        record = {"record_id": None, "type": None, "uri": None, "date": None, "headers": []}
        length = 0
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip(), value.strip()
            if name.lower() == "content-length":
                length = int(value)
            elif name.lower() in own:
                record[own[name.lower()]] = value
            else:
                record["headers"].append({"name": name, "value": value})
        record["block"] = stream.read(length)
        if len(record["block"]) < length:
            raise ValueError("a WARC record is cut off")
        yield record


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes a .warc.gz file for each partition to a folder that all executors share; file and number of records of each.

    A folder without a scheme is one of Spark's default file system. A file gets its name when it is complete, so that a
    task that is run again leaves no half of one.
    """
    sc = records.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, at = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if re.match("file:/[^/]", folder) else folder)
        store.create_dir(at)
        name, n = f"{at}/part-{context.partitionId():06d}.warc.gz", 0
        with store.open_output_stream(f"{name}.{context.taskAttemptId()}", compression=None) as out:
            for batch in parts(batches):
                for r in batch.to_pylist():
                    out.write(serialised(r))
                    n += 1
        store.move(f"{name}.{context.taskAttemptId()}", name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    return records.select(*FIELDS.names).mapInArrow(run, "file string, records long")


class Lines:
    """A stream to read from, of the lines of one file as they come."""

    def __init__(self, lines: Iterator[bytes]) -> None:
        self.lines, self.held = lines, b""

    def readline(self) -> bytes:
        line, self.held = self.held or next(self.lines, b""), b""
        return line

    def read(self, n: int) -> bytes:
        out, size = [], 0
        while size < n and (line := self.readline()):
            out.append(line[: n - size])
            size += len(out[-1])
            self.held = line[len(out[-1]) :]
        return b"".join(out)


def in_batches(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r["block"])
        if size > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, FIELDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, FIELDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, .gz or plain ones (.warc), in the columns of RECORD. A file is read by one task.

    Compressed files, the usual form, stream through Spark's reader by lines, which are put together again; plain ones,
    which that reader would split, are read whole.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, x) for batch in batches for f, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, own in itertools.groupby(rows, lambda r: r[0]):
            yield from in_batches(parsed(Lines(x + b"\n" for _, x in own)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                yield from in_batches(parsed(io.BytesIO(data.as_py())))

    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path)
    zipped = lines.select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(streamed, RECORD)
    return zipped.union(plain.select("content").mapInArrow(whole, RECORD))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(responses(documents(spark, sf_dir, "pages")).drop("page_id"))
    header = lambda name: F.expr(f"filter(headers, h -> h.name = '{name}')[0].value")
    return records.select(
        "record_id", "type", "uri", "date", header("WARC-Refers-To").alias("refers_to"), header("WARC-Block-Digest").alias("block_digest"),
        header("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.octet_length("block").cast("long").alias("length"), F.sha2("block", 256).alias("block_sha256"),
    )
