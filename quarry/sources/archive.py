"""Archives of files as a Spark data source, ``format("quarry_archive")``.

One archive holds a header, a table of its files (name, sizes, offset, CRC-32), the model of its codec, and the payloads.
Two kinds are read and written (layouts are fixed values): raw, with files as they are, and compressed, with one or two
codecs for all files. Numbers are least significant byte first, as compilers lay the structures out in memory.

Writing: each partition becomes an archive, or several once its files have ``archiveBytes`` (default 256 MB; the format's
sizes have 32 bits), each with a model of its own files; a task writes under temporary names and the commit gives archives
their names, so that a task run again leaves no half of one. Columns: filename, content. Options: ``codec`` (default
``auto``: by entropy), ``secondary`` (default ``none``), or ``raw`` = true. A path without a scheme is one of this machine.

Reading: a partition for each archive; files are read by position, 16 MB of them (or one) at a time, and checked against their CRC.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.codecs import CODES, canonical, codec, escape_byte, model_of
from ..functions.codecs.base import SECONDARY, decode_all, encode_all, grouped

SIGNATURE, RAW_VERSION, MAJOR, MINOR = b"lolkek", 0, 2, 1
RAW = struct.Struct("<6sHQ")
HEADER = struct.Struct("<6sHH6xQBBBx14I4x")
ENTRY = struct.Struct("<256sQQQI4x")
COUNT = struct.Struct("<I")
NAME_BYTES = 255
CRC32 = 1
#: Flags of a compressed archive, by meaning (fixed values).
FLAGS = {"directory": 1, "compressed": 2, "encrypted": 4, "metadata": 8, "huffman": 16, "arithmetic": 32, "shannon": 64, "rle": 128, "lz78": 256, "lz77": 512, "two_stage": 1024}
#: Place of each codec's model size among the header's last 14 numbers.
MODEL_AT = {"huffman": 5, "arithmetic": 6, "shannon": 7}
CONTEXT_AT = {"rle": 9, "lz78": 10, "lz77": 11}
SCHEMA = "filename string, original_size long, compressed_size long, offset long, crc long, content binary"
SUFFIX = ".arc"


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def entropy(counts: np.ndarray) -> float:
    c = counts[counts > 0]
    return float(-(c / c.sum() * np.log2(c / c.sum())).sum()) if len(c) else 0.0


def choose(h: float, two_stage: bool) -> tuple[str, str]:
    """Codecs for an entropy in bits a byte (COD-19, COD-20)."""
    first = lambda steps, rest: next((name for bound, name in steps if h < bound), rest)
    if two_stage:
        return first(((4.0, "huffman"), (6.0, "arithmetic")), "shannon"), first(((3.0, "rle"), (5.0, "lz77")), "lz78")
    return first(((3.0, "rle"), (4.0, "huffman"), (5.0, "lz77"), (6.0, "arithmetic"), (7.0, "lz78"), (7.5, "shannon")), "none"), "none"


def table_of(files: list[tuple[str, bytes]], payloads: list[bytes]) -> bytes:
    out, at = [COUNT.pack(len(files))], 0
    for (name, data), payload in zip(files, payloads, strict=True):
        raw = name.encode()
        if len(raw) > NAME_BYTES:
            raise ValueError(f"the name {name[:40]!r}… is longer than {NAME_BYTES} bytes")
        out.append(ENTRY.pack(raw, len(data), len(payload), at, zlib.crc32(data)))
        at += len(payload)
    return b"".join(out)


def build_raw(files: list[tuple[str, bytes]]) -> bytes:
    contents = [d for _, d in files]
    return RAW.pack(SIGNATURE, RAW_VERSION, sum(map(len, contents))) + table_of(files, contents) + b"".join(contents)


def build(files: list[tuple[str, bytes]], primary: str = "auto", secondary: str = "none") -> bytes:
    """A compressed archive. If any file can't be encoded, all are stored as they are (COD-23)."""
    counts = np.zeros(256, np.int64)
    for _, d in files:
        counts += np.bincount(np.frombuffer(d, np.uint8), minlength=256)
    two = secondary not in ("none", "n")
    if primary == "auto":
        primary, second = choose(entropy(counts), two)
        secondary = second if secondary == "auto" else secondary
    elif secondary == "auto":
        secondary = choose(entropy(counts), True)[1]
    primary, secondary = canonical(primary), canonical(secondary)
    if secondary not in SECONDARY:
        raise ValueError(f"{secondary!r} can't be a second stage")
    model, context = b"", b""
    try:
        model = model_of(primary, counts=counts.tolist())
        made = iter(encode_all(primary, [d for _, d in files if d], [model for _, d in files if d]))
        payloads = [next(made) if d else b"" for _, d in files]
        if None in payloads:
            raise ValueError("a file can't be encoded")
    except ValueError:
        primary, model, payloads = "none", b"", [d for _, d in files]
    if secondary != "none":
        if secondary in ("rle", "lz77"):
            context = bytes((escape_byte(np.bincount(np.frombuffer(b"".join(payloads), np.uint8), minlength=256).tolist()),))
        # the size between the stages goes before each payload
        payloads = [COUNT.pack(len(p)) + codec(secondary).encode(p, context) for p in payloads]
    table = table_of(files, payloads)
    numbers = [0] * 14
    used = [n for n in (primary, secondary) if n != "none"]
    numbers[0] = FLAGS["compressed"] * bool(used) | FLAGS["two_stage"] * (secondary != "none") | sum(FLAGS[n] for n in set(used))
    numbers[1], numbers[2], numbers[3], numbers[4], numbers[8] = HEADER.size, len(table), sum(map(len, payloads)), len(model), len(context)
    if primary in MODEL_AT:
        numbers[MODEL_AT[primary]] = len(model)
    if primary in CONTEXT_AT:
        numbers[CONTEXT_AT[primary]] = len(model)
    if secondary in CONTEXT_AT and secondary != primary:
        numbers[CONTEXT_AT[secondary]] = len(context)
    payload = b"".join(payloads)
    numbers[13] = zlib.crc32(payload)
    head = lambda: HEADER.pack(SIGNATURE, MAJOR, MINOR, sum(len(d) for _, d in files), CODES[primary].number, CODES[secondary].number, CRC32, *numbers)
    numbers[12] = zlib.crc32(head())  # over the header with 0 in this place
    return head() + table + model + context + payload


@dataclass
class Entry:
    filename: str
    original_size: int
    compressed_size: int
    offset: int
    crc: int


class Archive:
    """An open archive: its file table at once, files on demand."""

    def __init__(self, stream) -> None:
        self.stream = stream
        start = stream.read(RAW.size)
        if len(start) < RAW.size or start[:6] != SIGNATURE:
            raise ValueError("this is no archive")
        names = {c.number: n for n, c in CODES.items()}
        self.primary = self.secondary = "none"
        model_size = context_size = 0
        version = struct.unpack_from("<H", start, 6)[0]
        if version == MAJOR:
            head = start + stream.read(HEADER.size - RAW.size)
            _, _, _, self.original_size, first, second, _, *numbers = HEADER.unpack(head)
            crc, numbers[12] = numbers[12], 0
            if zlib.crc32(HEADER.pack(*HEADER.unpack(head)[:7], *numbers)) != crc:
                raise ValueError("an archive's header is damaged")
            if first not in names or second not in names:
                raise ValueError("an archive names a codec that there isn't")
            self.primary, self.secondary, self.flags = names[first], names[second], numbers[0]
            model_size, context_size = numbers[4], numbers[8]
        elif version == RAW_VERSION:
            self.original_size, self.flags = RAW.unpack(start)[2], 0
        else:
            raise ValueError(f"archives of version {version} can't be read")
        (n,) = COUNT.unpack(stream.read(COUNT.size))
        self.entries = []
        for _ in range(n):
            name, size, packed, offset, crc = ENTRY.unpack(stream.read(ENTRY.size))
            self.entries.append(Entry(name.rstrip(b"\0").decode(), size, packed, offset, crc))
        self.model, self.context = stream.read(model_size), stream.read(context_size)
        self.data_at = stream.tell()

    def read(self, entry: Entry) -> bytes:
        """A file's content, from its place in the payload."""
        return self.read_all([entry])[0]

    def read_all(self, entries: list[Entry]) -> list[bytes]:
        """The contents of some files, in memory together."""
        packed = []
        for entry in entries:
            self.stream.seek(self.data_at + entry.offset)
            data = self.stream.read(entry.compressed_size)
            if self.secondary != "none":
                (between,) = COUNT.unpack(data[: COUNT.size])
                data = codec(self.secondary).decode(data[COUNT.size :], self.context, between)
            packed.append(data)
        coded = [k for k, e in enumerate(entries) if e.original_size and self.primary != "none"]
        for k, data in zip(coded, decode_all(self.primary, [packed[k] for k in coded], [self.model] * len(coded), [entries[k].original_size for k in coded]), strict=True):
            packed[k] = data
        for entry, data in zip(entries, packed, strict=True):
            if len(data) != entry.original_size or zlib.crc32(data) != entry.crc:
                raise ValueError(f"the file {entry.filename!r} of an archive is damaged")
        return packed

    def find(self, filename: str) -> bytes:
        for e in self.entries:
            if e.filename == filename:
                return self.read(e)
        raise KeyError(filename)


def opened(data: bytes) -> Archive:
    return Archive(io.BytesIO(data))


class OneArchive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[OneArchive]:
        where, at = store(self.path)
        info = where.get_file_info(at)
        if info.type == fs.FileType.File:
            return [OneArchive(self.path)]
        found = [i.path for i in where.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith(SUFFIX) and not i.base_name.startswith((".", "_"))]
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return [OneArchive(prefix + p) for p in sorted(found)]

    def read(self, partition: OneArchive) -> Iterator[tuple]:
        where, at = store(partition.path)
        with where.open_input_file(at) as stream:
            archive = Archive(stream)
            for g in grouped([e.original_size for e in archive.entries]):
                for e, data in zip(archive.entries[g], archive.read_all(archive.entries[g]), strict=True):
                    yield e.filename, e.original_size, e.compressed_size, e.offset, e.crc, data


#: Bytes of files after which a partition begins another archive.
ARCHIVE_BYTES = 256 << 20


@dataclass
class Written(WriterCommitMessage):
    temporary: list[str]
    files: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.primary, self.secondary, self.raw = options.get("codec", "auto"), options.get("secondary", "none"), options.get("raw", "false").lower() == "true"
        self.most = int(options.get("archivebytes", options.get("archiveBytes", ARCHIVE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, files, size, n = [], [], 0, 0
        for batch in iterator:
            for r in batch.to_pylist():
                data = (r["content"].encode() if isinstance(r["content"], str) else r["content"]) or b""
                if files and size + len(data) > self.most:
                    names.append(self.put(files))
                    files, size = [], 0
                files.append((r["filename"], data))
                size, n = size + len(data), n + 1
        if files:
            names.append(self.put(files))
        return Written(names, n)

    def put(self, files: list[tuple[str, bytes]]) -> str:
        data = build_raw(files) if self.raw else build(files, self.primary, self.secondary)
        where, at = store(self.path)
        where.create_dir(at, recursive=True)
        name = f"{at}/.{uuid.uuid4().hex}"
        with where.open_output_stream(name) as out:
            out.write(data)
        return name

    def commit(self, messages: list[Written]) -> None:
        where, at = store(self.path)
        where.create_dir(at, recursive=True)
        old = [i.path for i in where.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(SUFFIX)] if self.overwrite else []
        job = uuid.uuid4().hex[:8]
        for k, name in enumerate(name for m in messages if m for name in m.temporary):
            where.move(name, f"{at}/part-{k:05d}-{job}{SUFFIX}")
        for path in old:
            where.delete_file(path)

    def abort(self, messages: list[Written]) -> None:
        where, _ = store(self.path)
        for m in messages:
            for name in m.temporary if m else ():
                where.delete_file(name)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        missing = {"filename", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"an archive needs the columns filename and content, not only {schema.fieldNames()}")
        return ArchiveWriter(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
