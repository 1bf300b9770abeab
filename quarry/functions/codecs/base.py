"""One face for all codecs, two-stage compression, and Arrow functions over binary columns.

Files are compressed each on its own, as the formats are sequential; parallelism is across rows. A model may be a file's
own or that of all files (from their byte histogram). A codec that can't encode its input leaves it as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import arithmetic, lz, prefix, runs


@dataclass(frozen=True)
class Codec:
    """model(counts) gives the bytes that encode(data, model) and decode(data, model, size) need."""

    name: str
    number: int
    model: Callable[[list[int]], bytes]
    encode: Callable[[bytes, bytes], bytes]
    decode: Callable[[bytes, bytes, int], bytes]
    #: The same for many files at once, where that is faster.
    encode_many: Callable[[list[bytes], list[bytes]], list[bytes]] | None = None
    decode_many: Callable[[list[bytes], list[bytes], list[int]], list[bytes]] | None = None


def escape_byte(counts: list[int]) -> int:
    """The byte of 1 to 255 that occurs least, the lowest of several."""
    return min(range(1, 256), key=lambda b: (counts[b], b))


def _none(_: list[int]) -> bytes:
    return b""


def _escape(counts: list[int]) -> bytes:
    return bytes((escape_byte(counts),))


def _huffman(counts: list[int]) -> bytes:
    return prefix.write_tree(prefix.huffman_tree(counts))


def _arithmetic_models(models: list[bytes]) -> list[list[int]]:
    """The counts of each model, one list for equal ones."""
    read = {m: arithmetic.read_model(m) for m in set(models)}
    return [read[m] for m in models]


#: By name; the numbers are those that archives name codecs by (fixed values).
CODES = {
    c.name: c
    for c in (
        Codec("none", 0, _none, lambda d, m: d, lambda d, m, n: d),
        Codec("huffman", 1, _huffman, lambda d, m: prefix.encode(d, prefix.codes_of(prefix.read_tree(m))), lambda d, m, n: prefix.decode(d, prefix.codes_of(prefix.read_tree(m)), n)),
        Codec(
            "arithmetic", 2, lambda c: arithmetic.write_model(arithmetic.model(c)), lambda d, m: arithmetic.encode(d, arithmetic.read_model(m)), lambda d, m, n: arithmetic.decode(d, arithmetic.read_model(m), n),
            lambda d, m: arithmetic.encode_many(d, _arithmetic_models(m)), lambda d, m, n: arithmetic.decode_many(d, _arithmetic_models(m), n),
        ),
        Codec("shannon", 3, lambda c: prefix.write_codes(prefix.shannon_codes(c)), lambda d, m: prefix.encode(d, prefix.read_codes(m)), lambda d, m, n: prefix.decode(d, prefix.read_codes(m), n)),
        Codec("rle", 4, _escape, lambda d, m: runs.encode(d, m[0]), lambda d, m, n: runs.decode(d, m[0])),
        Codec("lz78", 5, _none, lambda d, m: lz.encode78(d), lambda d, m, n: lz.decode78(d, n)),
        Codec("lz77", 6, _escape, lambda d, m: lz.encode77(d, m[0]), lambda d, m, n: lz.decode77(d, m[0])),
    )
}
#: Other names by which a codec may be asked for (fixed values).
ALIASES = {"huff": "huffman", "h": "huffman", "arith": "arithmetic", "a": "arithmetic", "shan": "shannon", "s": "shannon", "r": "rle", "n": "none"}
#: Codecs that may follow another.
SECONDARY = ("none", "rle", "lz77", "lz78")


def canonical(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in CODES:
        raise ValueError(f"no codec is named {name!r}")
    return name


def codec(name: str) -> Codec:
    return CODES[canonical(name)]


def model_of(name: str, data: bytes | None = None, counts: list[int] | None = None) -> bytes:
    """Model for a codec from data, or from counts of all files."""
    if counts is None:
        counts = np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256).tolist()
    return codec(name).model(counts) if any(counts) or name not in ("huffman", "shannon") else b""


#: Bytes of files that are coded together; a larger file is coded alone. Number of files whose models are at hand together.
AT_ONCE, MODELS = 16 << 20, 2048


def grouped(sizes: list[int], most: int = AT_ONCE) -> Iterator[slice]:
    """Stretches of files that have ``most`` bytes together, or one file."""
    begin = held = 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


#: Bytes of rows that are coded and decoded in one go: a go takes as many steps as its largest file has bytes.
ROUND_TRIP = 2 * AT_ONCE


def alike(sizes: list[int]) -> Iterator[list[int]]:
    """Places of files of similar sizes, AT_ONCE bytes and MODELS files at most: the largest take as many steps as the largest of all."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for g in grouped([sizes[i] for i in order]):
        for k in range(g.start, g.stop, MODELS):
            yield order[k : min(k + MODELS, g.stop)]


def encode_all(name: str, files: list[bytes], models: list[bytes]) -> list[bytes | None]:
    """Each file encoded with its model; None for one that can't be."""
    of = codec(name)
    if of.encode_many:
        made = {}
        for some in alike([len(d) for d in files]):
            made |= zip(some, of.encode_many([files[i] for i in some], [models[i] for i in some]), strict=True)
        return [made[i] for i in range(len(files))]
    out: list[bytes | None] = []
    for data, model in zip(files, models, strict=True):
        try:
            out.append(of.encode(data, model))
        except ValueError:
            out.append(None)
    return out


def decode_all(name: str, files: list[bytes], models: list[bytes], sizes: list[int]) -> list[bytes]:
    of = codec(name)
    if of.decode_many:
        made = {}
        for some in alike(sizes):
            made |= zip(some, of.decode_many([files[i] for i in some], [models[i] for i in some], [sizes[i] for i in some]), strict=True)
        return [made[i] for i in range(len(files))]
    return [of.decode(*x) for x in zip(files, models, sizes, strict=True)]


Stages = list[tuple[str, bytes, int]]


def compress_all(files: list[bytes], primaries: list[str], secondaries: list[str], model: bytes | None = None) -> list[tuple[bytes, Stages]]:
    """``compress`` of many files, each by its own codecs."""
    first, second = [canonical(n) for n in primaries], [canonical(n) for n in secondaries]
    if wrong := set(second) - set(SECONDARY):
        raise ValueError(f"{min(wrong)!r} can't be a second stage")
    data, stages = list(files), [[] for _ in files]
    for k, names in enumerate((first, second)):
        for name in sorted(set(names) - {"none"}):
            at = [i for i, n in enumerate(names) if n == name and data[i]]
            models, coded = [], []
            for i in at:
                try:
                    models.append(model if k == 0 and model is not None else model_of(name, data[i]))
                    coded.append(i)
                except ValueError:
                    continue
            for i, own, out in zip(coded, models, encode_all(name, [data[i] for i in coded], models), strict=True):
                if out is not None:
                    stages[i].append((name, own, len(data[i])))
                    data[i] = out
    return list(zip(data, stages, strict=True))


def compress(data: bytes, primary: str, secondary: str = "none", model: bytes | None = None) -> tuple[bytes, Stages]:
    """Compressed data, and the stages to undo: codec, model and size of what it was given. A stage that fails is left out."""
    return compress_all([data], [primary], [secondary], model)[0]


def decompress_all(files: list[bytes], stages: list[Stages]) -> list[bytes]:
    data = list(files)
    for k in reversed(range(max(map(len, stages), default=0))):
        for name in sorted({s[k][0] for s in stages if len(s) > k}):
            at = [i for i, s in enumerate(stages) if len(s) > k and s[k][0] == name]
            for i, out in zip(at, decode_all(name, [data[i] for i in at], [stages[i][k][1] for i in at], [stages[i][k][2] for i in at]), strict=True):
                data[i] = out
    return data


def decompress(data: bytes, stages: Stages) -> bytes:
    return decompress_all([data], [stages])[0]


STAGES = pa.list_(pa.struct([("codec", pa.string()), ("model", pa.binary()), ("size", pa.int64())]))
STAGES_DDL = "array<struct<codec: string, model: binary, size: bigint>>"


def _mapped(df: DataFrame, content: str, schema: str, rows: Callable[[list[dict]], list[dict]], types: dict[str, pa.DataType], most: int = AT_ONCE) -> DataFrame:
    """``df`` with columns that rows() makes of some rows, ``most`` bytes of the content in memory at a time."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in grouped(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(content))), 0).to_pylist(), most):
                part = batch.slice(g.start, g.stop - g.start)
                made = rows(part.to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([m[c] for m in made], t) for c, t in types.items()]], names=[*names, *types])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kept}, {schema}")


def as_bytes(x) -> bytes | None:
    return x.encode() if isinstance(x, str) else x


def _compressed(part: list[dict], content: str, primary: str, secondary: str, model: bytes | None) -> Iterator[tuple[bytes, Stages]]:
    """``compress`` of the rows whose content is not null."""
    pick = lambda spec, r: r[spec[7:]] if spec.startswith("column:") else spec
    there = [r for r in part if r[content] is not None]
    return iter(compress_all([as_bytes(r[content]) for r in there], [pick(primary, r) for r in there], [pick(secondary, r) for r in there], model))


def encode_column(df: DataFrame, content: str, primary: str, secondary: str = "none", model: bytes | None = None) -> DataFrame:
    """``df`` with ``encoded`` and ``stages``. ``primary`` and ``secondary`` name codecs or, after ``column:``, columns of names."""

    def rows(part: list[dict]) -> list[dict]:
        made = _compressed(part, content, primary, secondary, model)
        out = []
        for r in part:
            encoded, stages = next(made) if r[content] is not None else (None, None)
            out.append({"encoded": encoded, "stages": None if stages is None else [{"codec": c, "model": m, "size": n} for c, m, n in stages]})
        return out

    return _mapped(df, content, f"encoded binary, stages {STAGES_DDL}", rows, {"encoded": pa.binary(), "stages": STAGES})


def round_trip_column(df: DataFrame, content: str, primary: str, secondary: str = "none", model: bytes | None = None) -> DataFrame:
    """``df`` with ``encoded`` and ``decoded`` as ``decode_column`` of ``encode_column`` has them, by one worker that keeps the models."""

    def rows(part: list[dict]) -> list[dict]:
        made = list(_compressed(part, content, primary, secondary, model))
        files = [out for out, _ in made]
        decoded = iter(zip(files, decompress_all(files, [stages for _, stages in made]), strict=True))
        return [dict(zip(("encoded", "decoded"), next(decoded) if r[content] is not None else (None, None), strict=True)) for r in part]

    return _mapped(df, content, "encoded binary, decoded binary", rows, {"encoded": pa.binary(), "decoded": pa.binary()}, ROUND_TRIP)


def decode_column(df: DataFrame) -> DataFrame:
    """``df`` with ``decoded`` from ``encoded`` and ``stages``."""

    def rows(part: list[dict]) -> list[dict]:
        there = [r for r in part if r["encoded"] is not None]
        made = iter(decompress_all([r["encoded"] for r in there], [[(s["codec"], s["model"], s["size"]) for s in r["stages"]] for r in there]))
        return [{"decoded": None if r["encoded"] is None else next(made)} for r in part]

    return _mapped(df, "encoded", "decoded binary", rows, {"decoded": pa.binary()})
