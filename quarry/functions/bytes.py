"""Counts of bytes, byte pairs, runs and code points, and the measures of information over them.

Counting is done a batch of rows at a time on the bytes as Arrow holds them, so that what leaves a task is at most a row
for each distinct byte, pair or code point (corpus counts), or one row a document (per-document measures). A document may
be text, counted as UTF-8, or binary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .codecs import prefix


def buffers(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value; those of a null are none."""
    values = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    if not len(values):
        return
    ends = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield data[a:b]


def totals(df: DataFrame, content: str, size: int, count: Callable[[np.ndarray], np.ndarray], names: tuple[str, ...]) -> DataFrame:
    """Sums of count(bytes), arrays of ``size``, over all rows; cells by their number, zeros left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for data in buffers(batch.column(0)):
                held += count(data)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(held[full], pa.int64())], names=["cell", "cnt"])

    return df.select(content).mapInArrow(run, "cell int, cnt long").groupBy("cell").agg(F.sum("cnt").alias("cnt"))


def byte_histogram(df: DataFrame, content: str = "text") -> DataFrame:
    """byte, cnt over all rows (AGG-13)."""
    cells = totals(df, content, 256, lambda d: np.bincount(d, minlength=256), ("byte",))
    return cells.select(F.col("cell").alias("byte"), "cnt")


def pair_counts(df: DataFrame, content: str = "text") -> DataFrame:
    """first, second, cnt of adjacent bytes over all rows; pairs don't cross rows (AGG-17, WIN-02)."""

    def pairs(d: np.ndarray) -> np.ndarray:
        return np.bincount(d[:-1].astype(np.int64) * 256 + d[1:], minlength=65536) if len(d) > 1 else np.zeros(65536, np.int64)

    cells = totals(df, content, 65536, pairs, ("first", "second"))
    return cells.select(F.expr("cell div 256").cast("int").alias("first"), (F.col("cell") % 256).alias("second"), "cnt")


def conditional(pairs: DataFrame) -> DataFrame:
    """Pairs with ``p``, the probability of the second byte after the first, and ``info``, its -log2 (AGG-19)."""
    p = F.col("cnt") / F.sum("cnt").over(Window.partitionBy("first"))
    return pairs.withColumn("p", p).withColumn("info", -F.log2("p"))


def repetitive(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Bytes that follow themselves with a probability above ``least`` (FLT-07)."""
    return conditional(pairs).filter((F.col("first") == F.col("second")) & (F.col("p") > least)).select(F.col("first").alias("byte"), "p")


def with_information(histogram: DataFrame) -> DataFrame:
    """A histogram with probabilities and information; only its rows, at most one a symbol, meet in one task."""
    p = F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    return histogram.withColumn("p", p).withColumn("info", -F.log2("p"))


def least_frequent(histogram: DataFrame) -> DataFrame:
    """The byte of 1 to 255 that occurs least, the lowest of several; fit for an escape byte (AGG-23)."""
    every = histogram.sparkSession.range(1, 256).select(F.col("id").cast("int").alias("byte"))
    counted = every.join(histogram, "byte", "left").select("byte", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return counted.agg(F.min_by("byte", F.struct("cnt", "byte")).alias("byte"), F.min("cnt").alias("cnt"))


def normalised(histogram: DataFrame, bits: int) -> DataFrame:
    """Counts scaled so that the largest is 2^bits - 1, rounded up, at least 1 (AGG-25)."""
    most = F.max("cnt").over(Window.partitionBy(F.lit(0)))
    # the quotient first, as the reference scales: whole results then stay whole
    return histogram.withColumn("weight", F.greatest(F.lit(1), F.ceil(F.round(F.col("cnt") * F.lit(float(2**bits - 1)) / most, 9))).cast("decimal(20,0)"))


def code_points(df: DataFrame, content: str = "text") -> DataFrame:
    """code_point, cnt over all rows of a text column (AGG-21)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
                    for c, k in zip(found.tolist(), n.tolist(), strict=True):
                        held[c] = held.get(c, 0) + k
        yield pa.RecordBatch.from_pydict({"code_point": pa.array(held.keys(), pa.int32()), "cnt": pa.array(held.values(), pa.int64())})

    return df.select(content).mapInArrow(run, "code_point int, cnt long").groupBy("code_point").agg(F.sum("cnt").alias("cnt"))


def measures(data: np.ndarray) -> dict[str, float | int | None]:
    """Measures of one file: AGG-13 to AGG-18, AGG-20 and the runs of AGG-23."""
    n = len(data)
    counts = np.bincount(data, minlength=256)
    c = counts[counts > 0]
    info = float(-(c * np.log2(c / n)).sum()) if len(c) > 1 else 0.0
    out = {"n_bytes": n, "distinct_bytes": len(c), "information": info, "entropy": info / n if n else 0.0}
    if n > 1:
        key, pairs = np.unique(data[:-1].astype(np.int32) * 256 + data[1:], return_counts=True)
        before = np.bincount(data[:-1], minlength=256)
        markov = float(-(pairs * np.log2(pairs / before[key >> 8])).sum()) + 8
        return out | {"markov": max(markov, 8.0), "distinct_pairs": len(key), "runs": int((data[1:] != data[:-1]).sum()) + 1}
    return out | {"markov": None, "distinct_pairs": None, "runs": n}


def document_measures(df: DataFrame, key: str, content: str = "text") -> DataFrame:
    """One row of measures for each row; Markov's are null below two bytes, where they aren't defined."""
    kind = df.schema[key].dataType.simpleString()
    names = {"n_bytes": "long", "distinct_bytes": "int", "information": "double", "entropy": "double", "markov": "double", "distinct_pairs": "int", "runs": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        for batch in batches:
            rows = [measures(d) for d in buffers(batch.column(1))]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), **{k: pa.array([r[k] for r in rows], types[t]) for k, t in names.items()}})

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{k} {t}" for k, t in names.items()))


def whole_bytes(bits: Column) -> Column:
    """Bytes that some bits fill; rounded first, so that whole numbers of bytes stay whole."""
    return F.ceil(F.round(bits / 8, 9)).cast("long")


def summary(measured: DataFrame) -> DataFrame:
    """Information in bits and bytes, and sizes with a table of 64-bit (E + 2048) or 8-bit (E + 256) counts (AGG-15, AGG-16)."""
    e = whole_bytes(F.col("information"))
    return measured.withColumns({"information_bytes": F.col("information") / 8, "e": e, "g64": e + 2048, "g8": e + 256})


def run_lengths(df: DataFrame, content: str = "text") -> DataFrame:
    """byte, length, cnt: how often each byte runs for each length, over all rows (WIN-03)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for d in buffers(batch.column(0)):
                if len(d):
                    ends = np.append(np.flatnonzero(d[1:] != d[:-1]), len(d) - 1)
                    found, n = np.unique(np.stack([d[ends].astype(np.int64), np.diff(ends, prepend=-1)]), axis=1, return_counts=True)
                    for b, k, c in zip(*found.tolist(), n.tolist(), strict=True):
                        held[b, k] = held.get((b, k), 0) + c
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int32()), pa.array([k for _, k in held], pa.int64()), pa.array(held.values(), pa.int64())], names=["byte", "length", "cnt"])

    return df.select(content).mapInArrow(run, "byte int, length long, cnt long").groupBy("byte", "length").agg(F.sum("cnt").alias("cnt"))


def utf8_length(code_point: Column) -> Column:
    """Bytes that a code point takes in UTF-8 (STR-13)."""
    return F.when(code_point <= 0x7F, 1).when(code_point <= 0x7FF, 2).when(code_point <= 0xFFFF, 3).otherwise(4)


def unicode_summary(points: DataFrame) -> DataFrame:
    """One row from a code point histogram: symbols, distinct ones, information, and sizes with a table (AGG-22)."""
    each = with_information(points)
    agg = each.agg(F.sum("cnt").alias("symbols"), F.count(F.lit(1)).alias("distinct_symbols"), F.sum(F.col("cnt") * F.col("info")).alias("bits"), (8 + F.sum(utf8_length(F.col("code_point")) + 8)).cast("long").alias("table_utf8"))
    sized = agg.withColumns({"e": whole_bytes(F.col("bits")), "table_utf32": 8 + 12 * F.col("distinct_symbols")})
    return sized.filter("symbols is not null").select("symbols", "distinct_symbols", "bits", "e", "table_utf8", "table_utf32", (F.col("e") + F.col("table_utf8")).alias("g8"), (F.col("e") + F.col("table_utf32")).alias("g32"))


def decoded(data: bytes) -> str:
    """UTF-8 by the reference's rule: a bad byte is U+FFFD and one step on; overlong forms and surrogates pass (STR-12)."""
    out, i, n = [], 0, len(data)
    while i < n:
        b = data[i]
        size = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 0
        if not size or i + size > n or any(x >> 6 != 2 for x in data[i + 1 : i + size]):
            out.append(0xFFFD)
            i += 1
            continue
        c = b if size == 1 else b & (0x7F >> size)
        for x in data[i + 1 : i + size]:
            c = c << 6 | x & 0x3F
        out.append(c if c < 0x110000 else 0xFFFD)
        i += size
    return "".join(map(chr, out))


def single_stage_codec(entropy: Column) -> Column:
    """Codec by entropy in bits a byte (COD-19)."""
    steps = ((3.0, "rle"), (4.0, "huffman"), (5.0, "lz77"), (6.0, "arithmetic"), (7.0, "lz78"), (7.5, "shannon"))
    return ladder(entropy, steps, "none")


def primary_codec(entropy: Column) -> Column:
    return ladder(entropy, ((4.0, "huffman"), (6.0, "arithmetic")), "shannon")


def secondary_codec(entropy: Column) -> Column:
    return ladder(entropy, ((3.0, "rle"), (5.0, "lz77")), "lz78")


def ladder(x: Column, steps: tuple[tuple[float, str], ...], rest: str) -> Column:
    out = F.when(x < steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(x < bound, name)
    return out.otherwise(rest)


def compression_ratio(original: Column, compressed: Column) -> Column:
    """Percent saved; 0 for an empty original (AGG-27)."""
    return F.when(original == 0, F.lit(0.0)).otherwise((1 - compressed / original) * 100)


def printable(text: Column) -> Column:
    """Every character outside printable ASCII as a dot (FLT-09)."""
    return F.regexp_replace(text, r"[^\x20-\x7E]", ".")


@F.pandas_udf(StringType())
def decode_utf8(data: pd.Series) -> pd.Series:
    """Text of UTF-8 bytes by the rule of ``decoded``."""
    return data.map(lambda x: None if x is None else decoded(bytes(x)).encode("utf-8", "replace").decode())


def is_valid_utf8(data: Column) -> Column:
    """Whether bytes are UTF-8 without a replacement character, which counts as damage (STR-14)."""
    return F.is_valid_utf8(data.cast("string")) & ~F.contains(F.hex(data), F.lit("EFBFBD"))


def bit_depth_report(df: DataFrame, key: str, content: str = "text") -> DataFrame:
    """size, entropy and, for codes from counts of 64 to 1 bits, e<bits> and with their tables g<bits>, a row for each file (AGG-26, SNK-20)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sizes_by_depth(d) for d in buffers(batch.column(1))]
            cells = {c: pa.array([r[c] for r in rows], pa.float64() if c == "entropy" else pa.int64()) for c in REPORT}
            yield pa.RecordBatch.from_pydict({key: batch.column(0), **cells})

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} {'double' if c == 'entropy' else 'long'}" for c in REPORT))


DEPTHS = (64, 32, 16, 8, 4, 2, 1)
REPORT = ("size", "entropy", *(f"e{b}" for b in DEPTHS), *(f"g{b}" for b in DEPTHS), "best")


def sizes_by_depth(data: np.ndarray) -> dict[str, float | int]:
    counts = np.bincount(data, minlength=256).tolist()
    most, m = max(counts), measures(data)
    out: dict[str, float | int] = {"size": len(data), "entropy": m["entropy"]}
    for b in DEPTHS:
        weights = [max(1, -(-n * (2**b - 1) // most)) if n else 0 for n in counts] if most else counts
        out[f"e{b}"] = prefix.size(counts, prefix.huffman_codes(weights)) if most else 0
        out[f"g{b}"] = out[f"e{b}"] + -(-256 * b // 8)
    return out | {"best": min(DEPTHS, key=lambda b: (out[f"g{b}"], b))}
