"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

The word 5-shingles of a text (words lower-cased A-Z; with fewer words, the whole sequence as one) are hashed once to 64
bits. The top eight bits name one of 256 bins and each bin keeps its least hash. An empty bin takes the value of the
first non-empty bin of a random sequence of its own (optimal densification), the same sequence for every document: PROBES
hashes, and after these the full bin of least hash with it. The low four bits of each bin are packed, 16 bins in a long; the fingerprint is these 16 longs in hexadecimal. Two unequal
hashes agree in four bits with chance 1/16, so the likeness is (agreeing bins / 256 - 1/16) / (15/16), at least 0.

A text without words, or null, has the empty fingerprint: likeness 1 to another empty one, 0 to others. The next document
by ascending doc_id (null first, equal ids by text, bytewise) follows the last one round to the first; a single document
is its own next. Texts of any length are taken whole, rows may repeat, extra columns are ignored; an empty table gives an
empty result.

Texts are shuffled once, by stretches of doc_id of about STRETCH documents, and sorted within these. Stretches are equal
parts of the range of ids; one that comes out too full, where ids are dense between gaps, is cut into equal parts of its
own range, and so on. Rows that share one id (or have none) are one stretch or, if they are too many, several, by the first
two bytes of their texts. The first document of a stretch goes to the stretch before as well, so that every document finds
its successor beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, let, words

BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 12
PER_LONG = 64 // BITS
CHANCE = 2.0**-BITS
STRETCH, MOST_STRETCHES = 512, 1_000_000
#: A stretch is cut again if it has so many times the rows that it should have.
TOO_FULL = 8


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        several = F.transform(F.slice(w, F.lit(1), n - SHINGLE + 1), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
        # with fewer words the last arguments are null, which the hash passes over; their count tells such shingles apart
        one = F.array(F.xxhash64(F.lit(-1), n, *[F.get(w, F.lit(k)) for k in range(SHINGLE - 1)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, one).otherwise(several)

    return let(F.transform(words(lower), lambda x: F.xxhash64(x)), hashes)


def bins(text: Column) -> Column:
    """The 16 packed longs of a text; null if it has no words."""
    least = [signed((b << 56) | (2**56 - 1)) for b in range(BINS)]  # a bin's largest hash stands for none
    top = lambda h: F.shiftrightunsigned(h, 56).cast("int")
    none = lambda h: F.bitwise_not(h).bitwiseAND(F.lit(2**56 - 1)) == 0

    def filled(d: Column) -> Column:
        """``d``: the value of each bin, in the order of signed longs, null for none."""
        full = F.filter(F.transform(d, lambda x, j: F.struct(j.alias("j"), x.alias("h"))), lambda x: x["h"].isNotNull())

        def value(x: Column, i: Column, there: Column) -> Column:
            looks = [F.get(d, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
            return F.coalesce(x, *looks, F.array_min(F.transform(there, lambda y: F.struct(F.xxhash64(i, y["j"]).alias("r"), y["h"].alias("h"))))["h"])

        return let(full, lambda there: F.transform(d, lambda x, i: value(x, i, there)))

    def packed(v: Column) -> Column:
        def long_of(g: Column) -> Column:
            pick = [F.shiftleft(F.get(v, g * PER_LONG + k).bitwiseAND(F.lit(2**BITS - 1)), BITS * (PER_LONG - 1 - k)) for k in range(PER_LONG)]
            return reduce(lambda a, b: a.bitwiseOR(b), pick)

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), long_of)

    def densest(sorted_hashes: Column) -> Column:
        return F.filter(sorted_hashes, lambda h, i: (i == 0) | (top(h) != top(F.get(sorted_hashes, F.greatest(i - 1, F.lit(0))))))

    def of(h: Column) -> Column:
        first = let(F.sort_array(F.concat(h, F.expr(f"array({', '.join(f'{x}L' for x in least)})"))), densest)
        opened = F.transform(first, lambda x: F.when(~none(x), x))
        return F.when(F.size(h) > 0, let(let(opened, filled), packed))

    return let(shingle_hashes(text), of)


def as_string(packed: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two texts from their packed bins."""

    def differing(x: Column) -> Column:
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        z = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), differing)), F.lit(0), lambda n, x: n + x)
    agree = 1 - unlike / F.lit(float(BINS))
    both, one = a.isNull() & b.isNull(), a.isNull() | b.isNull()
    return F.when(both, 1.0).when(one, 0.0).otherwise(F.greatest(F.lit(0.0), (agree - CHANCE) / (1 - CHANCE)))


def stretched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_s``, their stretch, and a table of all stretches (two MOST_STRETCHES at most) with what names their first row.

    Stretches are arrays and sort as their rows do: first whether there is an id, then the part at each cut.
    """
    size, number = max(STRETCH, docs.count() // MOST_STRETCHES), F.col("doc_id").cast("decimal(20,0)")
    cuts: list[DataFrame] = []

    def within(rows: DataFrame, cut: DataFrame, part: Column) -> DataFrame:
        rows = rows.join(F.broadcast(cut), "_s", "left").withColumn("_part", part)
        return rows.withColumn("_s", F.when(F.col("_part").isNull(), F.col("_s")).otherwise(F.concat("_s", F.array("_part")))).drop("_part", *[c for c in cut.columns if c != "_s"])

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_s", F.array(F.col("doc_id").isNotNull().cast("long")))
        for cut in cuts:
            rows = within(rows, cut, F.floor((number - F.col("_low")) / F.col("_width")).cast("long"))
        return rows

    while True:
        found = placed(docs.select("doc_id")).groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_low"), F.max(number).alias("_high"), F.min("doc_id").alias("_first"))
        found = durable(found.withColumn("_parts", F.ceil(F.col("_n") / size)))
        full = found.filter(F.col("_n") > TOO_FULL * size)
        cut = full.filter("_low < _high").select("_s", "_low", F.ceil((F.col("_high") - F.col("_low") + 1) / F.col("_parts")).alias("_width"))
        if cut.isEmpty():
            break
        cuts.append(cut)
    firsts = found.select("_s", key_of(F.col("_first")).alias("_key"), F.lit(None).cast("long").alias("_hash"))
    out = placed(docs)
    if not full.isEmpty():  # what is too full now has one id, or none
        alone = full.select("_s", F.least("_parts", F.lit(65536)).alias("_cells"))
        leading = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 2)), 4, "0"), 16, 10).cast("long")
        part = F.floor(leading * F.col("_cells") / 65536).cast("long")
        by_text = within(placed(docs.select("doc_id", "text")).join(F.broadcast(alone.select("_s")), "_s", "left_semi"), alone, part)
        by_text = by_text.groupBy("_s").agg(key_of(F.min("doc_id")).alias("_key"), F.min_by(F.xxhash64("text"), "text").alias("_hash"))
        firsts, out = durable(firsts.join(alone, "_s", "left_anti").unionByName(by_text)), within(out, alone, part)
    return out, firsts


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``docs`` with ``next``, a struct of the ``carry`` columns of the document that follows by doc_id."""
    rows, firsts = stretched(docs)
    at = Window.orderBy("_s")
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_s").over(at), F.max("_s").over(Window.partitionBy())))
    by_key = firsts.filter("_hash is null").select("_key", F.col("_before").alias("_after_key"))
    by_text = firsts.filter("_hash is not null").select("_key", "_hash", F.col("_before").alias("_after_text"))
    sent = (
        rows.withColumns({"_key": key_of(F.col("doc_id")), "_hash": F.xxhash64("text")})
        .join(F.broadcast(by_key), "_key", "left")
        .join(F.broadcast(by_text), ["_key", "_hash"], "left")
        .withColumn("_to", F.explode(F.expr("filter(array(struct(_s as s, false as copy), struct(coalesce(_after_key, _after_text) as s, true as copy)), x -> x.s is not null)")))
        .select(*docs.columns, F.col("_to.s").alias("_s"), F.col("_to.copy").alias("_copy"))
    )
    order = Window.partitionBy("_s").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    return sent.withColumn("next", F.lead(F.struct(*carry)).over(order)).filter(~F.col("_copy")).drop("_s", "_copy")


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``packed`` and ``fingerprint``."""
    return docs.withColumn("packed", bins(F.col("text"))).withColumn("fingerprint", as_string(F.col("packed")))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("packed", bins(F.col("text")))
    pairs = with_next(docs, ["text", "packed"])
    half = F.expr("n_chars div 2").cast("int")
    edited = (
        pairs.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.substring("next.text", F.lit(1), half)))
        .select("doc_id", "n_chars", "packed", F.col("next.packed").alias("next_packed"), F.sha2("edited", 256).alias("edited_sha256"), bins(F.col("edited")).alias("edited_packed"))
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("packed")).alias("fingerprint"),
        as_string(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
