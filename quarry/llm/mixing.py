"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source, its documents in seeded-shuffled order, are cut into blocks of equal length. Slot i of the mix
takes the point i times the golden ratio, modulo 1, through the cumulative target weights to a source; the slots of a
source are ranked, and the k-th takes the source's k-th block, going round once more after the last. Every stretch of the
mix has the target weights to within a few slots, and reruns agree.

Targets: the budget is SHARE times all words, dealt by weight; a source's target stops at MOST times its words and what
is over is dealt again by weight until no source is above. Only source totals come to the driver: a mixture names its
sources, so these are few (the schedule's plan has a term for each). Ranks and word positions come from slice totals
(``common.running``), so that no task sees a whole source. Texts are read once and are not shuffled by the schedule.

A null text has no words, a null source is a source of its own after the others, and documents without words are taken 0
times. Texts of any length are counted whole. Rows with equal doc_id are ordered by size; extra columns are ignored
(``mixed`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICES, aside, documents, durable, n_words, running, slice_of, source_key

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Blocks in a mix: as many as this or, once a block has LONGEST words, as many as it takes.
BLOCKS, LONGEST = 2**18, 4096
#: The golden ratio's fraction of 2**31: points are numbers of 31 bits, and repeat after 2**31 slots.
POINTS, GOLDEN = 2**31, 1327217885


def targets(sizes: dict[str, int], weights: tuple[int, ...] = WEIGHTS) -> dict[str, Fraction]:
    """Words to take from each source; ``sizes`` by source key."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    left, found, free = SHARE * sum(sizes.values()), {}, set(sizes)
    while free:
        each = left / sum(weight[s] for s in free)
        over = {s for s in free if each * weight[s] > MOST * sizes[s]}
        if not over:
            return found | {s: each * weight[s] for s in free}
        for s in over:
            found[s] = Fraction(MOST * sizes[s])
            left -= found[s]
        free -= over
    return found


def schedule(spark: SparkSession, goals: dict[str, Fraction], block: int) -> DataFrame:
    """slot, _source and block (from 0, the rank of the slot within its source)."""
    total = sum(goals.values())
    n, keys, at, bounds = round(total / block), sorted(goals), Fraction(0), []
    for s in keys:
        at += goals[s]
        bounds.append(float(at / total) if total else 1.0)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", F.expr(f"((slot % {POINTS}) * {GOLDEN}) % {POINTS} / {POINTS}D"))
    passed = reduce(add, [(F.col("point") >= b).cast("int") for b in bounds[:-1]], F.lit(0))
    slots = slots.select("slot", F.get(F.array(*[F.lit(s) for s in keys]) if keys else F.array(F.lit("")), passed).alias("_source"), F.expr(f"int(slot div {max(1, -(-n // SLICES))})").alias("_piece"))
    return running(durable(slots), "_source", "_piece", ["slot"]).select("slot", "_source", (F.col("rank") - 1).alias("block"))


class Mix:
    """The rows of ``docs`` with their places, and the pieces of them that the mix takes."""

    def __init__(self, docs: DataFrame, identity: list[str], seed: int = 29) -> None:
        spark, self.identity = docs.sparkSession, identity
        sized = durable(docs.select(*identity, source_key(F.col("source")).alias("_source"), n_words(F.col("text")).alias("size")).withColumn("h", F.xxhash64(F.lit(seed), "_source", *identity)))
        self.sizes = {r[0]: r[1] for r in sized.groupBy("_source").agg(F.sum("size")).collect()}
        self.goals = targets(self.sizes)
        self.block = max(1, min(LONGEST, int(SHARE * sum(self.sizes.values())) // BLOCKS))
        placed = running(sized.withColumn("_piece", slice_of(F.col("h"))), "_source", "_piece", ["h", *identity, "size"], "size")
        self.rows = durable(placed.drop("h", "_piece", "key_rows"))
        # each source's words go round twice at most, so no document is taken more than twice
        laps = self.rows.filter("size > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("_from", F.expr("before + lap * key_weight"))
        cut = laps.withColumn("block", F.explode(F.expr(f"sequence(_from div {self.block}, (_from + size - 1) div {self.block})")))
        cut = cut.withColumns({"first": F.expr(f"greatest(block * {self.block} - _from, 0)"), "end": F.expr(f"least((block + 1) * {self.block} - _from, size)")})
        #: slot, lap, words first to end of the document
        self.pieces = cut.join(schedule(spark, self.goals, self.block), ["_source", "block"]).select("slot", "_source", "rank", *identity, "size", "lap", "first", "end")

    def taken(self) -> DataFrame:
        """The rows with ``taken``, the words that the mix takes of each, and ``first_slot``, where it does so first."""
        sums = self.pieces.groupBy("_source", "rank").agg(F.sum(F.col("end") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
        return self.rows.join(sums, ["_source", "rank"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def turns(self) -> DataFrame:
        """A row for each time that the mix takes a document: the slot in which it begins, and its words first to end.

        A source's slots take its blocks one after the other, so that the pieces of a turn are in one stretch.
        """
        turn = ["_source", "rank", *self.identity, "size", "lap"]
        return self.pieces.groupBy(*turn).agg(F.min("slot").alias("slot"), F.min("first").alias("first"), F.max("end").alias("end"))

    def sources(self) -> DataFrame:
        spark = self.rows.sparkSession
        return spark.createDataFrame([(s, n, float(self.goals[s])) for s, n in sorted(self.sizes.items())], "_source string, source_size long, target double")


def stretch_of(text: Column, first: Column, end: Column) -> Column:
    """The words of a text from ``first`` on up to ``end``, with what stands between them."""
    with_blanks = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the white space before it
    return F.regexp_replace(F.array_join(F.slice(with_blanks, (first + 1).cast("int"), (end - first).cast("int")), ""), r"^[\x20\x09-\x0D]+", "")


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as the mix takes them, in the order of its slots: a row for each turn, which of a source's last document
    may have only a stretch of its words.

    Rows that agree in doc_id, source and text take turns one by one. Texts are shuffled twice: to meet their turns, and
    into the order of the slots.
    """
    identity = ["_id", "_text"]
    moved, back = aside(docs)
    of = lambda c: F.col(f"_d{docs.columns.index(c)}")
    keyed = moved.withColumns({"_id": F.coalesce(of("doc_id").cast("string"), F.lit("")), "_text": F.xxhash64(F.coalesce(of("text"), F.lit(""))), "_source": source_key(of("source"))})
    turns = Mix(keyed.select(*identity, of("source").alias("source"), of("text").alias("text")), identity).turns()
    rows = keyed.dropDuplicates(["_source", *identity]).join(turns.select("_source", *identity, "slot", "lap", "rank", "first", "end", "size"), ["_source", *identity])
    text = f"_d{docs.columns.index('text')}"
    rows = rows.withColumn(text, F.when(F.col("end") - F.col("first") < F.col("size"), stretch_of(F.col(text), F.col("first"), F.col("end"))).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn(f"_d{docs.columns.index('n_chars')}", F.length(text).cast(docs.schema["n_chars"].dataType))
    order = ["slot", "_source", "lap", "rank"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*back)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(documents(spark, sf_dir).select("doc_id", "source", "text"), ["doc_id"])
    return mix.taken().join(mix.sources(), "_source").select("doc_id", "size", "source_size", "target", "taken", "first_slot")
