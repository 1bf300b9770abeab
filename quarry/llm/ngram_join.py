"""N-gram Jaccard join by prefixes under several global orders of the shingles.

Documents link when their sets of word 5-shingles have a Jaccard similarity of 0.75 or more; the result is exact. If two
sets of n and m shingles link, each shares a shingle with the other among its first n - ceil(0.75 n) + 1 under *any* order
of all shingles, so a pair must do so under several orders before its sets are compared.

1. Documents with equal sets are one class; only classes go on (named by 128 bits of their set).
2. Shingles are counted over all documents, packed in four bytes each, and three bit filters of fixed size keep which
   occur in 2, 16 and 256 sets or more. All orders put rarer shingles first by these filters and differ within. A filter
   decides an order, never what is compared: when one fills up at a larger size, prefixes get longer lists, not wrong ones.
3. A class whose prefix has only shingles of its own can't link and drops out. The others are indexed by the shingles of
   their first prefix.
4. First round: under each shingle, every class is paired with one of them only, the one whose shingles are the most
   common, as an original's are among its copies. Links found give components.
5. Second round: pairs under a shingle that are still in different components. Large groups of near copies are one
   component by then. Under each shingle only classes outside its largest component look for partners, so that no group
   is expanded into its pairs.

Components need no more links than these. ``all_links`` finds every link between classes: all pairs under each shingle of
the prefixes, a shingle's classes dealt into groups of bounded size, so that no task has all of a common shingle's pairs.
The pairs of a large group of near copies are as many as its square; ``op3_ngram_jaccard_links`` counts them by document.

In all of these a pair needs enough shingles left from the shared one on in both sets (the positional bound): if that
shingle is the first that they share, no earlier one can count. The bound tells for each entry of the index how large a
partner may be, and that the smaller set of a pair has the shingle among its first seventh; pairs are made between these
and larger sets, in classes of size. The filters of the orders are then intersected: what is left must share a shingle of
the prefixes under two other orders, of which only 32 bits a shingle travel. Sets go to the pairs that pass, for the exact test.

Null texts and texts without words have empty sets and link with nothing; texts of any length are taken whole; repeated rows
are copies; with null doc_ids, a component's id is the least that isn't null, if any. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, documents, durable, parts, spread_join, swept
from .shingles import mixed, set_id, sets_of

#: Sets in which a shingle of each class occurs at least, and bits of the class's filter.
CLASSES = ((2, 2**27), (16, 2**24), (256, 2**22))
PROBES, OTHER_ORDERS = 3, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Shingles that one task counts, about.
A_BUCKET = 500_000
#: Classes of one shingle that are paired with all others of it in one group, about.
A_GROUP = 500


def prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and set_id of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [(len(s), set_id(s)) for s in sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_id binary")


def probes(rest: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of shingles in their bucket's part of a filter."""
    h = mixed(rest.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [((h >> np.uint64(20 * k)) & np.uint64(0xFFFFFFFF)) % np.uint64(bits) for k in range(PROBES)]


def split(tokens: np.ndarray, log_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and the 32 bits kept, of each shingle. Sorted shingles have sorted buckets."""
    return (tokens >> np.uint64(64 - log_buckets)).astype(np.int64), ((tokens >> np.uint64(32 - log_buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def count_shingles(docs: DataFrame, log_buckets: int) -> list[np.ndarray]:
    """The filters, as arrays of bytes."""
    buckets = 1 << log_buckets

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            bucket, rest = split(np.sort(np.concatenate(held)), log_buckets)
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if at[b] < at[b + 1]]
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "packed": pa.array([rest[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())})

        for batch in parts(batches):
            for s in sets_of(batch.column(0)):
                if len(s) and (x := set_id(s)[:8]) not in seen:  # copies within a task count once
                    seen.add(x)
                    held.append(s)
                    if (waiting := waiting + len(s)) > 2_000_000:
                        yield out()
                        waiting = 0
        if held:
            yield out()

    def count(table: pa.Table) -> pa.Table:
        tokens, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("packed")]), return_counts=True)
        parts = []
        for least, bits in CLASSES:
            own = np.zeros(bits // buckets, np.uint8)
            for at in probes(tokens[n >= least], len(own)):
                own[at] = 1
            parts.append(np.packbits(own).tobytes())
        return pa.table({"bucket": table.column("bucket").slice(0, 1), **{f"part{k}": pa.array([p], pa.binary()) for k, p in enumerate(parts)}})

    schema = "bucket int, " + ", ".join(f"part{k} binary" for k in range(len(CLASSES)))
    found = docs.select("text").mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInArrow(count, schema).collect()
    filters = [np.zeros((buckets, bits // buckets // 8), np.uint8) for _, bits in CLASSES]
    for r in found:
        for k, f in enumerate(filters):
            f[r["bucket"]] = np.frombuffer(r[f"part{k}"], np.uint8)
    return [f.reshape(-1) for f in filters]


def classes_of(tokens: np.ndarray, filters: list[np.ndarray], log_buckets: int) -> np.ndarray:
    bucket, rest = split(tokens, log_buckets)
    out = np.zeros(len(tokens), np.int8)
    for (_, bits), f in zip(CLASSES, filters, strict=True):
        own = bits >> log_buckets
        hit = np.ones(len(tokens), bool)
        for at in probes(rest, own):
            at = bucket.astype(np.uint64) * np.uint64(own) + at
            hit &= (f[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
        out += hit
    return out


def indexed(docs: DataFrame, log_buckets: int) -> DataFrame:
    """The classes that may link: set_id, n, prefix (the shared shingles of the first prefix), under1 and under2 (32 bits of
    those of the other prefixes), tokens and bounds (class by class)."""
    filters = docs.sparkSession.sparkContext.broadcast(count_shingles(docs, log_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in parts(batches):
            rows: list[tuple] = []
            for s in sets_of(batch.column(0)):
                kinds = classes_of(s, filters.value, log_buckets)
                own, reach = int((kinds == 0).sum()), prefix(len(s))
                if len(s) and own < reach and (x := set_id(s)) not in seen:
                    seen.add(x)
                    ordered = s[np.argsort(kinds, kind="stable")]
                    ends = np.cumsum(np.bincount(kinds, minlength=len(CLASSES) + 1)).tolist()
                    others = [first_under(ordered, ends, order).astype(np.uint32).view(np.int32) for order in OTHER_ORDERS]
                    rows.append((x, len(s), ordered[own:reach].view(np.int64), *others, ordered.tobytes(), ends))
            kinds_of = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_of)], ["set_id", "n", "prefix", "under1", "under2", "tokens", "bounds"])

    return docs.select("text").mapInArrow(run, "set_id binary, n long, prefix array<long>, under1 array<int>, under2 array<int>, tokens binary, bounds array<int>")


def first_under(tokens: np.ndarray, bounds: list[int], order: int) -> np.ndarray:
    """The prefix of a set under another order, without the shingles that no other set has."""
    left, out, a = prefix(len(tokens)) - bounds[0], [], bounds[0]
    for b in bounds[1:]:
        part = tokens[a:b]
        if left < len(part):
            part = part[np.argpartition(mixed(part * np.uint64(order)), left - 1)[:left]] if left > 0 else part[:0]
        out.append(part)
        left, a = left - len(part), b
    return np.concatenate(out)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: those that share prefix shingles under the other orders too, and then enough of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in ("a_tokens", "b_tokens"))
            ok = [7 * len(np.intersect1d(x, y, True)) >= 3 * (len(x) + len(y)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def both(of: DataFrame, *names: str) -> DataFrame:
        side = lambda k: sets.select(F.col("set_id").alias(k), *[F.col(n).alias(f"{k}_{n}") for n in names])
        return of.join(side("a"), "a").join(side("b"), "b")

    near = both(pairs.select("a", "b"), "under1", "under2").filter(F.arrays_overlap("a_under1", "b_under1") & F.arrays_overlap("a_under2", "b_under2"))
    return both(near.select("a", "b"), "tokens").select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of each end of the edges (a, b)."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("id"), F.least("a", "_b").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("_near"))
        lower = durable(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("_was"), F.least("component", "_near").alias("_to")))
        far = lower.select(F.col("id").alias("_to"), F.col("_to").alias("_on"))
        stepped = durable(spread_join(lower, far, "_to", "id").select("id", "_was", F.least("_to", "_on").alias("component")))
        labels = stepped.select("id", "component")
        if stepped.filter("component <> _was").isEmpty():
            return labels


#: Size that the partner of a set may have at most, if the shingle at place ``at`` is the first that they share.
LARGEST = "(7 * (n - at)) div 3 - n"


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / np.log(4 / 3)).cast("int")


def exploded(sets: DataFrame) -> DataFrame:
    """A row for each shingle of the prefixes, with the largest size of a partner, where one is possible."""
    rows = sets.select(*[c for c in sets.columns if c not in ("prefix", "bounds")], F.col("bounds")[0].alias("_own"), F.posexplode("prefix").alias("_k", "token"))
    rows = rows.withColumn("at", (F.col("_own") + F.col("_k")).cast("long")).withColumn("largest", F.expr(LARGEST)).drop("_own", "_k", "at")
    return rows.filter("4 * largest >= 3 * n")


def small(rows: DataFrame) -> DataFrame:
    """The entries that may be the smaller set of a pair, in their class of size."""
    return rows.filter("largest >= n").withColumn("size_class", size_class(F.col("n")))


def large(rows: DataFrame) -> DataFrame:
    """The entries in the classes of size of all smaller sets that may be their partners."""
    return rows.withColumn("size_class", F.explode(F.sequence(size_class(F.ceil(F.col("n") * 0.75)), size_class(F.least("n", "largest")))))


def paired(larger: DataFrame, smaller: DataFrame, *keys: str) -> DataFrame:
    """Pairs of entries under one shingle that meet the positional bound, the larger set (of equal ones, that of larger name) as a."""
    a, b = (df.select("token", "size_class", *keys, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in ("token", "size_class", *keys)]) for k, df in (("a", larger), ("b", smaller)))
    pairs = a.join(b, ["token", "size_class", *keys])
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("set_id_a") > F.col("set_id_b")))
    return pairs.filter(first & (F.col("n_b") <= F.col("largest_a")) & (F.col("n_a") <= F.col("largest_b")))


def named(pairs: DataFrame, a: str = "set_id_a", b: str = "set_id_b") -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def classes(docs: DataFrame, n_shingles: int) -> DataFrame:
    """The classes that may link, as ``indexed`` gives them."""
    found = durable(indexed(docs, min(16, max(6, (n_shingles // A_BUCKET).bit_length()))).dropDuplicates(["set_id"]))
    swept(docs.sparkSession)  # the packed shingles, and the sets that went to their classes
    return found


def links(docs: DataFrame, n_shingles: int) -> DataFrame:
    """Links (a, b) between classes, enough of them for every component."""
    found = classes(docs, n_shingles)
    common = F.round(F.aggregate("bounds", F.lit(0).cast("long"), lambda a, x: a + F.col("n") - x) / F.col("n"), 9)  # mean class of its shingles
    index = exploded(found.select("set_id", "n", "prefix", "bounds", common.alias("common")))
    centre = index.groupBy("token").agg(F.max(F.struct("common", "set_id", "n", "largest")).alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", "c")
    fits = (F.col("n") <= F.col("c.largest")) & (F.col("c.n") <= F.col("largest")) & (F.col("set_id") != F.col("c.set_id"))
    first = durable(verified(named(index.drop("common").join(centre, "token").filter(fits).select("set_id", F.col("c.set_id").alias("centre")), "set_id", "centre"), found))
    part = components(first)
    swept(docs.sparkSession)
    placed = found.select("set_id", "n", "prefix", "bounds").join(part.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id")).drop("component")
    rows = exploded(durable(placed))
    # the largest component under each shingle that has several
    most = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("part", F.struct("k", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("token", "most")
    marked = durable(rows.join(most, "token").withColumn("outside", F.col("part") != F.col("most")).drop("most"))
    outside, inside = marked.filter("outside"), marked.filter("not outside")
    crossing = paired(large(outside), small(marked)).filter("part_a <> part_b").unionByName(paired(large(inside), small(outside)))
    out = durable(first.union(verified(named(crossing), found)))
    del found, index, centre, part, placed, rows, most, marked, outside, inside, crossing
    swept(docs.sparkSession)
    return out


def all_links(docs: DataFrame, n_shingles: int) -> DataFrame:
    """Every link (a, b) between classes, once, a < b."""
    found = classes(docs, n_shingles)
    index = exploded(found.select("set_id", "n", "prefix", "bounds"))
    groups = index.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", F.ceil(F.col("k") / A_GROUP).cast("int").alias("groups"))
    rows = durable(index.join(groups, "token"))
    dealt = small(rows).withColumn("group", F.pmod(F.xxhash64("set_id"), F.col("groups")).cast("int")).drop("groups")
    to_all = large(rows).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    return durable(verified(named(paired(to_all, dealt, "group")), found))


def with_components(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``sets`` with the components that the links make."""
    classes_of = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    ends = durable(components(edges).withColumnRenamed("id", "set_id").join(classes_of, "set_id"))
    linked = spread_join(ends.drop("least"), ends.groupBy("component").agg(F.min("least").alias("component_id")), "component", "set_id")
    alone = F.col("component").isNull()
    class_of = classes_of.join(linked, "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("component"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # copies of one text may be a third of all rows
    return spread_join(sets, class_of, "set_id", "doc_id").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id and component_id of every row."""
    sets = durable(measured(docs))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    return with_components(sets, links(docs, total))


def counted(docs: DataFrame) -> DataFrame:
    """As ``joined``, with n_links: the other rows that a row links with, copies among them."""
    sets = durable(measured(docs))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    edges = all_links(docs, total)
    size = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.count(F.lit(1)).alias("_size"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(size.withColumnRenamed("set_id", "b"), "b").groupBy("a").agg(F.sum("_size").alias("_near"))
    number = size.join(near.withColumnRenamed("a", "set_id"), "set_id", "left").select("set_id", (F.col("_size") - 1 + F.coalesce("_near", F.lit(0))).alias("n_links"))
    return with_components(sets, edges).join(number, "set_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``: that of the least doc_id, null last. Documents without words all stay.

    Texts are shuffled once, by doc_id and hash, to meet what stays.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    stay = joined(docs).filter("n_shingles > 0").groupBy("component").agg(best.alias("x")).select(F.col("x.none").alias("_none"), F.coalesce(F.col("x.id").cast("string"), F.lit("")).alias("_id"), F.col("x.hash").alias("_hash"), F.lit(True).alias("_stay"))
    stay = durable(stay)
    swept(docs.sparkSession)  # before the texts are shuffled
    moved, back = aside(docs)
    of = lambda c: F.col(f"_d{docs.columns.index(c)}")
    keyed = moved.withColumns({"_none": of("doc_id").isNull(), "_id": F.coalesce(of("doc_id").cast("string"), F.lit("")), "_hash": F.xxhash64(of("text")), "_empty": F.coalesce(~of("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))})
    kept = keyed.join(stay, ["_none", "_id", "_hash"], "left").filter(F.col("_stay") | F.col("_empty"))
    turn = Window.partitionBy("_none", "_id", "_hash").orderBy("_stay")  # rows that are equal in these are copies, of which one stays
    return kept.withColumn("_turn", F.row_number().over(turn)).filter((F.col("_turn") == 1) | F.col("_empty")).select(*back)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")
