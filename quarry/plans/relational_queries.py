"""Joins, grouping, windows, unions and changes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators import dml, joins, relational
from ..sources.tables import spread, table, views
from .registry import query

JOIN_SQL = """
SELECT cast(c_nationkey AS varchar) AS "KeyField", c_custkey AS "Value1", s_suppkey AS "Value3", c_custkey * s_suppkey AS "TotalValue",
       c_mktsegment AS "Description", s_name AS "Status"
FROM customer JOIN supplier ON c_nationkey = s_nationkey
"""
MERGE_SQL = """
WITH m AS (SELECT l_suppkey AS k, l_quantity AS x FROM lineitem WHERE l_linenumber = 1), s AS (SELECT l_suppkey AS k, l_extendedprice AS y FROM lineitem WHERE l_linenumber = 2)
SELECT m.k AS "RKey", count(*) AS "RText", round(avg(x * y), 4) AS "NUMAVG" FROM m JOIN s ON m.k = s.k GROUP BY m.k
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("KeyField"), F.col("c_custkey").alias("Value1"), F.col("c_mktsegment").alias("Description"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("KeyField"), F.col("s_suppkey").alias("Value3"), F.col("s_name").alias("Status"))
    return a, b


def master_slave(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    master = lines.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("MKey"), F.col("l_quantity").alias("Num"))
    slave = lines.filter("l_linenumber = 2").select(F.col("l_suppkey").alias("SKey"), F.col("l_extendedprice").alias("Num"))
    return master, slave


@query("bucket_join", JOIN_SQL)
def bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return joins.bucket_join(spread(a), b)  # each row has many partners, so that a table of few parts keeps few cores long


@query("bucket_join_merge", JOIN_SQL)
def bucket_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.bucket_join(*sides(spark, sf_dir), strategy="merge")


@query("bucket_join_hash", JOIN_SQL)
def bucket_join_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.bucket_join(*sides(spark, sf_dir), strategy="hash")


@query("bucket_join_sql", JOIN_SQL)
def bucket_join_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs in order without a sort of the pairs: customers are put in order of the key, which a broadcast join keeps.

    KeyField itself stands for the key, so that the plan knows its order; the filter, true of every row, stands in the way
    of the optimizer, which drops a sort under a join.
    """
    views(spark, sf_dir, "supplier")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment")
    customers.filter("c_nationkey IS NOT NULL").orderBy("c_nationkey").filter(F.spark_partition_id() >= 0).createOrReplaceTempView("customer")
    return spark.sql(
        "SELECT cast(c_nationkey AS string) AS KeyField, c_custkey AS Value1, s_suppkey AS Value3, c_custkey * s_suppkey AS TotalValue, c_mktsegment AS Description, s_name AS Status"
        " FROM customer INNER JOIN supplier ON c_nationkey = s_nationkey ORDER BY KeyField"
    )


@query("bucket_merge", MERGE_SQL)
def bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.bucket_merge(*master_slave(spark, sf_dir)).withColumn("NUMAVG", F.round("NUMAVG", 4)).orderBy("RKey")


@query("bucket_merge_direct", MERGE_SQL)
def bucket_merge_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.bucket_merge_direct(*master_slave(spark, sf_dir)).withColumn("NUMAVG", F.round("NUMAVG", 4))


@query("distinct_key_union", "SELECT DISTINCT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.all_keys((table(spark, sf_dir, "customer"), "c_nationkey"), (table(spark, sf_dir, "supplier"), "s_nationkey"))


@query(
    "union_roles_top20",
    "SELECT name, role FROM (SELECT c_name AS name, 'customer' AS role FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier) ORDER BY role, name LIMIT 20",
)
def union_roles_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.roles((table(spark, sf_dir, "customer"), F.col("c_name"), "customer"), (table(spark, sf_dir, "supplier"), F.col("s_name"), "supplier"))


@query(
    "window_avg_filter_top10",
    """
WITH a AS (SELECT n_name, c_name, avg(c_acctbal) OVER (PARTITION BY n_name) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey
           WHERE c_acctbal IS NOT NULL AND regexp_matches(c_mktsegment, '^[A-Z]+$'))
SELECT n_name, c_name, round(mean, 4) AS average FROM a WHERE mean > 0 ORDER BY mean DESC, c_name LIMIT 10
""",
)
def window_avg_filter_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").filter(F.col("c_acctbal").isNotNull() & F.col("c_mktsegment").rlike("^[A-Z]+$")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mean = relational.with_group_mean(both.select("n_name", "c_name", "c_acctbal"), "n_name", "c_acctbal", "mean")
    return mean.filter("mean > 0").orderBy(F.desc("mean"), "c_name").limit(10).select("n_name", "c_name", F.round("mean", 4).alias("average"))


@query("group_avg_round", "SELECT o_orderpriority AS priority, cast(round(cast(avg(o_totalprice) AS decimal(38,10)), 2) AS double) AS average FROM orders GROUP BY 1")
def group_avg_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(relational.rounded_mean("o_totalprice").cast("double").alias("average"))


@query(
    "group_having_count",
    "SELECT c_custkey AS customer, round(avg(o_totalprice), 8) AS average, count(o_totalprice) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING avg(o_totalprice) >= 150000",
)
def group_having_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the customer's key is unique, so that orders can be reduced before they meet it
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.avg("o_totalprice").alias("mean"), F.count("o_totalprice").alias("orders")).filter("mean >= 150000")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    return per.join(keys, "customer").select("customer", F.round("mean", 8).alias("average"), "orders")


@query(
    "three_way_join",
    "SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return per.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "customers")


@query(
    "four_way_join_avg",
    """
SELECT r_name, n_name, round(avg(l_extendedprice), 4) AS average, count(*) AS lines FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2
""",
)
def four_way_join_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines are reduced to a row for each supplier before any join
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("total"), F.count("l_extendedprice").alias("priced"), F.count(F.lit(1)).alias("lines"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = per.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name")
    return joined.agg(F.round(F.sum("total") / F.sum("priced"), 4).alias("average"), F.sum("lines").alias("lines"))


@query("anti_join_not_exists", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("search_like_params", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name LIKE '%7%' AND c_mktsegment LIKE 'B%'")
def search_like_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer")
    return api.execute(spark, "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name LIKE $1 AND c_mktsegment LIKE $2", ["%7%", "B%"])


@query("equality_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def equality_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return api.execute(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = $1 AND o_custkey = $2", ["F", "7"], infer=True)


@query(
    "scalar_subquery_lookup",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1)",
)
def scalar_subquery_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer", "orders")
    return spark.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1)")


@query("multi_key_sort_top15", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 15")
def multi_key_sort_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy(F.desc("o_orderpriority"), "o_totalprice", "o_orderkey").limit(15)


@query(
    "concat_coalesce_literal",
    "SELECT c_custkey, c_name || ' ' || c_mktsegment || ' ' || coalesce(CASE WHEN c_acctbal < 0 THEN 'debtor' END, '') AS full_name, 'customer' AS role FROM customer",
)
def concat_coalesce_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").withColumn("_note", F.when(F.col("c_acctbal") < 0, "debtor"))
    return named.select("c_custkey", relational.full_name("c_name", "c_mktsegment", "_note").alias("full_name"), F.lit("customer").alias("role"))


CHANGES = "SELECT doc_id, 1 - coalesce(quality, 0) AS quality, 2 AS toxic FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT d.doc_id, 1, 0 FROM documents d WHERE d.lang = 'de' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


@query("upsert_labels", f"SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN t.quality ELSE s.quality END AS quality, CASE WHEN s.doc_id IS NULL THEN t.toxic ELSE s.toxic END AS toxic FROM labels t FULL OUTER JOIN ({CHANGES}) s ON s.doc_id = t.doc_id")
def upsert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    changed = labels.filter("doc_id % 3 = 0").select("doc_id", (1 - F.coalesce("quality", F.lit(0))).cast("int").alias("quality"), F.lit(2).alias("toxic"))
    added = joins.without(docs.filter("lang = 'de'").select("doc_id"), labels, ["doc_id"]).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return dml.upserted(labels, changed.unionAll(added), ["doc_id"])


@query(
    "update_by_lookup",
    "SELECT c_custkey, CASE WHEN c_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def update_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = table(spark, sf_dir, "nation").filter("n_regionkey = 2").agg(F.min("n_nationkey"))
    customers = joins.looked_up(table(spark, sf_dir, "customer"), key, "_key")
    return dml.updated(customers, F.col("c_nationkey") == F.col("_key"), c_acctbal=F.col("c_acctbal") + 100).select("c_custkey", "c_acctbal")


@query("delete_by_lookup", "SELECT l.* FROM labels l WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id IS NOT NULL)")
def delete_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("source = 'src3'"), ["doc_id"])


@query("serial_insert", "SELECT row_number() OVER (ORDER BY name) AS id, name, value FROM (SELECT s_name AS name, s_nationkey AS value FROM supplier UNION ALL SELECT 'Supplier#new', 7)")
def serial_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("value"))
    rows = dml.inserted(suppliers, spark.createDataFrame([("Supplier#new", 7)], suppliers.schema))
    return dml.numbered(rows, ["name"]).select("id", "name", "value")


@query("crud_update_delete", "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'ten' ELSE p_name END AS p_name FROM part WHERE p_size <> 20 OR p_size IS NULL")
def crud_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dml.updated(table(spark, sf_dir, "part"), F.col("p_size") == 10, p_name=F.lit("ten"))
    return dml.deleted(parts, F.col("p_size") == 20).select("p_partkey", "p_name")


@query("view_over_join", "SELECT c_mktsegment, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def view_over_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    dml.create_view(both.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders")), "orders_by_segment")
    return spark.table("orders_by_segment")
