"""Statements with parameters and permissions, tables that are written and read again, and what a session says."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, security
from ..operators import dml, relational
from ..session import checkpoint_dir
from ..sources.tables import table, views
from .registry import query


def fresh(spark: SparkSession) -> tuple[str, str]:
    """Name and shared folder of a new table."""
    name = f"t_{uuid.uuid4().hex}"
    return name, f"{checkpoint_dir(spark)}/{name}"


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


BY_SEGMENT = "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = {0} AND c_acctbal > {1}"


@query("prepared_statement", BY_SEGMENT.format("'BUILDING'", 5000) + " UNION ALL " + BY_SEGMENT.format("'MACHINERY'", 9000))
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement, prepared once and run with two sets of parameters."""
    views(spark, sf_dir, "customer")
    held = api.Statements(spark)
    held.prepare("by_segment", BY_SEGMENT.format("$1", "$2"))
    out = held.execute("by_segment", ["BUILDING", 5000]).unionAll(held.execute("by_segment", ["MACHINERY", 9000]))
    held.free("by_segment")
    return out


@query("typed_params", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'O' OR o_custkey = 13")
def typed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text parameters typed as the client did: digits are numbers."""
    views(spark, sf_dir, "orders")
    return api.execute(spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = $1 AND o_orderstatus = $3 OR o_custkey = $2", ["11", "13", "O"], infer=True)


@query("junior_reads", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def junior_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    return api.execute_as(spark, security.UserSession("ann", "junior", True), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = $1", [1], "nation")


#: Statements with what they do and to which table.
STATEMENTS = (
    ("SELECT 1", "select", None),
    ("WITH x AS (SELECT 1 AS a) SELECT * FROM x", "select", None),
    ("WITH x AS (SELECT 1 AS a) INSERT INTO field_comprehensions SELECT * FROM x", "insert", "field_comprehensions"),
    ("/* note */ DELETE FROM field_comprehensions WHERE mark = 2", "delete", "field_comprehensions"),
    ("-- note\nUPDATE Field_Comprehensions SET mark = 5", "update", "field_comprehensions"),
    ("UPDATE students SET last_name = 'x'", "update", "students"),
    ("FROM students INSERT INTO copies SELECT *", "insert", "copies"),
    ("MERGE INTO field_comprehensions USING s ON s.a = field_comprehensions.a WHEN MATCHED THEN DELETE", "update", "field_comprehensions"),
    ("DROP TABLE students", "ddl", None),
    ("CREATE TABLE z AS SELECT 1 AS a", "ddl", None),
)
STATEMENT_ROWS = ", ".join(f"({quoted(s)}, {quoted(o)}, {quoted(t)})" for s, o, t in STATEMENTS)


@query(
    "statement_permissions",
    f"""
SELECT statement, operation, target, role, role = 'admin' OR operation = 'select' OR (role = 'user' AND operation IN ('update', 'delete') AND target = 'field_comprehensions') IS TRUE AS allowed
FROM (VALUES {STATEMENT_ROWS}) s(statement, operation, target), (VALUES ('admin'), ('junior'), ('user')) r(role)
""",
)
def statement_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Spark's parser finds each statement to do, and the decision for each role."""
    rows = []
    for statement, *_ in STATEMENTS:
        ((operation, target),) = api.targets(spark, statement) or [("select", None)]
        rows += [(statement, operation, target, role, security.has_permission(security.UserSession("u", role, True), operation, target)) for role in ("admin", "junior", "user")]
    return spark.createDataFrame(rows, "statement string, operation string, target string, role string, allowed boolean")


ATTACKS = ("' OR '1'='1", "' OR 1=1 --", "x' UNION SELECT c_name FROM customer WHERE '1'='1")


@query(
    "injection_demo",
    f"""
SELECT attack, CASE WHEN attack LIKE 'x%' THEN (SELECT count(DISTINCT c_name) FROM customer) ELSE (SELECT count(*) FROM customer) END AS interpolated, 0 AS bound, true AS flagged
FROM (VALUES {", ".join(f"({quoted(a)})" for a in ATTACKS)}) a(attack)
""",
)
def injection_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an attack in a name gives where it becomes part of the statement, and where it is bound."""
    views(spark, sf_dir, "customer")
    out = None
    for attack in ATTACKS:
        into = spark.sql(f"SELECT c_name FROM customer WHERE c_name = '{attack}'").agg(F.count(F.lit(1)).alias("interpolated"))
        bound = api.execute(spark, "SELECT c_name FROM customer WHERE c_name = $1", [attack]).agg(F.count(F.lit(1)))
        row = into.select(F.lit(attack).alias("attack"), "interpolated", bound.scalar().cast("int").alias("bound"), F.lit(api.looks_injected(attack)).alias("flagged"))
        out = row if out is None else out.unionAll(row)
    return out


def register(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, priorities and orders in the shape of students, fields and marks."""
    k = F.col("c_custkey")
    students = table(spark, sf_dir, "customer").select(k.alias("student_id"), F.col("c_name").alias("last_name"), F.col("c_mktsegment").alias("first_name"), F.lit(None).cast("string").alias("patronymic"), F.col("c_nationkey").alias("students_group_number"))
    orders = table(spark, sf_dir, "orders")
    comprehensions = orders.select(F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("field"), (F.col("o_orderkey") % 4 + 2).cast("int").alias("mark"))
    fields = orders.select(F.col("o_orderpriority").alias("field_id")).distinct().withColumn("field_name", F.upper("field_id"))
    return students, fields, comprehensions


@query("student_grades", "SELECT upper(o_orderpriority) AS field_name, cast(o_orderkey % 4 + 2 AS int) AS mark FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey = 7")
def student_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    students, fields, comprehensions = register(spark, sf_dir)
    return relational.grades_of(students, comprehensions, fields, 7)


@query("search_student_grades", "SELECT c_name AS last_name, c_mktsegment AS first_name, upper(o_orderpriority) AS field_name, cast(o_orderkey % 4 + 2 AS int) AS mark FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name LIKE '%00_3%'")
def search_student_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    students, fields, comprehensions = register(spark, sf_dir)
    return relational.search_grades(students, comprehensions, fields, "00_3")


@query(
    "best_students_by_group",
    """
SELECT c_custkey AS student_id, c_name || ' ' || c_mktsegment || ' ' AS full_name, c_nationkey AS students_group_number, cast(round(cast(avg(o_orderkey % 4 + 2) AS decimal(38,10)), 2) AS double) AS average_mark, count(*) AS marks_count
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey < 3 GROUP BY ALL HAVING avg(o_orderkey % 4 + 2) >= 4
""",
)
def best_students_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    students, _, comprehensions = register(spark, sf_dir)
    groups = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("students_group_number"))
    return relational.best_with_groups(students, groups, comprehensions).withColumn("average_mark", F.col("average_mark").cast("double"))


@query(
    "role_detection",
    """
SELECT username, is_super, CASE WHEN is_super OR contains(username, 'admin') OR contains(username, 'Admin') THEN 'admin' WHEN contains(username, 'junior') OR contains(username, 'Junior') THEN 'junior' ELSE 'user' END AS role
FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'admin_' WHEN 1 THEN 'theJunior' WHEN 2 THEN 'JUNIOR' ELSE '' END || c_name AS username, c_custkey % 11 = 0 AS is_super FROM customer)
""",
)
def role_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lead = F.when(k % 5 == 0, "admin_").when(k % 5 == 1, "theJunior").when(k % 5 == 2, "JUNIOR").otherwise("")
    users = table(spark, sf_dir, "customer").select(F.concat(lead, F.col("c_name")).alias("username"), (k % 11 == 0).alias("is_super"))
    return users.withColumn("role", security.role_of(F.col("username"), F.col("is_super")))


JOINED = "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0"


@query("insert_select_join", f"{JOINED} UNION ALL SELECT -1, 'first', 0.5")
def insert_select_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a join put into a table that has a row already."""
    name, path = fresh(spark)
    dml.create_table(spark, name, "o_orderkey long, c_name string, o_totalprice double", path=path)
    api.execute(spark, f"INSERT INTO {name} VALUES ($1, $2, $3)", [-1, "first", 0.5])
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"))
    dml.insert_joined(spark, name, joined)
    return spark.table(name)


@query("sorted_rewrite", "SELECT o_custkey, o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def sorted_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables rewritten by the key of their join, which then needs no shuffle."""
    (orders, at), (customers, there) = fresh(spark), fresh(spark)
    dml.write_sorted(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), orders, "o_custkey", path=at)
    dml.write_sorted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), customers, "o_custkey", path=there)
    both = spark.table(orders).join(spark.table(customers), "o_custkey")
    return both.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_custkey", "o_orderkey", "n_name")


@query("truncate_table", "SELECT (SELECT count(*) FROM nation) AS before, 0 AS after, (SELECT count(*) FROM nation) AS refilled")
def truncate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = fresh(spark)
    dml.create_table(spark, name, "n_nationkey long, n_name string", path=path)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    dml.insert_joined(spark, name, rows)
    before = spark.table(name).count()
    dml.truncate(spark, name)
    after = spark.table(name).count()
    dml.insert_joined(spark, name, rows)
    return spark.table(name).agg(F.count(F.lit(1)).alias("refilled")).select(F.lit(before).cast("long").alias("before"), F.lit(after).cast("int").alias("after"), "refilled")


@query("materialised_view", "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY 1")
def materialised_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view's rows as they were when the table was made: the view changes afterwards, the table doesn't."""
    name, path = fresh(spark)
    dml.create_view(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers")), name)
    made = dml.materialise(spark, name, path)
    dml.create_view(spark.range(0).select(F.lit("none").alias("c_mktsegment"), F.col("id").alias("customers")), name)
    dml.materialise(spark, name, path)  # there already
    dml.drop_view(spark, name)
    return spark.table(made)


@query("dropped_view", "SELECT true AS dropped, false AS dropped_again, false AS there")
def dropped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, _ = fresh(spark)
    dml.create_view(table(spark, sf_dir, "region"), name)
    row = dml.drop_view(spark, name), dml.drop_view(spark, name), spark.catalog.tableExists(name)
    return spark.createDataFrame([row], "dropped boolean, dropped_again boolean, there boolean")


COUNTS = "(SELECT count(*) FROM labels WHERE quality = 1) AS labels, (SELECT count(*) + 1 FROM nation) AS nations"


@query("transaction_outcomes", f"SELECT 'committed' AS outcome, {COUNTS} UNION ALL SELECT 'rolled back', {COUNTS}")
def transaction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views changed together, and then a change that an error takes back."""
    (labels, _), (nations, _) = fresh(spark), fresh(spark)
    dml.create_view(table(spark, sf_dir, "labels"), labels)
    dml.create_view(table(spark, sf_dir, "nation").select("n_name"), nations)

    def seen(outcome: str) -> DataFrame:
        count = lambda v: spark.table(v).agg(F.count(F.lit(1)))
        return count(labels).toDF("labels").select(F.lit(outcome).alias("outcome"), "labels", count(nations).scalar().alias("nations"))

    with dml.Transaction(spark, labels, nations) as change:
        change.apply(labels, lambda df: dml.deleted(df, F.coalesce(F.col("quality") != 1, F.lit(True))))
        change.apply(nations, lambda df: dml.inserted(df, spark.createDataFrame([("Atlantis",)], "n_name string")))
    first = seen("committed")
    try:
        with dml.Transaction(spark, labels, nations) as change:
            change.apply(labels, lambda df: df.limit(0))
            raise ValueError("taken back")
    except ValueError:
        pass
    return first.unionAll(seen("rolled back"))


CTE = "WITH mean AS (SELECT o_custkey, avg(o_totalprice) AS average FROM orders GROUP BY o_custkey) SELECT c_custkey, round(average, 6) AS average FROM mean JOIN customer ON c_custkey = o_custkey WHERE average > 200000"


@query("cte_average", CTE)
def cte_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "customer")
    return api.execute(spark, CTE)


@query("limit_any", 'SELECT count(*) AS "rows", 15 AS most, count(*) = least(15, (SELECT count(*) FROM orders)) AS filled FROM (SELECT * FROM orders LIMIT 15)')
def limit_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT without an order: any rows, but as many."""
    orders = table(spark, sf_dir, "orders")
    there = orders.agg(F.count(F.lit(1))).scalar()
    return orders.limit(15).agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(15).alias("most"), (F.col("rows") == F.least(F.lit(15), there)).alias("filled"))


@query("server_version", "SELECT length(version()) > 0 AS known")
def server_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.execute(spark, "SELECT version() AS version").select((F.length("version") > 0).alias("known"))


@query(
    "text_table",
    """
WITH w AS (SELECT greatest(max(length(cast(n_nationkey AS varchar))), 11) AS a, greatest(max(length(n_name)), 6) AS b FROM nation)
SELECT true AS head, rpad('n_nationkey', a::int, ' ') || ' | ' || rpad('n_name', b::int, ' ') AS line FROM w
UNION ALL SELECT false, rpad(cast(n_nationkey AS varchar), a::int, ' ') || ' | ' || rpad(n_name, b::int, ' ') FROM nation, w
""",
)
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.text_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
