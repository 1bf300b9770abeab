"""Scalar functions, partial aggregates, strings, addresses and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import security
from ..functions import numbers as N
from ..functions import strings as S
from ..operators import aggregates, joins
from ..sources import generators
from ..sources.tables import spread, table
from .registry import query


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("min_max", "SELECT min(l_partkey) AS min, max(l_partkey) AS max FROM lineitem")
def min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.min_max(lines(spark, sf_dir), "l_partkey")


@query("sum_all", "SELECT cast(sum(l_orderkey) AS bigint) AS total, round(sum(l_extendedprice), 2) AS price FROM lineitem")
def sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).agg(F.sum("l_orderkey").alias("total"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("int_mean", "SELECT count(l_partkey) AS count, cast(sum(l_partkey) // count(l_partkey) AS bigint) AS mean FROM lineitem")
def int_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.int_mean(lines(spark, sf_dir), "l_partkey")


@query("factorial_mod", "SELECT k, list_reduce(list_prepend(1::HUGEINT, range(1, k + 1)::HUGEINT[]), lambda a, x: (a * x) % 1000000007)::bigint AS residue FROM (SELECT unnest(range(1, 201)) AS k)")
def factorial_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 201).select(F.col("id").alias("k"), N.factorial_mod(F.col("id"), F.lit(1000000007)).alias("residue"))


@query("factorial_mod_distributed", "SELECT 100000 AS k, list_reduce(range(1, 100001)::HUGEINT[], lambda a, x: (a * x) % 998244353)::bigint AS residue")
def factorial_mod_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.product_mod(spark.range(1, 100001), "id", 998244353).select(F.lit(100000).cast("long").alias("k"), F.col("product").alias("residue"))


@query("mul_mod", "SELECT o_orderkey, cast((o_orderkey::HUGEINT * 6364136223846793005) % 2305843009213693951 AS bigint) AS residue FROM orders")
def mul_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.mul_mod(F.col("o_orderkey"), F.lit(6364136223846793005), F.lit(2305843009213693951)).cast("long").alias("residue"))


@query("harmonic", "SELECT round(sum(1.0::DOUBLE / i), 9) AS harmonic FROM range(1, 1000001) t(i)")
def harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.harmonic(spark, 1_000_000).select(F.round("harmonic", 9).alias("harmonic"))


@query(
    "bit_ops",
    """
SELECT l_orderkey, l_linenumber, x * 2 AS mul2, x // 2 AS div2, ((x % 16) + 16) % 16 AS mod16, x & (-16) AS down16, x << 3 AS shl3, x >> 1 AS shr1, x & 15 AS low4
FROM (SELECT l_orderkey, l_linenumber, l_partkey AS x FROM lineitem)
""",
)
def bit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_partkey")
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", (x * 2).alias("mul2"), F.expr("l_partkey div 2").alias("div2"), F.pmod(x, F.lit(16)).alias("mod16"), x.bitwiseAND(F.lit(-16)).alias("down16"),
        F.shiftleft(x, 3).alias("shl3"), F.shiftright(x, 1).alias("shr1"), x.bitwiseAND(F.lit(15)).alias("low4"),
    )


@query("round_to_multiple", "SELECT l_orderkey, l_linenumber, (l_partkey & 65535) & (-32) AS down, ((l_partkey & 65535) + 31) & 65535 & (-32) AS up FROM lineitem")
def round_to_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_partkey")
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", N.round_down(x, 32).alias("down"), N.round_up(x, 32).alias("up"))


@query(
    "affine_piecewise",
    """
SELECT l_orderkey, l_linenumber, x + 8 * y - 7 AS f1, x - y AS f2, CASE WHEN x <= 12 THEN 1 ELSE 0 END AS le12, CASE WHEN x - 4 - 2 < -2 THEN 25 ELSE x - 4 - 2 END AS z, x + x * y - 7 AS xy, 5 * x + 5 AS five
FROM (SELECT l_orderkey, l_linenumber, l_linenumber::bigint AS x, l_suppkey AS y FROM lineitem)
""",
)
def affine_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_linenumber").cast("long"), F.col("l_suppkey")
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", (x + 8 * y - 7).alias("f1"), (x - y).alias("f2"), (x <= 12).cast("int").alias("le12"), N.piecewise(x - 4).alias("z"), (x + x * y - 7).alias("xy"), (5 * x + 5).alias("five")
    )


@query("div_mod", "SELECT l_orderkey, l_linenumber, -l_partkey // d AS q, -l_partkey % d AS r, ((4294967296 - l_partkey) % 4294967296) // d AS uq, ((4294967296 - l_partkey) % 4294967296) % d AS ur FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber - 3 END AS d FROM lineitem WHERE l_linenumber > 3)")
def div_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir).filter("l_linenumber > 3").withColumns({"x": -F.col("l_partkey"), "d": F.col("l_linenumber") - 3}).withColumn("u", N.unsigned(F.col("x"), 32))
    return x.select("l_orderkey", "l_linenumber", F.expr("x div d").alias("q"), F.expr("x % d").alias("r"), F.expr("u div d").alias("uq"), F.expr("u % d").alias("ur"))


@query(
    "div_mod_all",
    """
SELECT l_orderkey, l_linenumber, -l_partkey // d AS q, -l_partkey % d AS r, (-l_partkey & 4294967295) // (d & 4294967295) AS uq, (-l_partkey & 4294967295) % (d & 4294967295) AS ur
FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_linenumber::bigint - 3 END AS d FROM lineitem)
""",
)
def div_mod_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As div_mod, of every row: null where the divisor is zero, which the reference's instructions trap."""
    d = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("long") - 3)
    x = lines(spark, sf_dir).withColumns({"x": -F.col("l_partkey").cast("long"), "d": d}).withColumns({"u": N.unsigned(F.col("x"), 32), "v": N.unsigned(F.col("d"), 32)})
    return x.select("l_orderkey", "l_linenumber", F.expr("x div d").alias("q"), F.expr("x % d").alias("r"), F.expr("u div v").alias("uq"), F.expr("u % v").alias("ur"))


@query("float_formula", "SELECT l_orderkey, l_linenumber, round(x / 3 + 2 / y - x * y, 6) + 0.0 AS f, round(pow(x, 2), 6) AS p, abs(y - 1000) AS a FROM (SELECT *, l_quantity AS x, l_extendedprice AS y FROM lineitem)")
def float_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(x / 3 + 2 / y - x * y, 6).alias("f"), F.round(F.pow(x, F.lit(2)), 6).alias("p"), F.abs(y - 1000).alias("a"))


@query(
    "representations",
    """
SELECT x, lpad(upper(to_hex(x & 65535)), 4, '0') AS hex16, lpad(to_binary(x & 65535), 16, '0') AS bin16, x & 65535 AS unsigned16, CASE WHEN x & 65535 >= 32768 THEN (x & 65535) - 65536 ELSE x & 65535 END AS signed16,
  x & 4294967295 AS unsigned32, lpad(upper(to_hex(x & 4294967295)), 8, '0') AS hex32 FROM (SELECT DISTINCT l_partkey - 1000 AS x FROM lineitem)
""",
)
def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return lines(spark, sf_dir).select((F.col("l_partkey") - 1000).alias("x")).distinct().select(
        "x", N.as_hex(x, 16).alias("hex16"), N.as_binary(x, 16).alias("bin16"), N.unsigned(x, 16).alias("unsigned16"), N.signed(x, 16).alias("signed16"), N.unsigned(x, 32).alias("unsigned32"), N.as_hex(x, 32).alias("hex32")
    )


@query(
    "arrays",
    """
SELECT n_nationkey, n_nationkey * n_nationkey AS odd_sum, CASE WHEN n_nationkey > 0 THEN 2 * n_nationkey - 1 END AS last_odd, [[1, 2], [3, 4]][2][1] * 0 + CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE 7 END AS filled FROM nation
""",
)
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    odd = N.odd_sequence(n)
    matrix = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(7)))
    filled = N.fill_row(matrix, n % 2)  # row 0 or 1 becomes -1, -1
    total = N.array_sum(F.transform(filled, lambda r: N.array_sum(r, F.lit(0))), F.lit(0))
    return table(spark, sf_dir, "nation").select(
        n, N.array_sum(odd, F.lit(0)).alias("odd_sum"), F.when(n > 0, F.element_at(odd, -1)).alias("last_odd"),
        F.when(total == 8, 7).when(total == 1, 1).alias("filled"),
    )


@query("add_overflow", "SELECT o_orderkey, o_orderkey + 2147480000 > 2147483647 AS overflow FROM orders WHERE o_orderkey <= 2147483647")
def add_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey <= 2147483647").select("o_orderkey", N.overflows(F.col("o_orderkey"), F.lit(2147480000)).alias("overflow"))


@query("crc32_docs")
def crc32_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("reverse_text", "SELECT doc_id, md5(array_to_string(list_reverse(string_split(text, '')), '')) AS reversed FROM documents")
def reverse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.reverse("text").cast("binary")).alias("reversed"))


QUOTED = "'it''s ' || lang || ' ''' || source || ''''"


@query("quoting", f"SELECT doc_id, replace({QUOTED}, '''', '`') AS ticked, replace({QUOTED}, '''', '''''') AS doubled, substr(replace({QUOTED}, '''', ''''''), 1, 9) AS cut FROM documents")
def quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("it's "), "lang", F.lit(" '"), "source", F.lit("'"))
    return table(spark, sf_dir, "documents").select("doc_id", S.backticks(s).alias("ticked"), S.doubled_quotes(s).alias("doubled"), S.doubled_quotes(s, 10).alias("cut"))


INJECTIONS = " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in S.INJECTION)


@query("injection_flags", f"SELECT doc_id, {INJECTIONS} OR contains(regexp_replace(regexp_replace(text, '\\\\''', '', 'g'), '''[^'']*(''|$)', '', 'g'), ';') AS flagged FROM documents")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", S.is_injection(F.col("text")).alias("flagged"))


@query("parameter_types", "SELECT DISTINCT s, CASE WHEN regexp_full_match(s, '-?[0-9]*') THEN 23 ELSE 25 END AS oid FROM (SELECT cast(l_orderkey AS varchar) AS s FROM lineitem UNION ALL SELECT l_returnflag FROM lineitem UNION ALL SELECT cast(-l_linenumber AS varchar) FROM lineitem UNION ALL SELECT cast(l_linenumber AS varchar) || '.5' FROM lineitem UNION ALL SELECT '')")
def parameter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir)
    s = l.select(F.explode(F.array(F.col("l_orderkey").cast("string"), "l_returnflag", (-F.col("l_linenumber")).cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".5")), F.lit(""))).alias("s")).distinct()
    return s.select("s", S.parameter_type(F.col("s")).alias("oid"))


SERVERS = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nohost' WHEN 2 THEN c_name || ':' || (c_custkey * 997) ELSE c_name || ':x' || c_custkey END AS s FROM customer"


@query("host_port_parse", f"SELECT c_custkey, split_part(s, ':', 1) AS host, try_cast(split_part(s, ':', 2) AS int) AS port FROM ({SERVERS}) WHERE contains(s, ':') AND try_cast(split_part(s, ':', 2) AS int) BETWEEN 1 AND 65535")
def host_port_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = F.when(k % 5 == 0, "").when(k % 5 == 1, "nohost").when(k % 5 == 2, F.concat("c_name", F.lit(":"), (k * 997).cast("string"))).otherwise(F.concat("c_name", F.lit(":x"), k.cast("string")))
    return generators.servers(table(spark, sf_dir, "customer").select("c_custkey", s.alias("value"))).select("c_custkey", "host", "port")


@query("uint64_parse", "SELECT doc_id, CASE WHEN regexp_full_match(s, '[0-9]{1,20}') THEN CASE WHEN cast(s AS hugeint) <= 18446744073709551615 THEN cast(cast(s AS hugeint) AS varchar) END END AS value FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1844674407370955' || (1500 + doc_id) WHEN doc_id % 3 = 1 THEN cast(doc_id AS varchar) ELSE '-' || doc_id END AS s FROM documents)")
def uint64_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    s = F.when(k % 3 == 0, F.concat(F.lit("1844674407370955"), (1500 + k).cast("string"))).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("-"), k.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", N.uint64(s).cast("string").alias("value"))


@query(
    "url_paths",
    """
SELECT page_id, split_part(url, '/', -1) AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS rest,
  (split_part(url, '/', -1) IN ('.DS_Store', 'Thumbs.db')) OR suffix(url, '~') OR suffix(url, '.tmp') AS excluded FROM pages
""",
)
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.file_name(url).alias("name"), S.parent(url).alias("parent"), S.relative(url, F.lit("http://")).alias("rest"), S.is_excluded(S.file_name(url)).alias("excluded"))


@query("log_lines", "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || event_type || '] user ' || user_id AS line FROM events")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.log_line(F.col("ts"), F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("line"))


@query(
    "permission_matrix",
    """
SELECT role, authenticated, operation, target, authenticated AND (role = 'admin' OR (role IN ('junior', 'user') AND operation = 'select') OR (role = 'user' AND operation IN ('update', 'delete') AND target = 'field_comprehensions')) IS TRUE AS allowed
FROM (VALUES ('admin'), ('junior'), ('user'), ('none')) r(role), (VALUES (true), (false)) a(authenticated), (VALUES ('select'), ('insert'), ('update'), ('delete'), ('ddl')) o(operation), (VALUES ('students'), ('field_comprehensions'), (NULL)) t(target)
""",
)
def permission_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.permissions(spark)


@query("generated_join", "SELECT 1250 AS a_rows, 1250 AS b_rows, true AS keys_ok, true AS values_ok")
def generated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = generators.table_a(spark, 1250, seed=1), generators.table_b(spark, 1250, seed=2)
    x = a.agg(F.count(F.lit(1)).cast("int").alias("a_rows"), F.min(F.col("KeyField").rlike("^[A-E]{2}$") & F.col("Value1").between(1, 99)).alias("ka"))
    y = b.agg(F.count(F.lit(1)).cast("int").alias("b_rows"), F.min(F.col("KeyField").rlike("^[A-E]{2}$")).alias("kb"), F.min(F.col("Value3").between(1, 99) & F.col("Value4").isNotNull()).alias("vb"))
    return x.join(y, F.lit(True)).select("a_rows", "b_rows", (F.col("ka") & F.col("kb")).alias("keys_ok"), F.col("vb").alias("values_ok"))


@query(
    "plain_scalars",
    """
SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS sum2, l_linestatus AS first, l_returnflag AS second, l_returnflag || '+' || l_linestatus AS pair, l_quantity - l_discount AS difference, 5 AS eighth
FROM lineitem
""",
)
def plain_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of two numbers, two texts swapped, a pair of texts in one, a difference of doubles, the eighth of eight arguments."""
    first, second = S.swapped(F.col("l_returnflag"), F.col("l_linestatus"))
    eighth = F.get(F.array(*[F.lit(k) for k in (1, 2, 3, 4, 8, 7, 6, 5)]), F.lit(7))
    return lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_partkey")).alias("sum2"), first.alias("first"), second.alias("second"),
        F.concat("l_returnflag", F.lit("+"), "l_linestatus").alias("pair"), (F.col("l_quantity") - F.col("l_discount")).alias("difference"), eighth.alias("eighth"),
    )


@query(
    "bit_ops_signed",
    """
SELECT l_orderkey, l_linenumber, x * 2 AS mul2, x // 2 AS div2, (x & 4294967295) // 2 AS unsigned_div2, x % 16 AS rem16, (x & 4294967295) % 16 AS mod16, x & (-16) AS down16, x >> 1 AS shr1, (x & 4294967295) >> 1 AS unsigned_shr1
FROM (SELECT l_orderkey, l_linenumber, (l_partkey - 1000)::bigint AS x FROM lineitem)
""",
)
def bit_ops_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of ``bit_ops`` on values of either sign, signed and as 32 unsigned bits."""
    df = lines(spark, sf_dir).withColumn("x", F.col("l_partkey").cast("long") - 1000)
    df = df.withColumn("u", N.unsigned(F.col("x"), 32))
    return df.select(
        "l_orderkey", "l_linenumber", F.expr("x * 2").alias("mul2"), F.expr("x div 2").alias("div2"), F.expr("u div 2").alias("unsigned_div2"), F.expr("x % 16").alias("rem16"), F.expr("u % 16").alias("mod16"),
        F.expr("x & -16L").alias("down16"), F.shiftright("x", 1).alias("shr1"), F.shiftright("u", 1).alias("unsigned_shr1"),
    )


@query("array_sum_double", "SELECT c_custkey, round(list_sum([c_acctbal, c_acctbal / 3, -0.125, 0.5::DOUBLE]), 6) + 0.0 AS total, list_sum([c_custkey, -c_nationkey, 7]) AS whole FROM customer")
def array_sum_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    total = N.array_sum(F.array(x, x / 3, F.lit(-0.125), F.lit(0.5)), F.lit(0.0))
    whole = N.array_sum(F.array(F.col("c_custkey").cast("long"), -F.col("c_nationkey").cast("long"), F.lit(7).cast("long")), F.lit(0).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.round(total, 6) + 0.0).alias("total"), whole.alias("whole"))


@query(
    "harmonic_orders",
    """
SELECT n, round(list_reduce(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i), lambda a, x: a + x), 9) AS forward, round(list_reduce(list_transform(range(n, 0, -1), lambda i: 1.0::DOUBLE / i), lambda a, x: a + x), 9) AS backward,
  round(list_reduce(list_transform(range(1, n + 1), lambda i: 1.0::FLOAT / i::FLOAT), lambda a, x: (a + x)::FLOAT)::DOUBLE, 7) AS single, round(list_reduce(list_transform(range(n, 0, -1), lambda i: 1.0::FLOAT / i::FLOAT), lambda a, x: (a + x)::FLOAT)::DOUBLE, 7) AS single_backward
FROM (VALUES (1), (10), (1000), (20000)) t(n)
""",
)
def harmonic_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered sums in both directions and precisions, which round differently."""
    out = None
    for n in (1, 10, 1000, 20000):
        sums = {"forward": (False, False, 9), "backward": (True, False, 9), "single": (False, True, 7), "single_backward": (True, True, 7)}
        row = spark.range(1).select(F.lit(n).alias("n"), *[F.round(aggregates.harmonic_in_order(n, back, single).cast("double"), places).alias(name) for name, (back, single, places) in sums.items()])
        out = row if out is None else out.unionAll(row)
    return out


@query("representations64", "SELECT o_orderkey, lpad(upper(to_hex(x)), 16, '0') AS hex64, lpad(to_binary(x), 64, '0') AS bin64, x AS signed64, cast(CASE WHEN x < 0 THEN x::HUGEINT + 18446744073709551616 ELSE x END AS varchar) AS unsigned64, chr((65 + o_orderkey % 26)::int) AS letter FROM (SELECT o_orderkey, (o_orderkey - 20000) * 100000000003 AS x FROM orders)")
def representations64(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    wide = x.cast("decimal(21,0)")
    unsigned = F.when(x < 0, wide + F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(wide)
    df = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey").cast("long") - 20000) * 100000000003).alias("x"))
    return df.select("o_orderkey", F.lpad(F.hex(x), 16, "0").alias("hex64"), F.lpad(F.bin(x), 64, "0").alias("bin64"), x.alias("signed64"), unsigned.cast("decimal(20,0)").cast("string").alias("unsigned64"), F.char(65 + F.col("o_orderkey") % 26).alias("letter"))


@query("double_views", "SELECT c_custkey, c_acctbal AS value, c_acctbal < 0 AS negative, CASE WHEN c_acctbal = 0 THEN NULL ELSE floor(log2(abs(c_acctbal)))::int END AS power FROM customer")
def double_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles taken apart into their bits and put together again."""
    parts = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal").isNotNull(), N.double_parts("c_acctbal")).alias("p"))
    return parts.select("c_custkey", N.from_parts(F.col("p")).alias("value"), N.is_negative(F.col("p")).alias("negative"), N.power_of(F.col("p")).alias("power"))


@query("numeric_limits", "SELECT * FROM (VALUES ('char', 1, -128::bigint, 127::bigint, '255'), ('short', 2, -32768, 32767, '65535'), ('int', 4, -2147483648, 2147483647, '4294967295'), ('long', 8, (-9223372036854775807 - 1)::bigint, 9223372036854775807, '18446744073709551615')) t(name, bytes, least, most, most_unsigned)")
def numeric_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(N.limits(), "name string, bytes int, least long, most long, most_unsigned string")


@query("shared_counter", "SELECT count(*) AS counter FROM (SELECT * FROM range(50) UNION ALL SELECT * FROM range(50))")
def shared_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.shared_count(spark, 2, 50)


TYPED = "(l_partkey * 40) || ' ' || (l_orderkey * 100000) || '  ' || CASE l_linenumber % 3 WHEN 0 THEN '18446744073709551616' WHEN 1 THEN '18446744073709551615' ELSE 'x' END || ' ' || l_discount || ' ' || l_extendedprice"


@query(
    "typed_scan",
    f"""
SELECT l_orderkey, l_linenumber, CASE WHEN a < 65536 THEN a::int END AS hu, CASE WHEN b < 4294967296 THEN b::bigint END AS u, CASE WHEN c <= 18446744073709551615 THEN c::varchar END AS llu, round(d::float::double, 5) AS f, e AS lf
FROM (SELECT l_orderkey, l_linenumber, try_cast(p[1] AS hugeint) AS a, try_cast(p[2] AS hugeint) AS b, try_cast(p[3] AS hugeint) AS c, try_cast(p[4] AS double) AS d, try_cast(p[5] AS double) AS e FROM (SELECT *, regexp_split_to_array(trim({TYPED}), '\\s+') AS p FROM lineitem))
""",
)
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five typed values."""
    text = lambda c: F.col(c).cast("string")
    third = F.when(F.col("l_linenumber") % 3 == 0, "18446744073709551616").when(F.col("l_linenumber") % 3 == 1, "18446744073709551615").otherwise("x")
    line = F.concat_ws(" ", (F.col("l_partkey") * 40).cast("string"), (F.col("l_orderkey") * 100000).cast("string"), F.lit(""), third, text("l_discount"), text("l_extendedprice"))
    df = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", S.typed_fields(line).alias("v"))
    return df.select("l_orderkey", "l_linenumber", "v.hu", "v.u", F.col("v.llu").cast("string").alias("llu"), F.round(F.col("v.f").cast("double"), 5).alias("f"), "v.lf")


LEVEL = "CASE event_id % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' ELSE 'TRACE' END"


@query("log_threshold", f"SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || {LEVEL} || '] ' || event_type AS line FROM events WHERE {LEVEL} IN ('WARNING', 'ERROR')")
def log_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("level", F.expr(LEVEL))
    return events.filter(S.at_level(F.col("level"), "WARNING")).select("event_id", S.log_line(F.col("ts"), F.col("level"), F.col("event_type")).alias("line"))


GENERATED = """
SELECT a.k AS "KeyField", count(*) AS pairs, sum(a.v * b.v)::bigint AS total FROM
  (SELECT chr((65 + id % 5)::int) || chr((65 + id // 5 % 5)::int) AS k, id % 99 + 1 AS v FROM range(1250) t(id)) a
  JOIN (SELECT chr((65 + id % 5)::int) || chr((65 + id // 5 % 5)::int) AS k, id % 97 + 1 AS v FROM range(1250) t(id)) b ON a.k = b.k GROUP BY 1
"""


@query("keyed_join", GENERATED)
def keyed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket join of two made tables over the 25 keys of two letters, by key."""
    key = F.concat(F.char(65 + F.col("id") % 5), F.char(65 + F.expr("id div 5") % 5)).alias("KeyField")
    a = spark.range(1250).select(key, (F.col("id") % 99 + 1).alias("Value1"), F.lit("a").alias("Description"))
    b = spark.range(1250).select(key, (F.col("id") % 97 + 1).alias("Value3"), F.lit("b").alias("Status"))
    return joins.bucket_join(a, b).groupBy("KeyField").agg(F.count(F.lit(1)).alias("pairs"), F.sum("TotalValue").alias("total"))
