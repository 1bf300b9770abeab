"""Operators on small fixtures with known results, and what must not happen."""

import math
import os
import socket
import struct
import time

import pytest
from pyspark.sql import functions as F

from quarry import api, security
from quarry.functions import bytes as B
from quarry.functions import numbers as N
from quarry.functions import strings as S
from quarry.operators import aggregates, dml, joins, relational
from quarry.session import workers
from quarry.sources import archive, files, generators


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# joins


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([("AA", 1, "d"), ("AA", 2, "d"), ("AB", 9, "d"), (None, 4, "d")], "KeyField string, Value1 int, Description string")
    b = spark.createDataFrame([("AA", 3, "x"), ("AA", 5, "y"), ("AC", 7, "z"), (None, 1, "n")], "KeyField string, Value3 int, Status string")
    return a, b


@pytest.mark.parametrize("strategy", ["auto", "merge", "hash"])
def test_bucket_join_uses_every_row_of_b(sides, strategy):
    got = rows(joins.bucket_join(*sides, strategy=strategy, partitions=3).select("Value1", "Value3", "TotalValue", "Status"))
    assert got == [(1, 3, 3, "x"), (1, 5, 5, "y"), (2, 3, 6, "x"), (2, 5, 10, "y")]


def test_strategies_are_taken(sides):
    plan = lambda s: joins.bucket_join(*sides, strategy=s)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan("merge") and "ShuffledHashJoin" in plan("hash")


def test_bucket_join_keeps_all_cores_busy(spark):
    from quarry.plans.all_queries import QUERIES

    assert QUERIES["bucket_join"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_bucket_join_sql_sorts_no_pairs(spark):
    from quarry.plans.all_queries import QUERIES

    df = QUERIES["bucket_join_sql"](spark, "/root/testdata/sf0.001")
    keys = [r.KeyField for r in df.collect()]
    assert keys == sorted(keys) and len(keys) == 62
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan.split("Join ")[0]  # nothing above the join


def test_product_does_not_wrap(spark):
    a = spark.createDataFrame([("k", 2**31 - 1, "d")], "KeyField string, Value1 int, Description string")
    b = spark.createDataFrame([("k", 2**31 - 1, "s")], "KeyField string, Value3 int, Status string")
    assert joins.bucket_join(a, b).first().TotalValue == (2**31 - 1) ** 2


def test_bucket_merge(spark):
    master = spark.createDataFrame([(1, "A", 2), (1, "B", 4), (2, "C", 5)], "MKey int, MText string, Num int")
    slave = spark.createDataFrame([(1, "x", 1.5), (1, "y", 2.5), (3, "z", 9.0)], "SKey int, SText string, Num double")
    for merge in (joins.bucket_merge, joins.bucket_merge_direct):
        assert rows(merge(master, slave)) == [(1, 4, 6.0)]


def test_generated_merge_agrees(spark):
    master, slave = generators.master(spark, 40, seed=3), generators.slave(spark, 40, seed=9)
    one = {r.RKey: (r.RText, round(r.NUMAVG, 4)) for r in joins.bucket_merge(master, slave).collect()}
    two = {r.RKey: (r.RText, round(r.NUMAVG, 4)) for r in joins.bucket_merge_direct(master, slave).collect()}
    assert one == two and len(one) == 40 and all(25 <= n <= 225 for n, _ in one.values())


def test_lookup(spark):
    df = spark.range(2)
    assert [r.v for r in joins.looked_up(df, spark.sql("SELECT 7 AS x"), "v").collect()] == [7, 7]
    assert [r.v for r in joins.looked_up(df, spark.sql("SELECT 7 AS x WHERE false"), "v").collect()] == [None, None]


# the register


@pytest.fixture(scope="module")
def register(spark):
    return {
        "students": spark.createDataFrame([(1, "Ivanov", "Ivan", "I.", "IP-31"), (2, "Petrov", "Petr", None, "IP-32"), (3, "Sidorov", "Sid", "S.", "KS-41"), (4, "Orlov", "Oleg", None, "IP-31")], "student_id int, last_name string, first_name string, patronymic string, students_group_number string"),
        "fields": spark.createDataFrame([(10, "OS"), (11, "DB"), (12, "Nets")], "field_id int, field_name string"),
        "marks": spark.createDataFrame([(1, 10, 5), (1, 11, 4), (2, 10, 3), (2, 11, 5), (3, 10, 2), (3, 12, None)], "student_id int, field int, mark int"),
        "professors": spark.createDataFrame([(100, "Smirnov", "Pavel", "P."), (101, "Kim", "Lee", None)], "professor_id int, last_name string, first_name string, patronymic string"),
        "professor_fields": spark.createDataFrame([(100, 10), (100, 11), (101, 12)], "professor_id int, field_id int"),
        "units": spark.createDataFrame([("Boss A",), ("Boss B",)], "head_of_the_unit string"),
    }


def test_roles(register):
    got = relational.roles((register["professors"], relational.full_name(), "lecturer"), (register["units"], F.col("head_of_the_unit"), "head"))
    assert [tuple(r) for r in got.collect()] == [("Boss A", "head"), ("Boss B", "head"), ("Kim Lee ", "lecturer"), ("Smirnov Pavel P.", "lecturer")]


def test_field_averages(register):
    got = relational.field_averages(register["students"], register["marks"], register["fields"], groups=r"^[A-Z]+-3\d$").collect()
    assert [(r.field_name, float(r.average), r.student.split()[0]) for r in got] == [("DB", 4.5, "Ivanov"), ("DB", 4.5, "Petrov"), ("OS", 4.0, "Ivanov"), ("OS", 4.0, "Petrov")]


def test_third_year_pattern(spark):
    df = spark.createDataFrame([("ABC-31",), ("ИП-32",), ("ё-31",), ("ИП-42",), ("ИП-321",)], "g string")
    assert [r.g for r in df.filter(F.col("g").rlike(relational.THIRD_YEAR)).collect()] == ["ABC-31", "ИП-32"]


def test_other_register_queries(register):
    s, m, f = register["students"], register["marks"], register["fields"]
    got = relational.professor_averages(register["professors"], register["professor_fields"], f, m, "%ov%").collect()
    assert [(r.professor, r.field_name, float(r.average)) for r in got] == [("Smirnov Pavel P.", "DB", 4.5), ("Smirnov Pavel P.", "OS", 3.33)]
    assert [r.student_id for r in relational.without_marks(s, m).collect()] == [4]
    assert [(r.student_id, float(r.average), r.marks) for r in relational.best_students(s, m).orderBy("student_id").collect()] == [(1, 4.5, 2), (2, 4.0, 2)]
    assert rows(relational.grades_of(s, m, f, 1)) == [("DB", 4), ("OS", 5)]
    assert len(relational.search_grades(s, m, f, "ov").collect()) == 6 and not relational.search_grades(s, m, f, "x' OR '1'='1").collect()


# changes


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, name string, value int")
    s = spark.createDataFrame([(2, "B", None), (4, "d", 4)], t.schema)
    assert rows(dml.upserted(t, s, ["id"])) == [(1, "a", 1), (2, "B", None), (3, "c", 3), (4, "d", 4)]
    assert rows(dml.updated(t, F.col("value") > 1, name=F.lit("x"))) == [(1, "a", 1), (2, "b", None), (3, "x", 3)]
    assert rows(dml.deleted(t, F.col("value") > 1)) == [(1, "a", 1), (2, "b", None)]
    assert rows(dml.numbered(t.select("name"), ["name"], "n")) == [("a", 1), ("b", 2), ("c", 3)]
    assert dml.numbered(t.limit(0), ["name"], "n").count() == 0
    assert rows(dml.last_of_key(t.union(s), ["id"], ["name"])) == [(1, "a", 1), (2, "b", None), (3, "c", 3), (4, "d", 4)]


def test_tables_and_views(spark):
    dml.create_table(spark, "quarry_a", "id int, v string", key="id")
    dml.create_table(spark, "quarry_a", "id int, v string", key="id")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    dml.write_sorted(df, "quarry_a", "id")
    dml.write_sorted(df, "quarry_b", "id")
    plan = spark.table("quarry_a").hint("merge").join(spark.table("quarry_b"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    dml.create_view(df, "quarry_view")
    assert dml.materialise(spark, "quarry_view") == "quarry_view_materialized"
    dml.create_view(df.limit(0), "quarry_view")
    dml.materialise(spark, "quarry_view")
    assert spark.table("quarry_view_materialized").count() == 2
    dml.truncate(spark, "quarry_b")
    assert spark.table("quarry_b").count() == 0
    assert dml.drop_view(spark, "quarry_view") and not dml.drop_view(spark, "quarry_view")
    for t in ("quarry_a", "quarry_b", "quarry_view_materialized"):
        spark.sql(f"DROP TABLE {t}")


def test_transactions(spark):
    spark.range(3).createOrReplaceTempView("quarry_t")
    with pytest.raises(ZeroDivisionError), dml.Transaction(spark, "quarry_t") as t:
        t.apply("quarry_t", lambda d: d.filter("id > 0"))
        1 / 0  # noqa: B018
    assert spark.table("quarry_t").count() == 3
    with dml.Transaction(spark, "quarry_t") as t:
        t.apply("quarry_t", lambda d: d.filter("id > 0"))
        with pytest.raises(RuntimeError), dml.Transaction(spark, "quarry_t"):
            pass
    assert spark.table("quarry_t").count() == 2


# information


@pytest.mark.parametrize(("text", "bits"), [("ab", 8), ("abcd", 8), ("abab", 8), ("abac", 10), ("aabacad", 16), ("abracadabra", 14)])
def test_markov(text, bits):
    import numpy as np

    assert math.isclose(B.measures(np.frombuffer(text.encode(), np.uint8))["markov"], bits, abs_tol=1e-9)


def test_measures(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abracadabra"), (3, "aaaa"), (4, ""), (5, None), (6, "x")], "id int, text string")
    got = {r.id: r for r in B.summary(B.document_measures(df, "id")).collect()}
    assert round(got[1].entropy, 6) == 1.584963 and round(got[1].information, 6) == 4.754888 and got[1].e == 1
    assert round(got[2].information, 6) == 22.444107 and (got[2].e, got[2].g64, got[2].g8) == (3, 2051, 259)
    assert (got[3].entropy, got[3].e) == (0, 0) and math.copysign(1, got[3].entropy) == 1
    assert got[4].n_bytes == got[5].n_bytes == 0 and got[4].markov is None and got[6].markov is None
    assert got[3].runs == 1 and got[2].runs == 11


def test_unicode_summary(spark):
    df = spark.createDataFrame([("aбб€😀",)], "text string")
    r = B.unicode_summary(B.code_points(df)).first()
    assert (r.symbols, r.distinct_symbols, round(r.bits, 6), r.e, r.table_utf8, r.table_utf32) == (5, 4, 9.60964, 2, 50, 56)
    assert B.unicode_summary(B.code_points(df.limit(0))).count() == 0


def test_decoding():
    assert B.decoded("aé€😀".encode()) == "aé€😀"
    assert B.decoded(b"a\xffb\xc3") == "a�b�" and B.decoded(b"\xe2\x82") == "��"
    assert B.decoded(b"\xc0\x80") == "\0"


def test_histograms(spark):
    df = spark.createDataFrame([("aab",), (None,), ("",)], "text string")
    assert rows(B.byte_histogram(df)) == [(97, 2), (98, 1)] and rows(B.pair_counts(df)) == [(97, 97, 1), (97, 98, 1)]
    assert B.least_frequent(B.byte_histogram(df)).first().byte == 1
    assert rows(B.run_lengths(df)) == [(97, 2, 1), (98, 1, 1)]


# numbers and strings


def test_numbers(spark):
    df = spark.createDataFrame([(37,), (-33,), (0,), (31,), (32,), (255,)], "x int")
    got = {r.x: r for r in df.select("x", N.round_down(F.col("x"), 32).alias("d"), N.round_up(F.col("x"), 32).alias("u"), N.as_hex(F.col("x"), 16).alias("h"), N.as_binary(F.col("x"), 16).alias("b"), N.unsigned(F.col("x"), 16).alias("n"), N.signed(F.col("x"), 16).alias("s")).collect()}
    assert [(got[x].d, got[x].u) for x in (0, 31, 32, 255)] == [(0, 0), (0, 32), (32, 32), (224, 256)]
    assert (got[-33].h, got[-33].b, got[-33].n, got[-33].s) == ("FFDF", "1111111111011111", 65503, -33)


def test_double_views_of_odd_values(spark, tmp_path):
    import duckdb

    from quarry.plans.all_queries import ORACLES, QUERIES

    values = [0.0, -0.0, None, 1.5, -2.0, 5e-324, -1e-310, 2.225073858507201e-308, 1.7976931348623157e308, math.nextafter(8.0, 0.0), math.nextafter(4.0, 0.0), 8.0]
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = {k: (repr(v), n, p) for k, v, n, p in con.execute(ORACLES["double_views"]).fetchall()}
    got = {r.c_custkey: (repr(r.value), r.negative, r.power) for r in QUERIES["double_views"](spark, str(tmp_path)).collect()}
    assert got == want


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(N.factorial_mod(F.lit(20), F.lit(1000000007))) == 146326063 and get(N.factorial_mod(F.lit(10), F.lit(17))) == 14
    assert get(N.factorial_mod(F.lit(100), F.lit(2**61 - 1))) == 549389702849517455 and get(N.factorial_mod(F.lit(0), F.lit(5))) == 1
    assert get(N.mul_mod(F.lit(2**62), F.lit(2**62), F.lit(2**61 - 1))) == pow(2, 124, 2**61 - 1)
    assert get(N.fill_row(F.array(F.array(F.lit(1)), F.array(F.lit(2))), F.lit(1))) == [[1], [-1]]
    assert get(N.odd_sequence(F.lit(4))) == [1, 3, 5, 7] and get(N.odd_sequence(F.lit(0))) == []
    assert get(N.array_sum(F.array(F.lit(1.5), F.lit(2.0)), F.lit(0.0))) == 3.5
    assert get(N.overflows(F.lit(2**31 - 1), F.lit(1))) is True and get(N.overflows(F.lit(1), F.lit(1))) is False
    up = get(N.next_float(F.lit(1.0).cast("float")))
    assert struct.pack("<f", up) == struct.pack("<I", struct.unpack("<I", struct.pack("<f", 1.0))[0] + 1)
    assert [get(N.uint64(F.lit(x))) is None for x in ("18446744073709551615", "18446744073709551616", "-1", "x", "")] == [False, True, True, True, True]


def test_partial_aggregates(spark):
    assert aggregates.factorial_mod(spark, 20, 1000000007, 7) == 146326063 and aggregates.factorial_mod(spark, 0, 7) == 1
    assert rows(aggregates.min_max(spark.range(0), "id")) == [(aggregates.INT_MIN * -1 - 1, aggregates.INT_MIN)]
    assert aggregates.int_mean(spark.createDataFrame([(1,), (2,), (None,), (4,)], "x int"), "x").first() == (3, 2)
    assert aggregates.int_mean(spark.range(0), "id").first() == (0, None)
    assert aggregates.product_mod(spark.range(0), "id", 7).first().product == 1
    forward, backward, single = spark.range(1).select(aggregates.harmonic_in_order(1000), aggregates.harmonic_in_order(1000, True), aggregates.harmonic_in_order(1000, single=True)).first()
    assert abs(forward - backward) < 1e-12 and 1e-9 < abs(forward - single) < 1e-4


def test_timeout(spark):
    slow = spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(30) or x, "long")("id"))
    start = time.time()
    with pytest.raises(Exception, match="(?i)cancel"):
        aggregates.within(spark, 1, slow.collect)
    assert time.time() - start < 25 and aggregates.within(spark, 60, lambda: spark.range(3).count()) == 3


ATTACKS = ["Операционные системы' OR '1'='1", "1'; UPDATE field_comprehensions SET mark = 5; --", "x' UNION ALL SELECT * FROM students --"]


def test_injection(spark):
    texts = [*ATTACKS, "exec (x)", "a -- b", "a;b", "'a;b", "plain text", "it's", None, "selection", ";"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.x for r in df.select("i", S.is_injection(F.col("s")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [api.looks_injected(t) for t in texts] == [True] * 7 + [False, False, False, False, True]


def test_strings(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert get(S.doubled_quotes(F.lit("it's"))) == "it''s" and get(S.doubled_quotes(F.lit("it's"), 4)) == "it'" and get(S.backticks(F.lit("'a'"))) == "`a`"
    assert [get(S.parameter_type(F.lit(x))) for x in ("12", "-3", "", "3.5", "a", None, "1\n")] == [23, 23, 23, 25, 25, 0, 25]
    assert get(S.parent(F.lit("/a/b"))) == "/a" and get(S.parent(F.lit("a"))) == "." and get(S.parent(F.lit("/a"))) == "/"
    assert get(S.relative(F.lit("/a/b/c"), F.lit("/a"))) == "b/c" and get(S.joined(F.lit("a/"), F.lit("b"))) == "a/b"
    assert [get(S.is_excluded(F.lit(x))) for x in (".DS_Store", "a~", "b.tmp", "c.txt")] == [True, True, True, False]


def test_servers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("127.0.0.1:20000\n\nnope\nh:70000\nh:x\n 127.0.0.1:20001 \n")
    assert rows(generators.read_servers(spark, str(tmp_path / "s.txt"))) == [("127.0.0.1", 20000), ("127.0.0.1", 20001)]


# queries


def test_parameters_never_become_text(spark, register):
    register["fields"].createOrReplaceTempView("quarry_fields")
    sql = "SELECT field_id FROM quarry_fields WHERE field_name = $1 AND '$2' <> $1"
    assert rows(api.execute(spark, sql, ["OS"])) == [(10,)]
    for a in ATTACKS:
        assert api.execute(spark, sql, [a]).count() == 0
        assert spark.sql("SELECT field_id FROM quarry_fields WHERE field_name = :n", args={"n": a}).count() == 0
    with pytest.raises(ValueError):
        api.execute(spark, sql)
    assert api.execute(spark, "SELECT $2 + $1 AS x", ["1", "-2"], infer=True).first().x == -1


def test_prepared(spark):
    held = api.Statements(spark)
    assert held.prepare("s", "SELECT id FROM range(10) WHERE id > $1 AND id < $2").count == 2
    assert rows(held.execute("s", [3, 6])) == [(4,), (5,)]
    with pytest.raises(ValueError):
        held.execute("s", [3])
    with pytest.raises(ValueError):
        held.prepare("s", "SELECT 1")
    held.free("s")
    with pytest.raises(KeyError):
        held.execute("s", [3, 6])


def test_permissions(spark):
    for r in security.permissions(spark).collect():
        assert r.allowed == security.has_permission(security.UserSession("u", r.role, r.authenticated), r.operation, r.target)
    user = security.UserSession("u", "junior", True)
    assert api.execute_as(spark, user, "SELECT 1 AS x").first().x == 1 and user.operations_count == 1
    with pytest.raises(PermissionError):
        api.execute_as(spark, user, "DROP TABLE t")
    assert not security.has_permission(None, "select")


def test_workers():
    assert [workers(x, 4) for x in ("3", 100, "x", 0, -1)] == [3, 8, 1, 1, 1]


# files and archives


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.txt", "d/b.bin", "c.tmp", ".DS_Store"):
        (tmp_path / name).write_bytes(name.encode())
    got = files.listing(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.size) for r in got] == [("a.txt", 5), ("b.bin", 7)]
    part = files.whole_files(spark, str(tmp_path)).filter("path LIKE '%a.txt'").select(files.read_at(F.col("content"), 2, 9).alias("x")).first().x
    assert bytes(part) == b"txt"


FILES = [("a", b"abracadabra" * 20), ("empty", b""), ("b/ü", bytes(range(256)) * 3), ("c", b"\0" * 300)]


@pytest.mark.parametrize("primary", ["auto", "none", "huffman", "arithmetic", "shannon", "rle", "lz78", "lz77"])
@pytest.mark.parametrize("secondary", ["none", "rle", "lz77", "lz78", "auto"])
def test_archives(primary, secondary):
    a = archive.opened(archive.build(FILES, primary, secondary))
    assert [(e.filename, a.read(e)) for e in a.entries] == FILES and a.find("c") == b"\0" * 300
    assert a.original_size == sum(len(d) for _, d in FILES)


def test_raw_and_fallback():
    a = archive.opened(archive.build_raw(FILES))
    assert [(e.filename, a.read(e)) for e in a.entries] == FILES and len(archive.RAW.pack(b"lolkek", 0, 0)) == 16 and archive.HEADER.size == 88 and archive.ENTRY.size == 288
    one = archive.opened(archive.build([("x", b"aaaa")], "shannon"))
    assert one.primary == "none" and one.find("x") == b"aaaa"
    assert archive.opened(archive.build([], "huffman")).entries == []


def test_damage_is_found():
    data = bytearray(archive.build(FILES, "lz78"))
    with pytest.raises(ValueError):
        archive.opened(b"no archive here")
    data[20] ^= 1
    with pytest.raises(ValueError):
        archive.opened(bytes(data))
    data[20] ^= 1
    data[-1] ^= 255
    a = archive.opened(bytes(data))
    with pytest.raises(ValueError):
        a.find("c")


def test_archive_source(spark, tmp_path):
    archive.register(spark)
    df = spark.createDataFrame(FILES, "filename string, content binary").repartition(2)
    for path in (str(tmp_path / "x"), f"file://{tmp_path}/y"):
        df.write.format("quarry_archive").option("codec", "h").option("secondary", "lz77").mode("append").save(path)
        got = spark.read.format("quarry_archive").load(path)
        assert rows(got.select("filename", "content")) == sorted(((n, bytearray(d)) for n, d in FILES), key=str)
    df.limit(1).write.format("quarry_archive").option("raw", "true").mode("overwrite").save(str(tmp_path / "x"))
    assert spark.read.format("quarry_archive").load(str(tmp_path / "x")).count() == 1
    assert all(n.endswith(".arc") for n in os.listdir(tmp_path / "x") if not n.startswith((".", "_")))


# streams


def test_udp(spark):
    from quarry.streaming import sockets

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    query = sockets.to_memory(sockets.udp(spark, port), "quarry_udp_rows")
    client = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    client.settimeout(0.5)
    try:
        until, echoed = time.time() + 60, b""
        while time.time() < until and not echoed:
            client.sendto(b"ping", ("127.0.0.1", port))
            try:
                echoed = client.recv(100)
            except OSError:
                time.sleep(0.2)
        assert echoed == b"ping"
        while time.time() < until and not spark.table("quarry_udp_rows").count():
            time.sleep(0.5)
        assert bytes(spark.table("quarry_udp_rows").first().data) == b"ping"
    finally:
        query.stop()
        client.close()


def test_tcp(spark):
    import threading

    from quarry.streaming import sockets

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        connection, _ = server.accept()
        connection.sendall(b"one\ntwo\n")
        time.sleep(20)
        connection.close()

    threading.Thread(target=serve, daemon=True).start()
    query = sockets.to_memory(sockets.tcp_lines(spark, "127.0.0.1", server.getsockname()[1]), "quarry_tcp_rows")
    try:
        until = time.time() + 40
        while time.time() < until and spark.table("quarry_tcp_rows").count() < 2:
            time.sleep(0.5)
        assert rows(spark.table("quarry_tcp_rows")) == [("one",), ("two",)]
    finally:
        query.stop()
        server.close()


def test_utf8_columns(spark):
    df = spark.createDataFrame([(0, "aé".encode()), (1, b"a\xff"), (2, "�".encode()), (3, b""), (4, None)], "i int, d binary")
    got = {r.i: (r.v, r.t) for r in df.select("i", B.is_valid_utf8(F.col("d")).alias("v"), B.decode_utf8("d").alias("t")).collect()}
    assert got == {0: (True, "aé"), 1: (False, "a�"), 2: (False, "�"), 3: (True, ""), 4: (None, None)}


def test_bit_depths(spark):
    df = spark.createDataFrame([(1, "abracadabra"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r for r in B.bit_depth_report(df, "id").collect()}
    assert got[1].e64 == 3 and got[1].g1 == got[1].e1 + 32 and got[1].best == 1 and got[2].size == got[3].e8 == 0


def test_division_of_every_row(spark, tmp_path):
    from quarry.plans.all_queries import QUERIES

    spark.createDataFrame([(1, k, 7) for k in range(1, 6)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(QUERIES["div_mod_all"](spark, str(tmp_path)).drop("l_orderkey")) == [(1, 3, -1, 0, 2**32 - 7), (2, 7, 0, 0, 2**32 - 7), (3, None, None, None, None), (4, -7, 0, 2**32 - 7, 0), (5, -3, -1, 2**31 - 4, 1)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("payload", [False, True])
def test_serial_numbers_of_many_rows(spark, adaptive, payload):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        df = spark.range(n).select(F.xxhash64("id").alias("k"), *([F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("p")] if payload else []))
        out = dml.numbered(df, ["k"], "n")
        assert out.columns == [*df.columns, "n"]
        row = out.agg(F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
        assert (row.d, row.a, row.b) == (n, 1, n)
        # the numbers follow the order of the keys
        assert out.filter("n % 1000 = 0").orderBy("n").select("k").collect() == sorted(out.filter("n % 1000 = 0").select("k").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_statements_are_judged_by_what_they_do(spark):
    spark.range(3).selectExpr("id AS a").createOrReplaceTempView("students")
    junior, user = security.UserSession("j", "junior", True), security.UserSession("u", "user", True)
    for sql in ("WITH x AS (SELECT 1 a) INSERT INTO students SELECT * FROM x", "FROM students INSERT INTO copies SELECT a", "/* SELECT */ DELETE FROM students", "-- x\nUPDATE students SET a = 1", "EXPLAIN DELETE FROM students", "SET spark.x = 1", "BEGIN DELETE FROM students; END"):
        for who in (junior, user):
            with pytest.raises(PermissionError):
                api.execute_as(spark, who, sql, table="field_comprehensions")
    # what the caller says of the table counts for nothing
    with pytest.raises(PermissionError):
        api.execute_as(spark, user, "DELETE FROM other.field_comprehensions", table="field_comprehensions")
    assert api.targets(spark, "DELETE FROM Field_Comprehensions AS f WHERE f.a = $1") == [("delete", "field_comprehensions")]
    assert api.execute_as(spark, junior, "WITH x AS (SELECT a FROM students WHERE a > $1) SELECT count(*) AS n FROM x", [0]).first().n == 2
    assert junior.operations_count == 1 and user.operations_count == 0


def test_authentication(spark):
    rows = [("ann", "s1", security.password_digest("s1", "pw"), False), ("junior_bob", "s2", security.password_digest("s2", "x"), False), ("root", "s3", security.password_digest("s3", "y"), True), ("the_admin", "s4", security.password_digest("s4", "z"), None)]
    accounts = spark.createDataFrame(rows, "username string, salt string, digest string, is_super boolean")
    students = spark.createDataFrame([(5, "ann"), (6, "junior_bob"), (7, "root")], "student_id int, last_name string")
    ann = security.authenticate(accounts, students, "ann", "pw")
    assert (ann.role, ann.is_authenticated, ann.student_id) == ("user", True, 5)
    assert security.authenticate(accounts, students, "junior_bob", "x").role == "junior"
    root = security.authenticate(accounts, students, "root", "y")
    assert (root.role, root.student_id) == ("admin", None) and security.authenticate(accounts, students, "the_admin", "z").role == "admin"
    for name, password in (("ann", "PW"), ("nobody", "pw"), ("ann' OR '1'='1", "pw")):
        wrong = security.authenticate(accounts, students, name, password)
        assert not wrong.is_authenticated and not security.has_permission(wrong, "select")


def test_means_of_groups_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, v double")
    assert rows(relational.with_group_mean(df, "k", "v", "m").select("k", "m")) == rows(spark.createDataFrame([("a", 2.0), ("a", 2.0), (None, 5.0), ("b", None)], "k string, m double"))


def test_text_table_of_no_rows(spark):
    assert relational.text_table(spark.createDataFrame([], "ab string, c int")).collect() == [(True, "ab | c")]
    assert api.printed(spark.range(1, 2).toDF("no")) == "+---+\n|no |\n+---+\n|1  |\n+---+\n"


def test_running_sums_of_one_large_key(spark):
    df = spark.range(5000).selectExpr("if(id % 10 = 0, null, if(id % 7 = 0, 'b', 'a')) AS k", "id AS o", "id % 13 AS v")
    want, sums = [], {}
    for r in df.orderBy("o").collect():
        want.append((r.k, r.o, r.v, sums.get(r.k, 0)))
        sums[r.k] = sums.get(r.k, 0) + r.v
    assert rows(aggregates.running_sum(df, "k", "o", "v", "s")) == sorted(want, key=str)


def test_empty_files_are_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"x"), ("b.txt", b""), ("in/c", b""), ("_hidden", b""), ("d.tmp", b"")):
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.whole_files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": b"x", "b.txt": b"", "c": b""}
    assert {r.filename: r.size for r in files.listing(spark, str(tmp_path)).collect()} == {"a.txt": 1, "b.txt": 0, "c": 0}


def test_datagrams_that_nobody_takes(monkeypatch):
    from quarry.streaming import sockets

    monkeypatch.setattr(sockets, "KEPT", 3)
    free = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    free.bind(("127.0.0.1", 0))
    port = free.getsockname()[1]
    free.close()
    reader = sockets.Datagrams("127.0.0.1", port, True)
    start = reader.latestOffset()
    assert sockets.send_datagrams(("127.0.0.1", port), [b"a", b"b", b"c", b"d"], 1.0)[:3] == [b"a", b"b", b"c"]
    time.sleep(0.2)
    with pytest.raises(RuntimeError):
        reader.latestOffset()
    assert start["next"] > 0 and [bytes(x) for _, x in reader.held] == [b"a", b"b", b"c"]


def test_batches_of_a_query_that_starts_again(monkeypatch):
    from quarry.streaming import sockets

    reader = sockets.Datagrams("127.0.0.1", 0, False)
    reader.start()
    reader.held = [("x", b"1"), ("x", b"2")]
    old = {"next": reader.first - 50}
    (part,) = reader.partitions(old, {"next": reader.first + 1})
    assert [d for _, d in part.rows] == [b"1"]
    reader.commit(old)
    assert len(reader.held) == 2
    reader.commit({"next": reader.first + 1})
    assert [d for _, d in reader.held] == [b"2"]


def test_lines_are_sent():
    from quarry.streaming import sockets

    server = socket.create_server(("127.0.0.1", 0))
    assert sockets.send_lines(server.getsockname(), ["a", "ü"]) == 5
    assert server.accept()[0].makefile("rb").read() == "a\nü\n".encode()


def test_jdbc_options(spark):
    """No database is at hand: the reader must get as far as the missing driver."""
    with pytest.raises(Exception, match="(?i)driver"):
        files.jdbc(spark, "jdbc:postgresql://127.0.0.1:1/x", "t", "id", (1, 9), driver="org.postgresql.Driver").collect()


def test_archives_of_bounded_size(spark, tmp_path):
    archive.register(spark)
    data = [(f"f{k}", bytes([k]) * 1000) for k in range(20)]
    df = spark.createDataFrame(data, "filename string, content binary").coalesce(1)
    path = str(tmp_path / "parts")
    for _ in range(2):  # the second time in place of the first
        df.write.format("quarry_archive").option("archiveBytes", "3000").mode("overwrite").save(path)
        assert len(list((tmp_path / "parts").glob("*.arc"))) == 7
    back = spark.read.format("quarry_archive").load(path)
    assert sorted((r.filename, bytes(r.content)) for r in back.collect()) == sorted(data)
