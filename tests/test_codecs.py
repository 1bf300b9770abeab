"""Codecs: fixed vectors, and every codec gives back what it was given."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions.codecs import CODES, canonical, compress, decompress, escape_byte, model_of
from quarry.functions.codecs import arithmetic, lz, prefix, runs
from quarry.functions.codecs.base import compress_all, decompress_all


def counts(data):
    return [data.count(bytes((b,))) for b in range(256)]


@pytest.mark.parametrize(
    ("data", "escape", "out"),
    [(b"aaaaabbbccd", 1, "010261626262636364"), (b"\1\1\1a\1", 1, "010201610100"), (b"\1\1\1a\1", 2, "0101016101"), (b"a" * 300, 1, "01ff61012761")],
)
def test_runs(data, escape, out):
    assert runs.encode(data, escape).hex() == out
    assert runs.decode(bytes.fromhex(out), escape) == data


@pytest.mark.parametrize(("data", "out"), [(b"abcabcabcabc", "616263010102010405"), (b"abracadabra abracadabra", "616272616361640102062001090b")])
def test_lz77(data, out):
    assert lz.encode77(data, 1).hex() == out
    assert lz.decode77(bytes.fromhex(out), 1) == data


def test_lz78():
    assert lz.steps78(b"abababab") == [(97, 98), (256, 97), (98, 97), (0, 98)]
    assert lz.steps78(b"abc") == [(97, 98), (0, 99)]
    assert len(lz.encode78(b"abababab")) == 10 and len(lz.encode78(b"abc")) == 5
    assert lz.decode78(lz.encode78(b"\0abc"), 4) == b"\0abc"


def test_huffman():
    codes = prefix.huffman_codes(counts(b"abracadabra"))
    assert {chr(s): c for s, c in codes.items()} == {"a": "0", "b": "110", "c": "100", "d": "101", "r": "111"}
    assert prefix.encode(b"abracadabra", codes).hex() == "6e8adc" and prefix.size(counts(b"abracadabra"), codes) == 3
    assert prefix.encode(b"aaaa", prefix.huffman_codes(counts(b"aaaa"))).hex() == "00"
    tree = prefix.huffman_tree(counts(b"abracadabra"))
    assert prefix.read_tree(prefix.write_tree(tree)) == tree and prefix.read_tree(prefix.write_tree(97)) == 97


def test_shannon():
    codes = prefix.shannon_codes(counts(b"abracadabra"))
    assert {chr(s): c for s, c in codes.items()} == {"a": "0", "b": "100", "c": "110", "d": "111", "r": "101"}
    assert prefix.encode(b"abracadabra", codes).hex() == "4ace94"
    assert prefix.read_codes(prefix.write_codes(codes)) == codes
    with pytest.raises(ValueError):
        prefix.encode(b"aaaa", prefix.shannon_codes(counts(b"aaaa")))


def test_deep_codes():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    codes = prefix.huffman_codes([*fib, *[0] * 216])
    assert max(map(len, codes.values())) > 32
    data = bytes(range(40))
    assert prefix.decode(prefix.encode(data, codes), codes, 40) == data


def test_arithmetic_model():
    model = arithmetic.model([2**29, *[0] * 255])
    assert sum(model) <= 2**28 and min(model) == 1
    assert arithmetic.read_model(arithmetic.write_model(model)) == model and len(arithmetic.write_model(model)) == 1028


def test_escape():
    assert escape_byte([0] * 256) == 1 and escape_byte(counts(bytes(range(256)) + b"\1")) == 2


SAMPLES = [b"x", b"a" * 50, bytes(range(256)), b"\0" * 20 + b"a\0b\0", random.Random(1).randbytes(4096), b"".join(b"ab"[k % 2 : k % 2 + 1] * k for k in range(255, 261)), b"The quick brown fox. " * 200, random.Random(2).randbytes(9000) + b"end", b""]


@pytest.mark.parametrize("data", SAMPLES, ids=range(len(SAMPLES)))
@pytest.mark.parametrize("name", CODES)
def test_round_trip(name, data):
    out, stages = compress(data, name)
    assert decompress(out, stages) == data


@given(st.binary(max_size=600), st.sampled_from(sorted(CODES)), st.sampled_from(["none", "rle", "lz77", "lz78"]))
@settings(max_examples=150, deadline=None)
def test_two_stages(data, first, second):
    out, stages = compress(data, first, second)
    assert decompress(out, stages) == data


@given(st.text("ab", max_size=200))
@settings(max_examples=100, deadline=None)
def test_few_symbols(text):
    for name in CODES:
        out, stages = compress(text.encode(), name)
        assert decompress(out, stages) == text.encode()


def test_shared_model():
    files = [b"abca", b"ccab", b"aaaa"]
    model = model_of("huffman", counts=counts(b"".join(files)))
    for f in files:
        out, stages = compress(f, "huffman", model=model)
        assert decompress(out, stages) == f


def test_names():
    assert canonical("Huff") == "huffman" and canonical("n") == "none"
    with pytest.raises(ValueError):
        canonical("zip")
    with pytest.raises(ValueError):
        compress(b"a", "rle", "huffman")


def test_columns(spark):
    from quarry.functions.codecs import decode_column, encode_column

    df = spark.createDataFrame([(1, b"aaaaabbbccd", "rle"), (2, None, "lz77"), (3, b"", "huffman"), (4, b"abracadabra", "huffman")], "id int, content binary, how string")
    out = decode_column(encode_column(df, "content", "column:how")).orderBy("id").collect()
    assert [r.decoded for r in out] == [r.content for r in out]
    assert bytes(out[3].encoded).hex() == "6e8adc"


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 200_000])
def test_prefix_codes_of_many_sizes(n):
    rng = random.Random(n)
    for weights in ([1] * 256, [2 ** max(0, 24 - k) for k in range(40)], [1000, 1], [5, 4, 3, 2, 1]):
        data = bytes(rng.choices(range(len(weights)), weights, k=n))
        counts = [data.count(b) for b in range(256)]
        if len(set(data)) < 2:
            continue
        for codes in (prefix.huffman_codes(counts), prefix.shannon_codes(counts)):
            packed = prefix.encode(data, codes)
            text = "".join(codes[b] for b in data)
            assert len(packed) == prefix.size(counts, codes) == -(-len(text) // 8)
            assert packed == int(text.ljust(8 * len(packed), "0"), 2).to_bytes(len(packed), "big")
            assert prefix.decode(packed, codes, n) == data == prefix.decode_by_bits(packed, codes, n)
            with pytest.raises(ValueError):
                prefix.decode(packed[: len(packed) // 2], codes, n)


def test_arithmetic_of_many_files():
    """Bytes of the plain coder, from files of all lengths in one array, each with its own model or all with one."""
    rng = random.Random(5)
    files = [b"", b"x", b"\0" * 3000, bytes(range(256)), rng.randbytes(5000)]
    files += [bytes(rng.choices(range(k), [2 ** min(k, 12), *[1] * (k - 1)], k=rng.randrange(1200))) for k in (1, 2, 7, 256) for _ in range(25)]
    every = arithmetic.model([2**29, *[1] * 200, *[2**27] * 55])
    for some in (files, files[:5], files[1:2], []):
        for models in ([arithmetic.model(counts(d)) for d in some], [every] * len(some)):
            packed = arithmetic.encode_many(some, models)
            assert packed == [arithmetic.encode(d, m) for d, m in zip(some, models)]
            assert arithmetic.decode_many(packed, models, list(map(len, some))) == some
    assert len(arithmetic.decode_many([b"\xff" * 9], [every], [40])[0]) == 40  # damaged, but of the size asked for


def test_arithmetic_is_coded_at_once():
    """Half a million bytes in texts of several sizes, which bit by bit take some three seconds."""
    rng = random.Random(6)
    files = [bytes(rng.choices(b"etaoin shrdlu\n", k=n)) for n in (60, 500, 1500, 4000) for _ in range(80)]
    begun = time.process_time()
    made = compress_all(files, ["arithmetic"] * len(files), ["rle"] * len(files))
    assert decompress_all([d for d, _ in made], [s for _, s in made]) == files
    assert time.process_time() - begun < 1.5
    assert made[:3] == [compress(d, "arithmetic", "rle") for d in files[:3]]


def test_runs_are_found_at_once():
    """A million bytes almost without runs, which one by one take some 1.1 s."""
    data = random.Random(7).randbytes(1_000_000) + b"\1\1\1" + b"a" * 700 + b"\\" * 9
    begun = time.process_time()
    packed = [runs.encode(data, escape) for escape in (1, ord("\\"))]
    assert time.process_time() - begun < 0.8
    assert [runs.decode(p, escape) for p, escape in zip(packed, (1, ord("\\")), strict=True)] == [data, data]


def test_archives_are_coded_at_once():
    """A text collection of 0.7 MB in two stages, which took some five seconds bit by bit."""
    from quarry.sources import archive

    rng = random.Random(8)
    files = [(f"f{k}", bytes(rng.choices(range(97, 123), [2.0 ** -(j % 13) for j in range(26)], k=rng.randrange(4000)))) for k in range(350)]
    begun = time.process_time()
    opened = archive.opened(archive.build(files, "arithmetic", "lz78"))
    assert opened.read_all(opened.entries) == [d for _, d in files]
    assert time.process_time() - begun < 2.5
    assert opened.find("f3") == files[3][1]


def test_arithmetic_in_doubles_and_integers():
    """Bytes of the plain coder on both sides of the largest sum that doubles hold, with shares at the edges of a width."""
    rng = random.Random(9)
    for total in (arithmetic.EXACT - 1, arithmetic.EXACT, arithmetic.EXACT + 1, arithmetic.MOST):
        models = [[total - 255, *[1] * 255], [*[1] * 255, total - 255], [total // 256 + (k < total % 256) for k in range(256)], [*[1] * 128, total - 255, *[1] * 127]]
        files = [bytes(rng.choices(range(256), rng.choice(models), k=rng.randrange(500))) + rng.randbytes(rng.randrange(100)) for _ in range(60)]
        for some in ([models[k % 4] for k in range(60)], [models[0] if k % 2 else arithmetic.model(counts(d)) for k, d in enumerate(files)]):
            packed = arithmetic.encode_many(files, some)
            assert packed == [arithmetic.encode(d, m) for d, m in zip(files, some)]
            assert arithmetic.decode_many(packed, some, list(map(len, files))) == files
            damaged = [bytes(b ^ 255 for b in d[: len(d) // 2]) for d in packed]
            assert arithmetic.decode_many(damaged, some, list(map(len, files))) == [arithmetic.decode(d, m, len(f)) for d, m, f in zip(damaged, some, files)]


def test_arithmetic_of_unequal_texts():
    """2 MB in many short texts and some long ones take some 4.5 times what the plain coder does for 35 kB; with new arrays in each step, 9 times."""
    rng = random.Random(10)
    text = bytes(rng.choices(b"etaoin shrdlu\n", k=40_000))
    files = [text[rng.randrange(9000) :][:n] for n in (*[300] * 2000, *[2000] * 400, *[18_000] * 35)]
    models = [arithmetic.model(counts(d)) for d in files]

    def seconds(n):
        begun = time.process_time()
        if n is None:
            assert arithmetic.decode_many(arithmetic.encode_many(files, models), models, list(map(len, files))) == files
        else:
            assert arithmetic.decode(arithmetic.encode(text[:n], models[-1]), models[-1], n) == text[:n]
        return time.process_time() - begun

    assert min(seconds(None) for _ in range(3)) < 6.5 * min(seconds(35_000) for _ in range(3))


def test_files_of_like_sizes_are_coded_together(monkeypatch):
    """One group alone has the long files, wherever they stand, so that only it takes their many steps."""
    from quarry.functions.codecs import base

    sizes = [9000 if k % 20 == 3 else k for k in range(400)]
    monkeypatch.setattr(base, "AT_ONCE", 200_000)
    monkeypatch.setattr(base, "MODELS", 50)
    groups = list(base.alike(sizes))
    assert sorted(i for g in groups for i in g) == list(range(400))
    assert sum(9000 in [sizes[i] for i in g] for g in groups) == 1 and max(map(len, groups)) <= 50
    files = [bytes((k % 256, 7)) * (n // 2) for k, n in enumerate(sizes)]
    made = compress_all(files, ["arithmetic"] * 400, ["none"] * 400)
    assert made == [compress(d, "arithmetic") for d in files]
    assert decompress_all([d for d, _ in made], [s for _, s in made]) == files


def test_round_trip_in_one_worker(spark):
    """Both columns as by two workers, one after the other; the query reads a text by one."""
    from quarry.functions.codecs import decode_column, encode_column, round_trip_column
    from quarry.plans.all_queries import QUERIES

    rows = [(1, b"aaaaabbbccd", "rle"), (2, None, "lz77"), (3, b"", "huffman"), (4, b"abracadabra", "arithmetic"), (5, b"x" * 70_000, "arithmetic")]
    df = spark.createDataFrame(rows, "id int, content binary, how string")
    for primary, secondary in (("column:how", "none"), ("arithmetic", "rle"), ("shannon", "lz78")):
        both = round_trip_column(df, "content", primary, secondary).orderBy("id").collect()
        assert both == decode_column(encode_column(df, "content", primary, secondary)).drop("stages").orderBy("id").collect()
        assert [r.decoded for r in both] == [r.content for r in both]
    plan = QUERIES["codec_arithmetic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_rows_of_one_row_group_are_coded_by_all_cores(spark, tmp_path):
    """A file cut into many parts by bytes, of which one had all rows; rows that lie evenly stay where they are."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from quarry.plans.all_queries import QUERIES
    from quarry.sources.tables import even

    rng = random.Random(11)
    texts = [None if k == 7 else "".join(rng.choices("etaoin shrdlu", k=60)) for k in range(6000)]
    pq.write_table(pa.table({"doc_id": range(6000), "text": texts}), tmp_path / "documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        out = QUERIES["codec_arithmetic"](spark, str(tmp_path))
        rows = out.select("doc_id", "original", "same", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parts = [sum(r.part == p for r in rows) for p in {r.part for r in rows}]
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(parts) < 2000
    assert sorted((r.doc_id, r.original, r.same) for r in rows) == [(k, *((None, None) if t is None else (60, True))) for k, t in enumerate(texts)]
    assert even(spark.range(0, 6000, 1, 9), "id").rdd.getNumPartitions() == 9
    assert even(spark.range(0), "id").count() == 0
