import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions.integrity import CRCS, checksum, composite_checksum, full_checksum
from quarry.functions.requests import byte_range, condition_failure, cors_rule, scan_range, tags_of, tags_wire
from quarry.operators.catalog import first_of, gauges, merged_planes, upsert
from quarry.operators.listing import pair_page
from quarry.select import Input, select, select_frame
from quarry.sources.csv_rows import CsvFormat


def test_crc_check_values():
    assert [CRCS[n].of(b"123456789") for n in ("CRC32", "CRC32C", "CRC64NVME")] == [0xCBF43926, 0xE3069283, 0xAE8B14860A799888]


@pytest.mark.parametrize("name", CRCS)
def test_crcs_join(name):
    crc, data = CRCS[name], bytes(range(256)) * 9
    for at in (0, 1, 7, 1000, len(data)):
        assert crc.joined(crc.of(data[:at]), crc.of(data[at:]), len(data) - at) == crc.of(data)
    assert CRCS["CRC32"].of(data) == zlib.crc32(data)
    assert crc.of(b"") == 0


def test_checksums(spark):
    import xxhash

    df = spark.createDataFrame([("",), ("abc",), (None,)], "t string")
    for name, known in (("CRC32C", lambda b: CRCS["CRC32C"].bytes(CRCS["CRC32C"].of(b))), ("XXHASH64", xxhash.xxh64_digest), ("XXHASH3", xxhash.xxh3_64_digest), ("XXHASH128", xxhash.xxh3_128_digest), ("SHA512", lambda b: hashlib.sha512(b).digest())):
        got = [r[0] for r in df.select(checksum(F.col("t"), name)).collect()]
        assert got == [base64.b64encode(known(b"")).decode(), base64.b64encode(known(b"abc")).decode(), None]


def test_checksums_of_parts(spark):
    texts = ["one", "", "three"]
    parts = spark.createDataFrame([("u", k, t) for k, t in reversed(list(enumerate(texts)))], "upload_id string, number int, t string")
    for name in ("CRC32", "CRC64NVME"):
        own = parts.select("upload_id", "number", checksum(F.col("t"), name).alias("checksum"), F.octet_length("t").alias("size"))
        crc = CRCS[name]
        assert full_checksum(own, name).first()["checksum"] == base64.b64encode(crc.bytes(crc.of("".join(texts).encode()))).decode()
    own = parts.select("upload_id", "number", checksum(F.col("t"), "SHA1").alias("checksum"))
    joined = b"".join(hashlib.sha1(t.encode()).digest() for t in texts)
    assert composite_checksum(own, "SHA1").first()["checksum"] == base64.b64encode(hashlib.sha1(joined).digest()).decode()


def test_scan_range():
    assert [scan_range(3, None, 10), scan_range(None, 4, 10), scan_range(0, 9, 10)] == [(3, None), (6, 9), (0, 9)]
    for start, end in ((None, None), (-1, None), (10, None), (None, 0), (None, 11), (5, 4), (0, 10)):
        with pytest.raises(ValueError):
            scan_range(start, end, 10)


def test_scan_range_of_csv(spark, tmp_path):
    """A record counts where its first byte is in the range."""
    p = tmp_path / "a.csv"
    p.write_text("aaaaaaaaaaaa\nbb\ncc\ndd\n")
    rows = lambda scan: [r.value for r in select(spark, str(p), "SELECT * FROM S3Object", Input("CSV", scan=scan, csv=CsvFormat())).csv().collect()]
    assert [rows((0, 12)), rows((1, 15)), rows((None, 4)), rows((13, None))] == [["aaaaaaaaaaaa"], ["bb"], ["dd"], ["bb", "cc", "dd"]]


def test_byte_range(spark):
    df = spark.createDataFrame([("héllo",), ("",)], "t string")
    got = df.select(byte_range(F.col("t"), 1, 2).alias("a"), byte_range(F.col("t"), suffix=99).alias("b"), byte_range(F.col("t"), 6).alias("c")).collect()
    assert [[None if v is None else bytes(v) for v in r] for r in got] == [["é".encode(), "héllo".encode(), None], [None, None, None]]


def test_conditions(spark):
    rows = [(None, None, None, None), ('"e"', None, "old", None), ('W/"e"', None, None, None), (None, 'W/"e"', "old", None), (None, 'W/"e"', None, None), (None, None, None, "same"), (None, '"x"', None, "same"), ("*", None, None, "old")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, m string, n string, u string, s string")
    at = F.lit("2024-01-01 00:00:00.7").cast("timestamp")
    when = lambda c: F.when(F.col(c) == "old", F.lit("2023-01-01").cast("timestamp")).when(F.col(c) == "same", F.lit("2024-01-01").cast("timestamp"))
    got = df.select("k", condition_failure(F.lit("e"), at, F.col("m"), F.col("n"), when("u"), when("s")).alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == [None, None, "match", "unmodified_since", "none_match", "modified_since", None, None]


def test_tags(spark):
    wires = ["a=1&b=x%20y", "", "a", "a=1&a=2", "a=%2B+", "=1", "a=<", "&".join(f"k{k}=" for k in range(11))]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in wires], "w string").select(tags_of(F.col("w"))).collect()]
    assert got == [{"a": "1", "b": "x y"}, {}, {}, {}, {"a": "++"}, {}, {}, {}]
    tags = {"b b": "1=2&3%", "a": "+"}
    wire = spark.createDataFrame([(tags,)], "t map<string,string>").select(tags_wire(F.col("t")).alias("w"))
    assert wire.first()[0] == "a=%2B&b%20b=1%3D2%263%25"


def test_cors(spark):
    rules = [{"origins": ["https://*.a.org"], "methods": ["PUT"], "headers": ["x-*"]}, {"origins": ["*"], "methods": ["get"]}]
    rows = [("https://b.a.org", "PUT", ["X-y"]), ("https://b.a.org", "GET", []), ("https://b.a.org", "PUT", ["y"]), ("http://c", "GET", []), ("http://c", "GET", ["x"])]
    df = spark.createDataFrame(rows, "o string, m string, h array<string>")
    assert [r[0] for r in df.select(cors_rule(rules, F.col("o"), F.col("m"), F.col("h"))).collect()] == [0, None, None, 1, None]


def test_catalog(spark):
    warm = spark.createDataFrame([("a", 1), ("b", 2)], "key string, size long")
    cold = spark.createDataFrame([("b", 9), ("c", 3)], "key string, size long")
    assert sorted(map(tuple, merged_planes(warm, cold, ["key"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(map(tuple, upsert(warm, cold, ["key"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert tuple(gauges(warm.where("false"), "key").first()) == (0, 0, 0)
    assert sorted(map(tuple, first_of(warm.union(cold), ["key"], "size").collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_pair_pages_go_on_after_their_marker(spark):
    rows = spark.createDataFrame([(k, i) for k in "abc" for i in "123"], "key string, id string")
    for down in (False, True):
        whole = [tuple(r) for r in pair_page(rows, "key", "id", None, 99, down).collect()]
        got, marker = [], None
        while part := [tuple(r) for r in pair_page(rows, "key", "id", marker, 2, down).collect()]:
            got, marker = got + part, part[-1]
        assert got == whole and len(got) == 9
    assert pair_page(rows, "key", "id", ("a", None), 99).count() == 6


def test_elements_of_arrays_may_be_missing(spark):
    df = spark.createDataFrame([([1, 2], {"x": [None]}), ([], None), (None, None)], "a array<long>, s struct<x:array<long>>")
    count = lambda where: select_frame(df, f"SELECT count(*) AS n FROM S3Object t WHERE {where}").frame().first()[0]
    assert [count("t.a[1] IS MISSING"), count("t.a[0] IS NOT MISSING"), count("t.s.x[0] IS NULL"), count("t.s.x[0] IS NOT MISSING")] == [2, 1, 1, 1]
