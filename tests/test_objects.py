"""Objects, numbers, pages and messages at their edges; the queries hold them against SQL over whole tables."""

import json

import numpy as np
import pytest

from quarry.operators.listing import UnorderedPager, listing_page, page, pair_listing
from quarry.operators.versions import chain, expired_markers, heat, noncurrent_expired
from quarry.select import Input, select, select_frame
from quarry.sources.csv_rows import CsvFormat, read_csv, records
from quarry.sources.json_rows import elements
from quarry.sources.scratch import put_text
from quarry.streaming.events import frames


@pytest.mark.parametrize("text", ['[1,2]', ' [ {"a":"],["} , "x\\\\" , "\\"," ,[1,[2]]] \n', "[]", "[ ]", '{"a":[1,2]}', "7", '["a\\\\\\"b,",1]'])
def test_elements_of_documents(text):
    data = np.frombuffer(text.encode(), np.uint8)
    start, end = elements(data)
    want = json.loads(text)
    assert [json.loads(bytes(data[a:b])) for a, b in zip(start, end)] == (want if isinstance(want, list) else [want])


@pytest.mark.parametrize("text", ["[1,2", "[1] 2", "[1]]", "[1}"])
def test_broken_documents(text):
    with pytest.raises(ValueError):
        elements(np.frombuffer(text.encode(), np.uint8))


def test_documents_are_read_whole(spark, tmp_path):
    rows = [{"id": k, "s": f"a\"]{k},[\n", "n": [k, {"x": None}]} for k in range(12_000)]
    p = tmp_path / "d.json"
    p.write_text(json.dumps(rows, indent=1))
    got = [r.value for r in select(spark, str(p), "SELECT * FROM S3Object", Input("JSON_DOCUMENT")).json().collect()]
    assert sorted(got) == sorted(json.dumps(r, separators=(",", ":")) for r in rows)
    first = select(spark, str(p), "SELECT d.id AS k FROM S3Object d LIMIT 3", Input("JSON_DOCUMENT")).frame().collect()
    assert [r.k for r in first] == ["0", "1", "2"]


def test_csv_records_with_and_without_quotes():
    text = 'a,b\r\n"x ""y"" z",2\n\n"two\nlines",3\nq"r,4\né,"5"\n'
    assert list(records(text.encode(), CsvFormat())) == [(0, ["a", "b"]), (5, ['x "y" z', "2"]), (20, ["two\nlines", "3"]), (34, ['q"r', "4"]), (40, ["é", "5"])]


def test_open_quotes_are_read_by_one_task(spark, tmp_path):
    for body, want in (('1,"a\n2",b\n3,c,d\n', ['1,"a\n2",b', "3,c,d"]), ('1,x"y,b\n3,c,d\n', ['1,"x""y",b', "3,c,d"]), ('"a,b",2\n', ['"a,b",2'])):
        p = tmp_path / f"{len(body)}.csv"
        p.write_text(body)
        assert [r.value for r in select(spark, str(p), "SELECT * FROM S3Object", Input("CSV")).csv().collect()] == want


@pytest.fixture
def small_splits(spark):
    own = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


@pytest.mark.parametrize("tail", ["", '9,"left open\n', '9,"left open'])
def test_open_quotes_are_read_by_many_tasks(spark, tmp_path, small_splits, tail):
    body = "".join(f'{k},"é ""{k}"",\n' + "two, lines\n\n#" * (k % 7) + ("x\n" * 800 if k == 20 else "") + f'",q"r\r\n#no, "record\n"{k}"t,\n\n' for k in range(60)) + tail
    p = tmp_path / "a.csv"
    p.write_text(body, newline="")
    for f in (CsvFormat(comments="#"), CsvFormat(comments="#", header="USE")):
        want = list(records(body.encode(), f))
        rows, head = read_csv(spark, str(p), f)
        assert rows.rdd.getNumPartitions() > 8
        assert sorted((r.record_start, r.cells) for r in rows.collect()) == want[f.header == "USE" :]
        assert head == (want[0][1] if f.header == "USE" else None)
    found = select(spark, str(p), "SELECT _1 AS k FROM S3Object LIMIT 3", Input("CSV")).frame()
    assert [r.k for r in found.collect()] == [c[0] for _, c in records(body.encode(), CsvFormat())][:3]


def test_open_quotes_have_bounds(spark, tmp_path):
    p = tmp_path / "a.csv"
    for n, fits in ((400_000, True), (600_000, False), (2_000_000, False)):
        p.write_text('1,"' + "a\n" * n + '"\n2,b\n')
        if fits:
            assert sorted((r.cells[0], len(r.cells[1])) for r in read_csv(spark, str(p), CsvFormat())[0].collect()) == [("1", 2 * n), ("2", 1)]
        else:
            with pytest.raises(Exception, match="too large"):
                read_csv(spark, str(p), CsvFormat())[0].collect()


def test_objects_in_parts(spark, small_splits):
    lines = spark.range(500).selectExpr("999 - id as o", "concat(999 - id, ',\"a\\n', id, '\"') as value")
    at = put_text(lines, "o", parts=True)
    assert spark.read.format("binaryFile").load(at).count() > 1
    rows = read_csv(spark, at, CsvFormat())[0].orderBy("record_start").collect()
    assert [r.cells for r in rows] == [[str(k), f"a\n{999 - k}"] for k in range(500, 1000)]


def test_numbers(spark):
    df = spark.sql("select 2.75D d, cast(2.75 as decimal(4,2)) m, 9000000000000000000L b, 7 i, 54.0D w")
    one = lambda e: select_frame(df, f"SELECT {e} AS x FROM S3Object").csv().first().value
    assert [one(e) for e in ("d + 1", "d * 2", "m + 1", "-d", "-m", "d * m", "w", "m", "b % 7", "b + b", "b * 2", "b / 3", "i / 4", "i * 0.5", "-i", "1.5 - d", "i % 4")] == [
        "3.75", "5.5", "3.75", "-2.75", "-2.75", "7.5625", "54", "2.75", "2", "18000000000000000000", "18000000000000000000", "3000000000000000000", "1.75", "3.5", "-7", "-1.25", "3",
    ]
    assert select_frame(df, "SELECT count(*) AS n FROM S3Object WHERE d + 1 > 3.5 AND b > '8999999999999999999'").frame().first().n == 1
    for bad in ("d % 2", "d / 0", "b % 0"):
        with pytest.raises(Exception, match="value"):
            one(bad)


def test_json_needs_names(spark):
    df = spark.range(3)
    assert len(select_frame(df, "SELECT id + 1 AS x FROM S3Object").json().collect()) == 3
    for sql in ("SELECT id + 1 FROM S3Object", "SELECT count(*) FROM S3Object"):
        assert select_frame(df, sql).csv().count() > 0
        with pytest.raises(ValueError, match="alias"):
            select_frame(df, sql).json()


def test_pages_go_on_after_their_markers(spark):
    keys = ["a.txt", "b.txt", "dir/c.txt", "dir/sub/d.txt", "e/f", "g"]
    objects = spark.createDataFrame([(k,) for k in keys], "key string")
    for most in (1, 2, 5, 9):
        got, after = [], None
        while True:
            p = page(objects, "", "/", after, most)
            got += [r[0] for r in p.rows]
            if not p.truncated:
                break
            after = p.next_marker
        assert got == ["a.txt", "b.txt", "dir/", "e/", "g"]
        pager = UnorderedPager("", "/", None, most)
        for part in (keys[3:], keys[:3], keys[1:2]):
            pager.offer(spark.createDataFrame([(k,) for k in part], "key string"))
        assert [k for k, _ in pager.finish().rows] == got[:most] and pager.finish().truncated == (most < 5)
    assert listing_page(objects, most=0).count() == 0 and UnorderedPager(most=0).finish().rows == []
    rows = spark.createDataFrame([(k, v) for k in keys for v in (1, 2)], "key string, v int")
    assert [(r.name, r.v) for r in pair_listing(rows, "key", "v", "", "/", ("b.txt", 2), 3, True).collect()] == [("b.txt", 1), ("dir/", None), ("e/", None)]


def test_delete_markers_have_their_own_rule(spark):
    data = [("a", 1, "2020-01-01", False), ("a", 2, "2020-02-01", True), ("a", 3, "2020-03-01", False), ("b", 1, "2020-01-01", True)]
    v = chain(spark.createDataFrame(data, "key string, seq long, last_modified string, is_delete_marker boolean").selectExpr("key", "seq", "cast(last_modified as timestamp) last_modified", "is_delete_marker"))
    now = spark.sql("select timestamp'2021-01-01' t").first().t
    from pyspark.sql import functions as F

    assert [(r.key, r.seq) for r in noncurrent_expired(v, 1, 0, F.lit(now)).collect()] == [("a", 1)]
    assert [(r.key, r.seq) for r in expired_markers(v).collect()] == [("b", 1)]
    reads = spark.createDataFrame([("k", now)] * 3, "key string, ts timestamp")
    later = F.lit(now) + F.expr("interval 2 hours")
    assert [tuple(heat(reads, s, 3, now=later).first()) for s in (3600, 7200)] == [("k", 0, True), ("k", 3, True)]


def test_messages(spark):
    lines = spark.range(20, numPartitions=1).selectExpr("repeat('x', 200000) as value")
    got = list(frames(lines, scanned=7, progress=True, every=3, idle_s=None))
    kinds = [k for k, _ in got]
    assert b"".join(b for k, b in got if k == "records") == (b"x" * 200_000 + b"\n") * 20 and max(len(b) for _, b in got) <= 1 << 20
    assert "cont" in kinds and kinds[-2:] == ["stats", "end"] and json.loads(got[-2][1]) == {"scanned": 7, "processed": 7, "returned": 4_000_020, "rows": 20}
    assert 0 < kinds.count("progress") < kinds.count("records")
