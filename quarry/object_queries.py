"""Queries over CSV and JSON objects made from the test tables, over statements and over pages, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.integrity import checksum, full_checksum
from quarry.operators import catalog, listing, versions
from quarry.plans.parser import ParseError, Unsupported, parse
from quarry.select import CsvOutput, Input, select
from quarry.sources.csv_rows import CsvFormat
from quarry.sources.scratch import folder, put_text
from quarry.streaming.events import frames

_QUOTED = "concat('\"', replace({0}, '\"', '\"\"'), '\"')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_csv(spark: SparkSession, sf_dir: str, head: str | None = None, field: str = ",", **options) -> str:
    o = _table(spark, sf_dir, "orders")
    return put_text(o.select("o_orderkey", F.concat_ws(field, "o_orderkey", F.coalesce("o_custkey", F.lit("")), "o_orderstatus", "o_orderpriority").alias("value")), "o_orderkey", head, **options)


def _csv(sql: str, head: str | None = None, field: str = ",", compression: str | None = None, scan=None, codec: str = "none", out: str = "frame", end: str = "\n", **options):
    """A query over orders as one CSV object."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _orders_csv(spark, sf_dir, head, field, compression=codec, end=end)
        found = select(spark, at, sql, Input("CSV", compression, CsvFormat(field=field, record=end, **options), scan))
        return getattr(found, out)()

    return run


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat(doc_id, ',', {_QUOTED.format('text')}, ',', lang)").alias("value"))
    found = select(spark, put_text(d, "doc_id", parts=True), "SELECT d._1 AS id, d._2 AS text, d._3 AS lang FROM S3Object d", Input("CSV")).frame()
    return found.select("id", F.md5("text").alias("hash"), "lang")


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    lines = o.select("o_orderkey", F.concat_ws(",", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, "b"), F.when(F.col("o_orderkey") % 3 > 1, "")).alias("value"))
    sql = "SELECT _1 AS k, _2 AS b, _3 IS MISSING AS gone FROM S3Object WHERE _2 IS NOT MISSING"
    return select(spark, put_text(lines, "o_orderkey"), sql, Input("CSV")).frame()


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    lines = o.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 4 == 0, "#").otherwise(""), "o_orderkey", F.lit(",x")).alias("value"))
    return select(spark, put_text(lines, "o_orderkey"), "SELECT _1 AS k FROM S3Object", Input("CSV", csv=CsvFormat(comments="#"))).frame()


def _quotes_of_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    lines = o.select("o_orderkey", F.concat_ws("|", "o_orderkey", F.concat(F.lit("'"), "o_orderpriority", F.lit("|''"), "o_orderstatus", F.lit("'"))).alias("value"))
    return select(spark, put_text(lines, "o_orderkey", end=";"), "SELECT _1 AS k, _2 AS v FROM S3Object", Input("CSV", csv=CsvFormat(field="|", record=";", quote="'", escape="'"))).frame()


def _event_lines(spark: SparkSession, sf_dir: str, document: bool = False) -> str:
    """Events as JSON objects: value is a number's own text, note is missing or null in some."""
    e = _table(spark, sf_dir, "events")
    note = F.expr("case event_id % 3 when 0 then '' when 1 then ',\"note\":null' else concat(',\"note\":\"n', event_id, '\"') end")
    body = F.concat(F.lit('{"id":'), "event_id", F.lit(',"user":'), "user_id", F.lit(',"type":"'), "event_type", F.lit('","v":'), F.col("event_id") % 7, F.lit('.50,"tags":["a",{"b":'), F.col("user_id") % 5, F.lit("}]"), note, F.lit("}"))
    if not document:
        return put_text(e.select("event_id", body.alias("value")), "event_id")
    last = e.agg(F.max("event_id")).first()[0]
    lines = e.select("event_id", F.concat(F.when(F.col("event_id") == 0, "[ ").otherwise(" "), body, F.when(F.col("event_id") == last, "]").otherwise(" ,")).alias("value"))
    return put_text(lines, "event_id")


def _json(sql: str, kind: str = "JSON_LINES", out: str = "frame"):
    return lambda spark, sf_dir: getattr(select(spark, _event_lines(spark, sf_dir, kind == "JSON_DOCUMENT"), sql, Input(kind)), out)()


def _from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as one record; every third nation has no list."""
    c = _table(spark, sf_dir, "customer").where("c_nationkey is not null")
    items = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit('{"k":'), k, F.lit("}"))), ",")
    n = c.groupBy("c_nationkey").agg(items.alias("items"))
    lines = n.select("c_nationkey", F.concat(F.lit('{"n":'), "c_nationkey", F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit(',"items":['), "items", F.lit("]"))).otherwise(""), F.lit("}")).alias("value"))
    found = select(spark, put_text(lines, "c_nationkey"), "SELECT i.k AS k FROM S3Object[*].items[*] i", Input("JSON_LINES")).frame()
    return found.groupBy("k").count()


def _nested(sql: str, out: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = folder(spark)
        o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "struct(o_orderstatus as s, o_custkey as c) as st", "array(o_custkey, o_orderkey) as arr", "cast(o_totalprice as decimal(12,2)) as d", "o_orderkey % 2 = 0 as even", "o_orderdate")
        o.write.parquet(at)
        return getattr(select(spark, at, sql), out)()

    return run


def _big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers near the end of 64 bits."""
    at = folder(spark)
    _table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "9000000000000000000 + o_orderkey as b").write.parquet(at)
    got = select(spark, at, "SELECT k, b % 7 AS m, b + b AS s, b * 3 AS p, b / 4 AS q, -b AS n FROM S3Object WHERE b > 9000000000000000010").frame()
    return got.select("k", "m", *(F.col(c).cast("decimal(38,4)").cast("string").alias(c) for c in "spqn"))


def _decimals(sql: str, digits: int = 6):
    """Numbers that are no integers, as text of so many digits behind the point."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = select(spark, f"{sf_dir}/lineitem.parquet", sql).frame()
        return got.select(*(F.col(c).cast(f"decimal(28,{digits})").cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in got.dtypes))

    return run


#: Statements beyond the dialect and what they are refused as.
REFUSED = {
    "GROUP BY": "SELECT a FROM S3Object GROUP BY a", "HAVING": "SELECT a FROM S3Object HAVING a > 1", "ORDER BY": "SELECT a FROM S3Object ORDER BY a", "OFFSET": "SELECT a FROM S3Object OFFSET 1",
    "FETCH": "SELECT a FROM S3Object FETCH FIRST 1 ROWS ONLY", "UNION": "SELECT a FROM S3Object UNION SELECT 1", "INTERSECT": "SELECT a FROM S3Object INTERSECT SELECT 1", "EXCEPT": "SELECT a FROM S3Object EXCEPT SELECT 1",
    "JOIN": "SELECT a FROM S3Object JOIN b", "LEFT JOIN": "SELECT a FROM S3Object s LEFT JOIN b ON 1 = 1", "two tables": "SELECT a FROM S3Object, b", "subquery": "SELECT a FROM (SELECT 1)", "CTE": "WITH x AS (SELECT 1) SELECT a FROM S3Object",
    "WINDOW": "SELECT a FROM S3Object WINDOW w AS (ORDER BY a)", "QUALIFY": "SELECT a FROM S3Object QUALIFY a", "over": "SELECT sum(a) OVER (ORDER BY b) FROM S3Object", "DISTINCT": "SELECT DISTINCT a FROM S3Object",
    "CASE": "SELECT CASE WHEN a THEN 1 END FROM S3Object", "CAST": "SELECT CAST(a AS INT) FROM S3Object", "function": "SELECT lower(a) FROM S3Object", "concat": "SELECT a || b FROM S3Object", "EXISTS": "SELECT a FROM S3Object WHERE EXISTS (SELECT 1)",
    "in subquery": "SELECT a FROM S3Object WHERE a IN (SELECT 1)", "aggregate arithmetic": "SELECT sum(a) + 1 FROM S3Object", "count distinct": "SELECT count(DISTINCT a) FROM S3Object", "mixed": "SELECT sum(a), b FROM S3Object",
    "aggregate in WHERE": "SELECT a FROM S3Object WHERE sum(a) > 1", "nested aggregate": "SELECT sum(max(a)) FROM S3Object", "star beside": "SELECT *, a FROM S3Object", "exclude": "SELECT * EXCLUDE (a) FROM S3Object", "qualified star": "SELECT s.* FROM S3Object s",
    "ILIKE": "SELECT a FROM S3Object WHERE a ILIKE 'x'", "limit 0": "SELECT a FROM S3Object LIMIT 0", "other table": "SELECT a FROM t", "path without star": "SELECT a FROM S3Object.b", "empty": "", "two statements": "SELECT a FROM S3Object; SELECT a FROM S3Object",
    "INSERT": "INSERT INTO t VALUES (1)", "no FROM": "SELECT 1", "long": "SELECT a FROM S3Object WHERE a = '" + "x" * (256 * 1024) + "'",
}
_PARSE = ("limit 0", "other table", "path without star", "empty", "long")


def outcome(sql: str) -> str:
    try:
        parse(sql)
    except Unsupported:
        return "unsupported"
    except ParseError:
        return "parse"
    return "taken"


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, outcome(sql) != "taken") for k, sql in REFUSED.items()], "clause string, refused boolean")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as objects: lang/source/id"""
    return _table(spark, sf_dir, "documents").selectExpr("concat(coalesce(lang, 'x'), '/', coalesce(source, 'x'), '/', doc_id) as key", "doc_id as id", "coalesce(n_chars, 0) as size")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages, the second after the first one's marker."""
    keys = _keys(spark, sf_dir)
    one = listing.listing_page(keys, "en/", "/", None, 5)
    marker = one.first()["next_marker"]
    return one.withColumn("page", F.lit(1)).union(listing.listing_page(keys, "en/", "/", marker, 5).withColumn("page", F.lit(2)))


def _past(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return spark.createDataFrame([(n, listing.past_page(keys, "", "/", None, n)) for n in (1, 3, 4, 1000)], "most long, more boolean")


def _unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, pager = _keys(spark, sf_dir), listing.UnorderedPager("", "/", "de/", 3)
    for k in (2, 0, 1):
        pager.offer(keys.where(F.col("id") % 3 == k))
    page = pager.finish()
    return spark.createDataFrame([(name, p, page.truncated, page.next_marker) for name, p in page.rows], "name string, is_prefix boolean, truncated boolean, next_marker string")


def _pair_pages(marker: tuple | None, delimiter: str | None, descending: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir, "conversations").selectExpr("concat(conv_id % 7, '/', conv_id % 13) as key", "conv_id * 10 + turn as n")
        t = t.union(_table(spark, sf_dir, "nation").selectExpr("concat('5-', n_nationkey % 4)", "cast(n_nationkey as long)"))
        return listing.pair_listing(t, "key", "n", "", delimiter, marker, 12, descending)

    return run


_PAIRS = "(SELECT concat(conv_id % 7, '/', conv_id % 13) AS key, conv_id * 10 + turn AS n FROM conversations UNION ALL SELECT concat('5-', n_nationkey % 4), n_nationkey FROM nation)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as versions of their customers' objects; every fifth is a delete marker."""
    return _table(spark, sf_dir, "orders").where("o_custkey is not null").selectExpr("cast(o_custkey as string) as key", "o_orderkey as seq", "o_orderdate as last_modified", "o_orderkey % 100 as size", "o_orderkey % 5 = 0 as is_delete_marker")


_RULES = [
    {"id": "one", "days": 400, "filter": {"prefix": "1"}, "noncurrent": {"days": 30, "keep": 2}},
    {"id": "two", "date": "1999-01-01", "filter": {"larger": 50}, "expired_marker": True, "noncurrent": {"days": 900}},
    {"id": "off", "enabled": False, "days": 0},
    {"id": "three", "expired_marker": True, "abort_days": 5},
]
_NOW = "2000-06-15"


def _pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = _table(spark, sf_dir, "events").selectExpr("event_type as key", "event_id as upload_id", "ts as initiated")
    return versions.lifecycle_pass(_versions(spark, sf_dir), uploads, _RULES, F.lit("2024-01-09 12:00:00").cast("timestamp"))


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _versions(spark, sf_dir).withColumn("key", F.concat_ws("-", "key", "seq"))
    rules = [
        {"id": "a", "transitions": [{"days": 30, "class": "WARM"}, {"days": 365, "class": "COLD"}]},
        {"id": "b", "filter": {"smaller": 10}, "transitions": [{"date": "2000-01-01", "class": "ICE"}]},
    ]
    return versions.transitions(o, rules, F.lit(_NOW).cast("timestamp"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the messages of a result hold: counted here, in order, one at a time."""
    lines = select(spark, f"{sf_dir}/lineitem.parquet", "SELECT l_orderkey, l_linenumber, l_shipdate FROM S3Object").csv()
    kinds, size, most, rows = [], 0, 0, 0
    for kind, body in frames(lines, every=None, idle_s=None):
        kinds += [kind] if kinds[-1:] != [kind] else []
        if kind == "records":
            size, most, rows = size + len(body), max(most, len(body)), rows + body.count(b"\n")
    return spark.createDataFrame([(",".join(kinds), size, rows, most <= 1 << 20)], "kinds string, bytes long, records long, bounded boolean")


def _full_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRC of a conversation's joined turns, from the turns' own, equals that of the joined text."""
    t = _table(spark, sf_dir, "conversations").selectExpr("conv_id as upload_id", "turn as number", "coalesce(text, '') as text")
    parts = full_checksum(t.select("upload_id", "number", checksum(F.col("text"), "CRC32").alias("checksum"), F.octet_length("text").alias("size")), "CRC32")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda p: p["text"]), "")
    whole = t.groupBy("upload_id").agg(joined.alias("text")).select("upload_id", checksum(F.col("text"), "CRC32").alias("whole"))
    return parts.join(whole, "upload_id").selectExpr("upload_id", "checksum = whole as same")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_orderstatus as v")
    return catalog.upsert(o.where("k % 2 = 0"), o.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    head = "key,cust,Status,priority"
    return {
        "s1_csv_reader": _csv("SELECT s._1 AS k, s._3 AS status, s._4 AS p FROM S3Object s WHERE s._2 > 500"),
        "s2_csv_delimiters": _csv("SELECT _1 AS k, _4 AS p FROM S3Object WHERE _3 = 'F'", field="|", end=";"),
        "s2_csv_quotes": _quotes_of_choice, "s2_csv_comments": _comments,
        "s3_header_use": _csv("SELECT key, \"Status\" AS status FROM S3Object WHERE CUST < 100", head, header="USE"),
        "s3_header_ignore": _csv("SELECT _1 AS k FROM S3Object WHERE _3 = 'O'", head, header="IGNORE"),
        "s4_quoted_records": _quoted, "s4_ragged_rows": _ragged,
        "s12_gzip": _csv("SELECT _1 AS k FROM S3Object WHERE _3 = 'F'", compression="GZIP", codec="gzip"),
        "s12_bzip2": _csv("SELECT count(*) AS n, min(_1) AS lo, max(_1) AS hi FROM S3Object", compression="BZIP2", codec="bzip2"),
        "s13_scan_range": _csv("SELECT _1 AS k FROM S3Object", scan=(100, 5000)),
        "s14_scan_suffix": _csv("SELECT _1 AS k FROM S3Object", scan=(None, 2000)),
        "p21_limit": _csv("SELECT _1 AS k FROM S3Object WHERE _3 = 'F' LIMIT 7"),
        "a5_text_numbers": _csv("SELECT min(_2) AS lo, max(_2) AS hi, sum(_1) AS s, count(_3) AS n FROM S3Object WHERE _2 > 0", out="csv"),
        "s5_json_lines": _json("SELECT e.id AS id, e.type AS type, e.v AS v FROM S3Object e WHERE e.user < 20 AND e.v > 2"),
        "s7_json_document": _json("SELECT e.id AS id, e.tags[1].b AS b FROM S3Object[*] e WHERE e.type = 'click'", "JSON_DOCUMENT"),
        "s8_from_path": _from_path,
        "p18_json_missing": _json("SELECT e.id AS id FROM S3Object e WHERE e.note IS MISSING OR e.note IS NULL AND e.user > 10"),
        "k_json_lines": _json("SELECT e.id, e.note, e.v AS value, e.tags FROM S3Object e", out="json"),
        "k_json_star": _json("SELECT * FROM S3Object e WHERE e.user < 30", "JSON_DOCUMENT", "json"),
        "k_csv_of_json": _json("SELECT e.type, e.note, e.v FROM S3Object e", out="csv"),
        "k_csv_star": _csv("SELECT * FROM S3Object WHERE _2 < 300", out="csv"),
        "k_csv_star_json": _csv("SELECT * FROM S3Object WHERE key < 50", head, header="USE", out="json"),
        "k_csv_quotes": lambda spark, sf_dir: select(spark, f"{sf_dir}/documents.parquet", "SELECT doc_id, text, lang FROM S3Object").csv(),
        "k_csv_always": lambda spark, sf_dir: select(spark, f"{sf_dir}/orders.parquet", "SELECT o_orderkey, o_orderpriority FROM S3Object").csv(CsvOutput(field="\t", always=True)),
        "s10_parquet_types": _nested("SELECT o_orderkey, d, even, o_orderdate FROM S3Object", "csv"),
        "s10_doubles": lambda spark, sf_dir: select(spark, f"{sf_dir}/lineitem.parquet", "SELECT l_orderkey, l_quantity, l_extendedprice, l_tax + 1 AS t FROM S3Object WHERE l_tax > 0").json(),
        "s11_nested_json": _nested("SELECT st, arr, st.c AS c, arr[1] AS second FROM S3Object", "json"),
        "p11_add_decimals": _decimals("SELECT l_orderkey, l_linenumber, l_discount + l_tax AS a, l_extendedprice - 1 AS b, 0.5 + l_quantity AS c FROM S3Object WHERE l_discount + 1 > 1.05"),
        "p11_multiply_decimals": _decimals("SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS a, l_extendedprice * 2 AS b, l_tax * 0.25 AS c FROM S3Object WHERE l_extendedprice * l_discount > 1000.5"),
        "p12_divide_decimals": _decimals("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS a, l_quantity / 8 AS b FROM S3Object WHERE l_extendedprice / 2 > 20000.25", 10),
        "p10_negate_decimals": _decimals("SELECT l_orderkey, l_linenumber, -l_extendedprice AS a FROM S3Object WHERE -l_discount < -0.05"),
        "p13_big_integers": _big,
        "a3_sum_decimals": _decimals("SELECT sum(l_extendedprice) AS s, avg(l_discount) AS a, min(l_tax) AS lo, max(l_extendedprice) AS hi FROM S3Object"),
        "x_refused": _refused, "l_listing_pages": _pages, "l_past_page": _past, "l_unordered_pager": _unordered,
        "l_upload_page": _pair_pages(("5-1", 9), "/", False), "l_version_page": _pair_pages(("2/", None), "/", True), "l_version_page_plain": _pair_pages(("5-2", 10), None, True),
        "e_lifecycle_pass": _pass, "a11_transitions": _transitions,
        "w_only_markers": lambda spark, sf_dir: versions.expired_markers(versions.chain(_versions(spark, sf_dir))).select("key", "seq"),
        "w_noncurrent_markers": lambda spark, sf_dir: versions.noncurrent_expired(versions.chain(_versions(spark, sf_dir)), 30, 1, F.lit(_NOW).cast("timestamp")).select("key", "seq"),
        "w_heat_now": lambda spark, sf_dir: versions.heat(_table(spark, sf_dir, "events").selectExpr("user_id as key", "ts"), 86400, 5, now=F.lit("2024-01-20").cast("timestamp")),
        "g_reclaim_watermark": lambda spark, sf_dir: versions.reclaim_to_watermark(_table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as key", "o_orderdate as mtime", "o_orderkey % 100 as size"), 500_000, 0.9, 0.5).select("key"),
        "e_frames": _frames, "f_full_checksum": _full_checksum, "q_upsert": _upsert,
        "f_instants": lambda spark, sf_dir: versions.earliest_expiry(_versions(spark, sf_dir).withColumn("tags", F.create_map(F.lit("t"), F.col("size").cast("string"))), [{"id": "d", "date": "1999-05-05", "filter": {"larger": 90}}, {"id": "t", "days": 1, "filter": {"tags": {"t": "7"}}}]).select("key", "rule", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires")),
    }


_LINE = "concat_ws(',', o_orderkey, coalesce(o_custkey::VARCHAR, ''), o_orderstatus, o_orderpriority)"
_AT = f"(SELECT *, sum(strlen({_LINE}) + 1) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - strlen({_LINE}) - 1 AS place, sum(strlen({_LINE}) + 1) OVER () AS whole FROM orders)"
_NOTE = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',\"note\":null' ELSE ',\"note\":\"n' || event_id || '\"' END"
_KEYS = "(SELECT concat(coalesce(lang, 'x'), '/', coalesce(source, 'x'), '/', doc_id) AS key FROM documents)"
_CHAIN = """(SELECT *, row_number() OVER w - 1 AS rank, lag(last_modified) OVER w AS since, count(*) OVER (PARTITION BY key) = 1 AS sole FROM
    (SELECT o_custkey::VARCHAR AS key, o_orderkey AS seq, o_orderdate AS last_modified, o_orderkey % 100 AS size, o_orderkey % 5 = 0 AS marker FROM orders WHERE o_custkey IS NOT NULL)
    WINDOW w AS (PARTITION BY key ORDER BY seq DESC))"""


def _due(anchor: str, days: int, now: str) -> str:
    return f"date_trunc('day', {anchor}) + INTERVAL {days + 1} DAY <= TIMESTAMP '{now}'"


def _pair_sql(marker: str, delimiter: bool, order: str) -> str:
    names = "SELECT DISTINCT CASE WHEN strpos(key, '/') > 0 THEN substr(key, 1, strpos(key, '/')) ELSE key END AS name, CASE WHEN strpos(key, '/') = 0 THEN n END AS n, strpos(key, '/') > 0 AS is_prefix" if delimiter else "SELECT DISTINCT key AS name, n, false AS is_prefix"
    return f"""WITH e AS ({names} FROM {_PAIRS}), p AS (SELECT *, row_number() OVER (ORDER BY name, n {order}) AS r FROM e WHERE {marker})
        SELECT name, n, is_prefix, (SELECT count(*) FROM p) > 12 AS truncated, CASE WHEN (SELECT count(*) FROM p) > 12 THEN (SELECT name FROM p WHERE r = 12) END AS next_marker FROM p WHERE r <= 12"""


def _text(e: str) -> str:
    return f"round(({e})::DECIMAL(38,10), 6)::DECIMAL(28,6)::VARCHAR"


def _plain(e: str) -> str:
    return f"regexp_replace(({e})::DECIMAL(18,4)::VARCHAR, '\\.?0+$', '')"


def _page_sql(where: str, most: int, start: int) -> str:
    cut = f"strpos(substr(key, {start}), '/')"
    return f"""SELECT *, row_number() OVER (ORDER BY name) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT CASE WHEN {cut} > 0 THEN substr(key, 1, {start - 1} + {cut}) ELSE key END AS name, {cut} > 0 AS is_prefix FROM {_KEYS}) WHERE {where}"""


def oracle_sql() -> dict[str, str]:
    d = lambda c: f"{c}::DECIMAL(18,9)"
    late = "2024-01-09 12:00:00"
    return {
        "s1_csv_reader": "SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS status, o_orderpriority AS p FROM orders WHERE o_custkey > 500",
        "s2_csv_delimiters": "SELECT o_orderkey::VARCHAR AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'",
        "s2_csv_quotes": "SELECT o_orderkey::VARCHAR AS k, o_orderpriority || '|''' || o_orderstatus AS v FROM orders",
        "s2_csv_comments": "SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderkey % 4 <> 0",
        "s3_header_use": "SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS status FROM orders WHERE o_custkey < 100",
        "s3_header_ignore": "SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderstatus = 'O'",
        "s4_quoted_records": "SELECT doc_id::VARCHAR AS id, md5(text) AS hash, lang FROM documents",
        "s4_ragged_rows": "SELECT o_orderkey::VARCHAR AS k, 'b' AS b, o_orderkey % 3 = 1 AS gone FROM orders WHERE o_orderkey % 3 > 0",
        "s12_gzip": "SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderstatus = 'F'",
        "s12_bzip2": "SELECT count(*) AS n, min(o_orderkey)::VARCHAR AS lo, max(o_orderkey)::VARCHAR AS hi FROM orders",
        "s13_scan_range": f"SELECT o_orderkey::VARCHAR AS k FROM {_AT} WHERE place BETWEEN 100 AND 5000",
        "s14_scan_suffix": f"SELECT o_orderkey::VARCHAR AS k FROM {_AT} WHERE place >= whole - 2000",
        "p21_limit": "SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 7",
        "a5_text_numbers": "SELECT min(o_custkey) || ',' || max(o_custkey) || ',' || sum(o_orderkey)::BIGINT || ',' || count(*) AS value FROM orders WHERE o_custkey > 0",
        "s5_json_lines": "SELECT event_id::VARCHAR AS id, event_type AS type, (event_id % 7) || '.50' AS v FROM events WHERE user_id < 20 AND event_id % 7 >= 2",
        "s7_json_document": "SELECT event_id::VARCHAR AS id, (user_id % 5)::VARCHAR AS b FROM events WHERE event_type = 'click'",
        "s8_from_path": "SELECT CASE WHEN c_nationkey % 3 > 0 THEN c_custkey::VARCHAR END AS k, count(DISTINCT CASE WHEN c_nationkey % 3 > 0 THEN c_custkey ELSE c_nationkey END) AS count FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1",
        "p18_json_missing": "SELECT event_id::VARCHAR AS id FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND user_id > 10)",
        "k_json_lines": f"SELECT '{{\"id\":' || event_id || {_NOTE} || ',\"value\":' || (event_id % 7) || '.50,\"tags\":[\"a\",{{\"b\":' || (user_id % 5) || '}}]}}' AS value FROM events",
        "k_json_star": f"SELECT '{{\"id\":' || event_id || ',\"user\":' || user_id || ',\"type\":\"' || event_type || '\",\"v\":' || (event_id % 7) || '.50,\"tags\":[\"a\",{{\"b\":' || (user_id % 5) || '}}]' || {_NOTE} || '}}' AS value FROM events WHERE user_id < 30",
        "k_csv_of_json": "SELECT event_type || ',' || CASE WHEN event_id % 3 = 2 THEN 'n' || event_id ELSE '' END || ',' || (event_id % 7) || '.50' AS value FROM events",
        "k_csv_star": f"SELECT {_LINE} AS value FROM orders WHERE o_custkey < 300",
        "k_csv_star_json": "SELECT '{\"key\":\"' || o_orderkey || '\",\"cust\":\"' || coalesce(o_custkey::VARCHAR, '') || '\",\"Status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}' AS value FROM orders WHERE o_orderkey < 50",
        "k_csv_quotes": "SELECT doc_id || ',' || CASE WHEN regexp_matches(text, '[\",\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE coalesce(text, '') END || ',' || coalesce(lang, '') AS value FROM documents",
        "k_csv_always": "SELECT '\"' || o_orderkey || '\"' || chr(9) || '\"' || o_orderpriority || '\"' AS value FROM orders",
        "s10_parquet_types": "SELECT o_orderkey || ',' || regexp_replace(o_totalprice::DECIMAL(12,2)::VARCHAR, '\\.?0+$', '') || ',' || (o_orderkey % 2 = 0) || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS value FROM orders",
        "s10_doubles": f"SELECT '{{\"l_orderkey\":' || l_orderkey || ',\"l_quantity\":' || {_plain('l_quantity')} || ',\"l_extendedprice\":' || {_plain('l_extendedprice')} || ',\"t\":' || {_plain('l_tax::DECIMAL(18,9) + 1')} || '}}' AS value FROM lineitem WHERE l_tax > 0",
        "s11_nested_json": "SELECT '{\"st\":{\"s\":\"' || o_orderstatus || '\",\"c\":' || coalesce(o_custkey::VARCHAR, 'null') || '},\"arr\":[' || coalesce(o_custkey::VARCHAR, 'null') || ',' || o_orderkey || '],\"c\":' || coalesce(o_custkey::VARCHAR, 'null') || ',\"second\":' || o_orderkey || '}' AS value FROM orders",
        "p11_add_decimals": f"SELECT l_orderkey, l_linenumber, {_text(d('l_discount') + ' + ' + d('l_tax'))} AS a, {_text(d('l_extendedprice') + ' - 1')} AS b, {_text('0.5 + ' + d('l_quantity'))} AS c FROM lineitem WHERE {d('l_discount')} + 1 > 1.05",
        "p11_multiply_decimals": f"SELECT l_orderkey, l_linenumber, {_text(d('l_extendedprice') + ' * ' + d('l_discount'))} AS a, {_text(d('l_extendedprice') + ' * 2')} AS b, {_text(d('l_tax') + ' * 0.25')} AS c FROM lineitem WHERE {d('l_extendedprice')} * {d('l_discount')} > 1000.5",
        "p12_divide_decimals": """SELECT l_orderkey, l_linenumber, (v // 10000000000) || '.' || lpad((v % 10000000000)::VARCHAR, 10, '0') AS a, (q / 8)::DECIMAL(28,10)::VARCHAR AS b
            FROM (SELECT *, l_quantity::HUGEINT AS q, (round(l_extendedprice * 100)::HUGEINT * 200000000 + q) // (2 * q) AS v FROM lineitem) WHERE l_extendedprice / 2 > 20000.25""",
        "p10_negate_decimals": f"SELECT l_orderkey, l_linenumber, {_text('-' + d('l_extendedprice'))} AS a FROM lineitem WHERE l_discount::DECIMAL(18,9) > 0.05",
        "p13_big_integers": """SELECT k, b % 7 AS m, (b::DECIMAL(38,4) + b::DECIMAL(38,4))::VARCHAR AS s, (b::DECIMAL(34,4) * 3)::DECIMAL(38,4)::VARCHAR AS p,
            (b // 4)::VARCHAR || CASE b % 4 WHEN 0 THEN '.0000' WHEN 1 THEN '.2500' WHEN 2 THEN '.5000' ELSE '.7500' END AS q, (-b::DECIMAL(38,4))::VARCHAR AS n
            FROM (SELECT o_orderkey AS k, 9000000000000000000 + o_orderkey AS b FROM orders) WHERE k > 10""",
        "a3_sum_decimals": f"SELECT {_text('sum(' + d('l_extendedprice') + ')')} AS s, round(sum({d('l_discount')})::DOUBLE / count(*), 6)::DECIMAL(28,6)::VARCHAR AS a, min(l_tax) AS lo, max(l_extendedprice) AS hi FROM lineitem",
        "x_refused": "SELECT unnest([" + ", ".join("'" + k.replace("'", "''") + "'" for k in REFUSED) + "]) AS clause, true AS refused",
        "l_listing_pages": f"""WITH p AS ({_page_sql("starts_with(name, 'en/')", 5, 4)}) SELECT name, is_prefix, c > (r + 4) // 5 * 5 AS truncated, CASE WHEN c > (r + 4) // 5 * 5 THEN (SELECT name FROM p q WHERE q.r = (p.r + 4) // 5 * 5) END AS next_marker,
            ((r + 4) // 5)::INTEGER AS page FROM p WHERE r <= 10""",
        "l_past_page": f"SELECT m AS most, (SELECT count(*) FROM ({_page_sql('true', 0, 1)})) > m AS more FROM (SELECT unnest([1, 3, 4, 1000])::BIGINT AS m)",
        "l_unordered_pager": f"""WITH p AS ({_page_sql("name > 'de/'", 3, 1)}) SELECT name, is_prefix, c > 3 AS truncated, CASE WHEN c > 3 THEN (SELECT name FROM p WHERE r = 3) END AS next_marker FROM p WHERE r <= 3""",
        "l_upload_page": _pair_sql("CASE WHEN is_prefix THEN name > '5-1' ELSE name > '5-1' OR (name = '5-1' AND n > 9) END", True, "ASC NULLS FIRST"),
        "l_version_page": _pair_sql("name > '2/'", True, "DESC NULLS LAST"),
        "l_version_page_plain": _pair_sql("name > '5-2' OR (name = '5-2' AND n < 10)", False, "DESC"),
        "e_lifecycle_pass": f"""SELECT 'expire' AS kind, key, seq::VARCHAR AS id FROM {_CHAIN} WHERE rank = 0 AND NOT marker AND ((starts_with(key, '1') AND {_due('last_modified', 400, late)}) OR size > 50)
            UNION ALL SELECT 'marker', key, seq::VARCHAR FROM {_CHAIN} WHERE sole AND marker
            UNION ALL SELECT 'version', key, seq::VARCHAR FROM {_CHAIN} WHERE rank > 0 AND NOT marker AND ((starts_with(key, '1') AND rank >= 3 AND {_due('since', 30, late)}) OR (size > 50 AND {_due('since', 900, late)}))
            UNION ALL SELECT 'abort', event_type, event_id::VARCHAR FROM events WHERE {_due('ts', 5, late)}""",
        "a11_transitions": f"""SELECT o_custkey || '-' || o_orderkey AS key, CASE WHEN o_orderkey % 100 < 10 AND (NOT {_due('o_orderdate', 365, _NOW)} OR TIMESTAMP '2000-01-01' > date_trunc('day', o_orderdate) + INTERVAL 366 DAY) AND (NOT {_due('o_orderdate', 30, _NOW)} OR TIMESTAMP '2000-01-01' > date_trunc('day', o_orderdate) + INTERVAL 31 DAY OR {_due('o_orderdate', 365, _NOW)}) THEN 'ICE'
            WHEN {_due('o_orderdate', 365, _NOW)} THEN 'COLD' WHEN {_due('o_orderdate', 30, _NOW)} THEN 'WARM' END AS storage_class, CASE WHEN storage_class = 'ICE' THEN 'b' ELSE 'a' END AS rule FROM orders WHERE o_custkey IS NOT NULL AND storage_class IS NOT NULL""",
        "w_only_markers": f"SELECT key, seq FROM {_CHAIN} WHERE sole AND marker",
        "w_noncurrent_markers": f"SELECT key, seq FROM {_CHAIN} WHERE rank >= 2 AND NOT marker AND {_due('since', 30, _NOW)}",
        "w_heat_now": """WITH g AS (SELECT user_id AS key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT key, ts, sum(x) OVER (PARTITION BY key ORDER BY ts) AS s FROM g), c AS (SELECT key, s, count(*) AS n, max(ts) AS last FROM s GROUP BY key, s)
            SELECT key, CASE WHEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(max(last)) > 86400000000 THEN 0 ELSE arg_max(n, s) END AS reads, max(n) >= 5 AS promoted FROM c GROUP BY key""",
        "g_reclaim_watermark": """SELECT key FROM (SELECT o_orderkey::VARCHAR AS key, coalesce(sum(o_orderkey % 100) OVER (ORDER BY o_orderdate, o_orderkey::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
            sum(o_orderkey % 100) OVER () AS used FROM orders) WHERE used > 450000 AND run < used - 250000""",
        "e_frames": "SELECT 'records,stats,end' AS kinds, sum(strlen(l_orderkey || ',' || l_linenumber || ',' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')) + 1)::BIGINT AS bytes, count(*) AS records, true AS bounded FROM lineitem",
        "f_full_checksum": "SELECT DISTINCT conv_id AS upload_id, true AS same FROM conversations",
        "q_upsert": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
        "f_instants": """SELECT o_custkey::VARCHAR AS key, CASE WHEN o_orderkey % 100 = 7 THEN 't' ELSE 'd' END AS rule, CASE WHEN o_orderkey % 100 = 7 THEN strftime(date_trunc('day', o_orderdate) + INTERVAL 2 DAY, '%Y-%m-%d 00:00:00') ELSE '1999-05-05 00:00:00' END AS expires
            FROM orders WHERE o_custkey IS NOT NULL AND (o_orderkey % 100 = 7 OR o_orderkey % 100 > 90)""",
    }
