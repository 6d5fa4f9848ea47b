"""Queries over the test tables, named after the operators they show, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.integrity import checksum, composite_checksum, etag, multipart_etag
from quarry.functions.requests import byte_range, condition_failure, cors_rule, tags_of, tags_wire
from quarry.operators import catalog
from quarry.operators.listing import page_ordered, pair_page, rollup
from quarry.operators.versions import chain, earliest_expiry, heat, noncurrent_expired, orphans, reclaim
from quarry.select import select, select_frame

#: name: (table, statement of the dialect, SQL)
_STATEMENTS = {
    "p4_filter_project": ("lineitem", "SELECT s.l_orderkey, s.l_extendedprice FROM S3Object s WHERE s.l_quantity > 45", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45"),
    "p7_compare": ("orders", "SELECT o_orderkey FROM S3Object WHERE NOT (o_orderstatus = 'F') AND o_totalprice >= 100000", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false) AND o_totalprice >= 100000"),
    "p14_in": ("orders", "SELECT o_orderkey, o_orderstatus FROM S3Object WHERE o_orderstatus IN ('F', 'P')", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "p15_between": ("lineitem", "SELECT l_orderkey, l_linenumber FROM S3Object WHERE l_quantity NOT BETWEEN 5 AND 40", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 40"),
    "p16_like": ("documents", "SELECT doc_id FROM S3Object d WHERE d.text LIKE '%the%' AND d.lang NOT LIKE 'e_'", "SELECT doc_id FROM documents WHERE text LIKE '%the%' AND lang NOT LIKE 'e_'"),
    "p18_missing": ("orders", "SELECT o_orderkey FROM S3Object WHERE nothing IS MISSING AND o_orderkey IS NOT MISSING AND nothing IS NOT NULL", "SELECT o_orderkey FROM orders"),
    "p13_arithmetic": ("orders", "SELECT o_orderkey FROM S3Object WHERE o_orderkey % 7 = 3 AND o_custkey + 1 > 10", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 AND o_custkey + 1 > 10"),
    "a1_counts": ("lineitem", "SELECT count(*) AS n, count(l_quantity) AS q FROM S3Object WHERE l_quantity > 10", "SELECT count(*) AS n, count(l_quantity) AS q FROM lineitem WHERE l_quantity > 10"),
    "a5_min_max": ("orders", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM S3Object", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders"),
    "p1_star": ("nation", "SELECT * FROM S3Object", "SELECT * FROM nation"),
    "p6_path": ("embeddings", "SELECT s.vec_id, s.label FROM S3Object s WHERE s.embedding[0] > 0 AND s.embedding[100000] IS MISSING", "SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0"),
    "p8_logic": ("orders", "SELECT o_orderkey FROM S3Object WHERE o_orderstatus = 'F' OR o_custkey < 50 AND NOT (o_totalprice > 200000)", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_custkey < 50 AND NOT coalesce(o_totalprice > 200000, false))"),
    "p10_unary": ("orders", "SELECT o_orderkey FROM S3Object WHERE -o_custkey < -100", "SELECT o_orderkey FROM orders WHERE -o_custkey < -100"),
    "p12_divide": ("orders", "SELECT o_orderkey FROM S3Object WHERE o_orderkey / 4 > 100.5", "SELECT o_orderkey FROM orders WHERE o_orderkey / 4.0 > 100.5"),
    "p16_escape": ("customer", "SELECT c_custkey FROM S3Object WHERE c_name LIKE '%!#%1' ESCAPE '!'", "SELECT c_custkey FROM customer WHERE c_name LIKE '%!#%1' ESCAPE '!'"),
    "p17_is": ("documents", "SELECT doc_id FROM S3Object WHERE text IS NOT NULL AND (n_chars > 1000) IS NOT TRUE", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND (n_chars > 1000) IS NOT TRUE"),
    "p20_identifiers": ("orders", "SELECT \"o_orderkey\" FROM S3Object WHERE O_ORDERSTATUS = 'O'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'"),
    "a7_no_rows": ("orders", "SELECT count(*) AS n, count(o_custkey) AS c FROM S3Object WHERE o_orderkey < 0", "SELECT count(*) AS n, count(o_custkey) AS c FROM orders WHERE o_orderkey < 0"),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, sql, _ = _STATEMENTS[name]
    return lambda spark, sf_dir: select(spark, f"{sf_dir}/{table}.parquet", sql).frame()


def _sum_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = select_frame(_table(spark, sf_dir, "lineitem"), "SELECT sum(l_linenumber) AS s, avg(l_linenumber) AS a FROM S3Object").frame()
    return got.select(F.col("s").cast("long").alias("s"), F.round(F.col("a").cast("double"), 6).alias("a"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return rollup(pages.where("key is not null"), "https://", "/")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("turn").alias("last_modified"))
    return chain(turns).select("key", "seq", F.col("rank").cast("long").alias("rank"), "noncurrent_since", "only")


def _expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").alias("last_modified"), F.col("o_custkey").alias("size"))
    rules = [{"id": "small", "days": 10, "filter": {"smaller": 50}}, {"id": "all", "days": 30}, {"id": "ones", "days": 0, "filter": {"prefix": "1"}}]
    return earliest_expiry(objects, rules).select("key", F.date_format("expires", "yyyy-MM-dd").alias("expires"), "rule")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id")
    return orphans(docs, labels, on=["doc_id"])


def _etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", etag(F.col("text")).alias("etag"))


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _table(spark, sf_dir, "events")
    return heat(reads.select(F.col("user_id").alias("key"), "ts"), 86400, 5)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as parts of uploads"""
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("number"), "text")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as objects"""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").alias("mtime"), F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("bucket"))


def _multipart_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multipart_etag(_turns(spark, sf_dir).withColumn("md5", etag(F.col("text"))))


def _checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("MD5", "SHA1", "SHA256")
    return _table(spark, sf_dir, "documents").select("doc_id", *(checksum(F.col("text"), n).alias(n.lower()) for n in names))


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite_checksum(_turns(spark, sf_dir).withColumn("checksum", checksum(F.col("text"), "SHA256")), "SHA256")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    own = {"head": byte_range(text, 0, 15), "middle": byte_range(text, 100, 119), "tail": byte_range(text, suffix=10)}
    return _table(spark, sf_dir, "documents").select("doc_id", *(F.hex(c).alias(k) for k, c in own.items()))


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _orders(spark, sf_dir).withColumn("etag", etag(F.col("key"))), F.col("key").cast("long")
    own, day = F.concat(F.lit('"'), "etag", F.lit('"')), F.lit("1996-01-01").cast("timestamp")
    failed = condition_failure(F.col("etag"), F.col("mtime"), F.when(k % 5 == 0, F.lit('"x"')).when(k % 5 == 1, own), F.when(k % 5 == 2, F.concat(F.lit("W/"), own)), F.when(k % 2 == 0, day), F.when(k % 3 == 0, day))
    return o.select("key", failed.alias("failed"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("tags", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    o = o.withColumn("wire", tags_wire(F.col("tags")))
    return o.select("o_orderkey", "wire", tags_of(F.col("wire"))["priority"].alias("priority"))


def _cors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"origins": ["https://*.example.com"], "methods": ["PUT"]}, {"origins": ["https://*"], "methods": ["GET"]}, {"origins": ["*"], "methods": ["get", "HEAD"]}]
    origin = F.regexp_extract("url", "^https?://[^/]+", 0)
    return _table(spark, sf_dir, "pages").where("url is not null").select("page_id", cors_rule(rules, origin, F.lit("GET")).alias("rule"))


def _upload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upload_sizes(_turns(spark, sf_dir).withColumn("size", F.octet_length("text").cast("long")))


def _first_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return catalog.first_of(docs, ["hash"], "doc_id")


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_optional(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.members(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _table(spark, sf_dir, "labels"), ["doc_id"])


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select("key", "size")
    return catalog.merged_planes(o.where("size < 100").withColumn("tier", F.lit("warm")), o.where("size >= 50").withColumn("tier", F.lit("cold")), ["key"])


def _idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.idle(_orders(spark, sf_dir), F.lit("1996-01-11").cast("timestamp_ntz"), 864_000).select("key")


def _reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclaim(_orders(spark, sf_dir), 100_000).select("key", "size")


def _noncurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _orders(spark, sf_dir).select(F.col("size").alias("key"), F.col("key").cast("long").alias("seq"), F.col("mtime").alias("last_modified"))
    return noncurrent_expired(chain(versions), 30, 1, F.lit("1997-01-01").cast("timestamp")).select("key", "seq")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _statement(name) for name in _STATEMENTS} | {
        "a3_sum_avg": _sum_quantity, "a10_rollup": _rollup, "w_version_chain": _chain, "a11_lifecycle_expiry": _expiry, "j_orphans": _orphans, "f_etag": _etag,
        "w_read_heat": _heat, "f_multipart_etag": _multipart_etag, "f_checksums": _checksums, "f_composite_checksum": _composite, "s19_byte_range": _ranges,
        "f_conditions": _conditions, "f_tags": _tags, "f_cors": _cors, "a12_upload_sizes": _upload_sizes, "a14_first_of": _first_of, "j_left": _left, "j_semi": _semi,
        "j_merged_planes": _planes, "g_idle": _idle, "g_reclaim": _reclaim, "w_noncurrent_expired": _noncurrent,
        "a13_gauges": lambda spark, sf_dir: catalog.gauges(_orders(spark, sf_dir)),
        "g_page_ordered": lambda spark, sf_dir: page_ordered(_orders(spark, sf_dir).select("key", "size"), "1", "12", 100),
        "g_upload_page": lambda spark, sf_dir: pair_page(_turns(spark, sf_dir).select("upload_id", "number"), "upload_id", "number", (5, 1), 50),
        "g_version_page": lambda spark, sf_dir: pair_page(_turns(spark, sf_dir).select("upload_id", "number"), "upload_id", "number", (5, 1), 50, True),
    }


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in _STATEMENTS.items()} | {
        "a3_sum_avg": "SELECT sum(l_linenumber)::BIGINT AS s, round(avg(l_linenumber), 6) AS a FROM lineitem",
        "a10_rollup": """SELECT name, max(p) AS is_prefix FROM (SELECT CASE WHEN strpos(substr(url, 9), '/') > 0 THEN substr(url, 1, 8 + strpos(substr(url, 9), '/')) ELSE url END AS name,
            strpos(substr(url, 9), '/') > 0 AS p FROM pages WHERE starts_with(url, 'https://')) GROUP BY name""",
        "w_version_chain": """SELECT conv_id AS key, turn AS seq, row_number() OVER w - 1 AS rank, lag(turn) OVER w AS noncurrent_since, count(*) OVER (PARTITION BY conv_id) = 1 AS only
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)""",
        "a11_lifecycle_expiry": """SELECT key, strftime(t, '%Y-%m-%d') AS expires, rule FROM (SELECT o_orderkey::VARCHAR AS key, CASE WHEN starts_with(o_orderkey::VARCHAR, '1') THEN o_orderdate::TIMESTAMP
            WHEN o_custkey < 50 THEN date_trunc('day', o_orderdate) + INTERVAL 11 DAY ELSE date_trunc('day', o_orderdate) + INTERVAL 31 DAY END AS t,
            CASE WHEN starts_with(o_orderkey::VARCHAR, '1') THEN 'ones' WHEN o_custkey < 50 THEN 'small' ELSE 'all' END AS rule FROM orders)""",
        "j_orphans": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "f_etag": "SELECT doc_id, md5(text) AS etag FROM documents",
        "w_read_heat": """WITH g AS (SELECT user_id AS key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            s AS (SELECT key, sum(x) OVER (PARTITION BY key ORDER BY ts) AS s FROM g), c AS (SELECT key, s, count(*) AS n FROM s GROUP BY key, s)
            SELECT key, arg_max(n, s) AS reads, max(n) >= 5 AS promoted FROM c GROUP BY key""",
        "f_multipart_etag": "SELECT conv_id AS upload_id, md5(unhex(string_agg(md5(text), '' ORDER BY turn, md5(text)))) || '-' || count(*) AS etag FROM conversations GROUP BY conv_id",
        "f_checksums": "SELECT doc_id, base64(unhex(md5(text))) AS md5, base64(unhex(sha1(text))) AS sha1, base64(unhex(sha256(text))) AS sha256 FROM documents",
        "f_composite_checksum": "SELECT conv_id AS upload_id, base64(unhex(sha256(unhex(string_agg(sha256(text), '' ORDER BY turn, sha256(text)))))) AS checksum FROM conversations GROUP BY conv_id",
        "s19_byte_range": """SELECT doc_id, nullif(substr(h, 1, 32), '') AS head, nullif(substr(h, 201, 40), '') AS middle, nullif(right(h, 20), '') AS tail FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)""",
        "f_conditions": """SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'match' WHEN o_orderkey % 5 <> 1 AND o_orderkey % 2 = 0 AND date_trunc('second', o_orderdate) > TIMESTAMP '1996-01-01' THEN 'unmodified_since'
            WHEN o_orderkey % 5 = 2 THEN 'none_match' WHEN o_orderkey % 3 = 0 AND date_trunc('second', o_orderdate) <= TIMESTAMP '1996-01-01' THEN 'modified_since' END AS failed FROM orders""",
        "f_tags": "SELECT o_orderkey, 'priority=' || replace(o_orderpriority, ' ', '%20') || '&status=' || o_orderstatus AS wire, o_orderpriority AS priority FROM orders",
        "f_cors": """SELECT page_id, CASE WHEN regexp_matches(o, '^https://.*\\.example\\.com$') THEN NULL WHEN starts_with(o, 'https://') THEN 1 ELSE 2 END AS rule
            FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS o FROM pages WHERE url IS NOT NULL)""",
        "a12_upload_sizes": "SELECT conv_id AS upload_id, sum(strlen(text))::BIGINT AS size, count(*) AS parts FROM conversations GROUP BY conv_id",
        "a13_gauges": "SELECT count(DISTINCT o_orderpriority) AS buckets, count(*) AS objects, sum(o_custkey)::BIGINT AS bytes FROM orders",
        "a14_first_of": "SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents GROUP BY md5(text)",
        "j_left": "SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)",
        "j_semi": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "j_merged_planes": "SELECT o_orderkey::VARCHAR AS key, o_custkey AS size, CASE WHEN o_custkey < 100 THEN 'warm' ELSE 'cold' END AS tier FROM orders WHERE o_custkey IS NOT NULL",
        "g_idle": "SELECT o_orderkey::VARCHAR AS key FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'",
        "g_reclaim": "SELECT key, size FROM (SELECT o_orderkey::VARCHAR AS key, o_custkey AS size, coalesce(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM orders) WHERE run < 100000",
        "w_noncurrent_expired": """SELECT key, seq FROM (SELECT o_custkey AS key, o_orderkey AS seq, row_number() OVER w - 1 AS rank, lag(o_orderdate) OVER w AS since FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC))
            WHERE rank >= 2 AND date_trunc('day', since) + INTERVAL 31 DAY <= TIMESTAMP '1997-01-01'""",
        "g_page_ordered": "SELECT o_orderkey::VARCHAR AS key, o_custkey AS size FROM orders WHERE starts_with(o_orderkey::VARCHAR, '1') AND o_orderkey::VARCHAR > '12' ORDER BY key LIMIT 100",
        "g_upload_page": "SELECT conv_id AS upload_id, turn AS number FROM conversations WHERE (conv_id, turn) > (5, 1) ORDER BY conv_id, turn LIMIT 50",
        "g_version_page": "SELECT conv_id AS upload_id, turn AS number FROM conversations WHERE conv_id > 5 OR (conv_id = 5 AND turn < 1) ORDER BY conv_id, turn DESC LIMIT 50",
    }
