"""The operators' queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._labels import fold
from quarry.llm.chat import NOTE_CHARS, TURN_TOOLS, format_chat, turn_calls
from quarry.llm.decontaminate import contaminated
from quarry.llm.html_extract import extract_main_text
from quarry.llm.jaccard import ngram_jaccard_join
from quarry.llm.packing import best_fit_packing
from quarry.llm.quality_model import quality
from quarry.llm.quality_rules import CUTOFFS, FOLDS, LEVEL, RISK, quality_rules
from quarry.llm.shard import SHARDS, kd_shards
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, out=0)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, out=1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no calls of its own: they are made of its turns, as turn_calls() says."""
    tools = spark.createDataFrame(TURN_TOOLS, "name string, required array<string>, types map<string,string>")
    found = format_chat(turn_calls(table(spark, sf_dir, "conversations")), tools)
    return found.withColumn("problems", F.array_join("problems", "; "))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"[^\x20\x09-\x0D]+"


def _rules_sql() -> str:
    ratio = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    ratios = ", ".join(f"coalesce(100.0::DOUBLE * {a} / nullif({b}, 0)::DOUBLE, 0) AS {r}" for r, (a, b) in ratio.items())
    tall = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS v FROM m" for r in ratio)
    cuts = ", ".join(f"('{r}', {k}, {c}::DOUBLE)" for r, cs in CUTOFFS.items() for k, c in enumerate(cs))
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
        d AS (SELECT *, regexp_extract_all(text, '{_WORDS}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM t),
        w1 AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
        w2 AS (SELECT *, word || ' ' || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY k) AS s2 FROM w1),
        w4 AS (SELECT *, s2 || ' ' || lead(s2, 2) OVER (PARTITION BY doc_id ORDER BY k) AS s4 FROM w2),
        w8 AS (SELECT doc_id, word, k, s4 || ' ' || lead(s4, 4) OVER (PARTITION BY doc_id ORDER BY k) AS s8 FROM w4),
        wr AS (SELECT doc_id, word, k, s8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s8) > 1 AS again FROM w8),
        wc AS (SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM wr),
        c AS (SELECT doc_id, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words FROM wc GROUP BY doc_id),
        b AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
            (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
        m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {ratios} FROM b),
        v AS ({tall}),
        h AS (SELECT m.doc_id, m.stratum, quality, ('0x' || substr(md5(m.doc_id::VARCHAR), 1, 8))::BIGINT % {FOLDS} = 0 AS choosing FROM m JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
        s AS (SELECT stratum, sum(CASE WHEN choosing THEN 0 ELSE quality END) AS n, count(*) OVER () AS many FROM h GROUP BY stratum),
        p AS (SELECT stratum, many, CASE WHEN n * ln(1 - {RISK}::DOUBLE) <= ln({LEVEL}::DOUBLE / many) THEN '=' || stratum ELSE '*' END AS pool FROM s),
        hp AS (SELECT h.*, pool, many FROM h JOIN p USING (stratum)),
        cuts(rule, p, cutoff) AS (VALUES {cuts}),
        a AS (SELECT pool, cuts.rule, cuts.p, cutoff, count(*) FILTER (WHERE quality = 1 AND v.v > cutoff) AS lost, count(*) FILTER (WHERE quality = 0 AND v.v > cutoff) AS caught, count(*) FILTER (WHERE quality = 1) AS n
            FROM hp JOIN v ON v.doc_id = hp.doc_id JOIN cuts ON cuts.rule = v.rule WHERE choosing GROUP BY ALL),
        walk AS (SELECT pool, rule, cutoff, row_number() OVER (PARTITION BY pool ORDER BY lost, -p, -caught, rule, cutoff) AS step FROM a WHERE caught > 0 AND lost <= {RISK}::DOUBLE * n),
        f AS (SELECT hp.pool, hp.doc_id, any_value(many) AS many, min(step) FILTER (WHERE v.v > cutoff) AS step FROM hp LEFT JOIN walk ON walk.pool = hp.pool LEFT JOIN v ON v.doc_id = hp.doc_id AND v.rule = walk.rule WHERE NOT choosing AND quality = 1 GROUP BY ALL),
        n AS (SELECT pool, any_value(many) AS many, count(*) AS n FROM f GROUP BY pool),
        k AS (SELECT walk.*, n, many, (SELECT count(*) FROM f WHERE f.pool = walk.pool AND f.step <= walk.step) AS k FROM walk JOIN n USING (pool)),
        q AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}::DOUBLE) + (n - i) * ln(1 - {RISK}::DOUBLE))) FROM (SELECT unnest(range(k.k + 1)) AS i)) <= {LEVEL}::DOUBLE / many AS passed FROM k),
        e AS (SELECT pool, rule, min(cutoff) AS cutoff FROM q WHERE step < coalesce((SELECT min(step) FROM q x WHERE x.pool = q.pool AND NOT x.passed), 1000000) GROUP BY ALL),
        r AS (SELECT DISTINCT v.doc_id FROM v JOIN p ON p.stratum = v.stratum JOIN e ON e.pool = p.pool AND e.rule = v.rule WHERE v.v > cutoff)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM r) AS kept FROM m"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose rows no learned model, greedy order or tokenizer decides."""
    return {
        "op1_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
            x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
            y AS (SELECT doc_id, n, k, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
            s AS (SELECT DISTINCT doc_id, g FROM y WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
            c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM o JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * m >= 80 * (ca.n + cb.n - m)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
            SELECT d.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
        "op8_chat_formatting": f"""WITH RECURSIVE t AS (SELECT *, turn IS NOT NULL AND text IS NOT NULL AND role = 'assistant' AS is_call, turn IS NOT NULL AND text IS NOT NULL AND role = 'user' AND turn > 0 AS is_result, length(text) < {NOTE_CHARS} AS short FROM conversations),
            c AS (SELECT * FROM t WHERE is_call),
            v AS (SELECT conv_id, turn, 0 AS level FROM c WHERE (conv_id, turn - 2) NOT IN (SELECT conv_id, turn FROM c) UNION ALL SELECT c.conv_id, c.turn, v.level + 1 FROM v JOIN c ON c.conv_id = v.conv_id AND c.turn = v.turn + 2)
            SELECT conv_id, turn, 0 AS level, 0 AS part, role, NULL AS call_id, 'message' AS status, NULL::BOOLEAN AS valid, '' AS problems,
                '{{"content":' || CASE WHEN is_call THEN 'null' ELSE coalesce(to_json(text)::VARCHAR, 'null') END || ',"role":' || to_json(role) || '}}' AS json FROM t WHERE NOT is_result
            UNION ALL SELECT conv_id, turn, level, 1, role, 'turn-' || turn, CASE WHEN (conv_id, turn + 1) IN (SELECT conv_id, turn FROM t WHERE is_result) THEN 'linked' ELSE 'no_result' END, NOT short, CASE WHEN short THEN 'topic: missing' ELSE '' END,
                '{{"arguments":{{' || CASE WHEN short THEN '' ELSE '"chars":' || length(text) || ',' END || '"text":' || to_json(text) || '}},"id":"turn-' || turn || '","name":"' || CASE WHEN short THEN 'note' ELSE 'reply' END || '"}}' FROM c JOIN v USING (conv_id, turn)
            UNION ALL SELECT r.conv_id, coalesce(v.turn, r.turn), coalesce(level, 0), 2, 'tool', 'turn-' || (r.turn - 1), CASE WHEN v.turn IS NULL THEN 'no_call' ELSE 'linked' END, NULL, '',
                '{{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"turn-' || (r.turn - 1) || '"}}' FROM t r LEFT JOIN v ON v.conv_id = r.conv_id AND v.turn = r.turn - 1 WHERE is_result""",
        "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
            w1 AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
            w2 AS (SELECT *, word || ' ' || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY k) AS s2 FROM w1),
            w4 AS (SELECT *, s2 || ' ' || lead(s2, 2) OVER (PARTITION BY doc_id ORDER BY k) AS s4 FROM w2),
            w8 AS (SELECT *, s4 || ' ' || lead(s4, 4) OVER (PARTITION BY doc_id ORDER BY k) AS s8 FROM w4),
            w20 AS (SELECT doc_id, word, k, s8 || ' ' || lead(s8, 8) OVER o || ' ' || lead(s4, 16) OVER o AS s FROM w8 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
            r AS (SELECT doc_id, word, k, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 AS r FROM w20),
            c AS (SELECT doc_id, word, k, bool_or(r) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r)
            SELECT d.doc_id, count(c.k) AS n_words, count(*) FILTER (WHERE c.gone) AS n_removed, sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.k) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
            FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
        "op10_quality_rules": _rules_sql(),
    }
