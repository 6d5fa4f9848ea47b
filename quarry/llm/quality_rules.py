"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Fixed base rules drop short and repetitive texts. Four ratios are then held against cutoffs of each stratum. What
is controlled is the share of good documents that all cutoffs of a stratum together reject: with probability
1 - level it is at most `risk` in every stratum.

1. The labelled documents are holdouts, in two parts by a hash of the id. The choosing quarter orders the candidate
   cutoffs of a stratum: fewest good documents lost, then the loosest. Candidates that catch no bad document
   there, or lose more than `risk` of the good ones, are left out.
2. The testing part goes along that order. A step adds a cutoff to those before it, so the rejected sets are nested
   and their losses only grow. A step is admitted while the exact binomial bound holds: with k of n good documents
   rejected, P(Binomial(n, risk) <= k) <= level / number of strata. The first step that fails ends the walk: testing
   in a fixed order needs no correction for the number of candidates, strata are corrected for by Bonferroni.
3. A stratum with too few good documents to pass even with k = 0 is pooled with the other such ones; the bound
   holds for the pool then. A pool too small rejects nothing on no evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import cut

RISK, LEVEL = 0.03, 0.05
#: Cutoffs are broadcast up to this size.
BROADCAST_BYTES = 8 << 20
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: One of so many labelled documents orders the cutoffs, the others test them.
FOLDS = 4
#: Candidate cutoffs of each ratio, as hundredths.
RATIOS = {
    "symbols": "100.0D * n_symbols / word_chars",
    "dup_lines": "100.0D * n_dup_lines / n_lines",
    "repeats": "100.0D * n_repeat_words / n_words",
    "word_length": "100.0D * word_chars / n_words",
}
CUTOFFS = {
    "symbols": [1, 2, 3, 5, 8, 12, 16, 20, 25, 30],
    "dup_lines": [5, 10, 15, 20, 25, 30, 40, 50, 60, 75],
    "repeats": [2, 4, 6, 8, 10, 12, 15, 20, 25, 29],
    "word_length": [600, 700, 800, 900, 1000, 1100, 1200, 1400, 1600, 2000],
}
_SPACE = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"


def base_columns(docs: DataFrame, text_col: str = "text", window: int = REPEAT_WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words.

    The windows of a text are compared by hashes of their words' hashes, within the text only.
    """
    w = window
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.withColumn("__t", text)
    d = d.withColumns(
        {
            "__h": F.expr(r"transform(array_remove(split(__t, '[\\x20\\x09-\\x0D]+'), ''), x -> xxhash64(x))"),
            "__l": F.expr(f"filter(split(__t, '\\n'), x -> translate(x, {_SPACE}, '') <> '')"),
            "word_chars": F.expr(f"cast(char_length(translate(__t, {_SPACE}, '')) as long)"),
            "n_symbols": F.expr("cast(char_length(__t) - char_length(translate(__t, '#*$%&|<>', '')) as long)"),
        }
    ).drop("__t")
    d = d.withColumns(
        {
            "n_words": F.expr("cast(size(__h) as long)"),
            "n_lines": F.expr("cast(size(__l) as long)"),
            "n_dup_lines": F.expr("cast(size(__l) - size(array_distinct(__l)) as long)"),
            "__w": F.expr(f"if(size(__h) >= {w}, transform(sequence(0, greatest(size(__h) - {w}, 0)), i -> xxhash64(slice(__h, i + 1, {w}))), array())"),
        }
    ).drop("__h", "__l")
    # (hash, start) in order, only where some window occurs twice
    d = d.withColumn(
        "__s",
        F.expr("if(size(__w) = size(array_distinct(__w)), null, array_sort(transform(__w, (h, i) -> struct(h, i))))"),
    ).drop("__w")
    d = d.withColumn(
        "__r",
        F.expr(
            """array_sort(transform(filter(zip_with(zip_with(
                 __s, slice(concat(array(null), __s), 1, size(__s)), (x, p) -> struct(x.h as h, x.i as i, coalesce(p.h = x.h, false) as again)),
                 concat(slice(__s, 2, size(__s)), array(null)), (x, q) -> struct(x.i as i, x.again or coalesce(q.h = x.h, false) as again)),
               x -> x.again), x -> x.i))"""
        ),
    ).drop("__s")
    return d.withColumn(
        "n_repeat_words",
        F.expr(
            f"""coalesce(aggregate(zip_with(__r, concat(slice(__r, 2, size(__r)), array(null)), (a, b) -> least({w}, coalesce(b - a, {w}))),
                 0L, (s, x) -> s + x), 0L)"""
        ),
    ).drop("__r")


def base_failed() -> "F.Column":
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def _choosing(id_col: str) -> "F.Column":
    """Whether a labelled document orders the cutoffs."""
    return F.expr(f"cast(conv(substr(md5(cast({id_col} as string)), 1, 8), 16, 10) as long) % {FOLDS} = 0")


def _small(table: DataFrame, columns: int) -> DataFrame:
    """table marked for broadcast if its size allows; it has a string stratum and so many numbers a row."""
    rows, longest = table.agg(F.count("*"), F.coalesce(F.max(F.octet_length("stratum")), F.lit(0))).first()
    return F.broadcast(table) if rows * (longest + 16 * columns) <= BROADCAST_BYTES else table


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff) of the admitted cutoffs.

    measured: id, stratum, base_failed and the ratios of each document; labels: id, quality. Only counts by stratum,
    rule and candidate leave the cluster's tasks; the driver gets the number of strata.
    """
    held = measured.where("not base_failed").join(labels.where("quality is not null"), "id").select("stratum", "quality", _choosing("id").alias("choosing"), *RATIOS)
    held = cut(held)
    good = held.groupBy("stratum").agg(F.sum(F.expr("if(choosing, 0L, quality)")).alias("n"))
    many = max(1, good.count())
    # a stratum stands alone if no lost document of its n would admit a step
    strata = cut(good.select("stratum", F.expr(f"if(n * ln(1D - {risk}D) <= ln({level}D / {many}), concat('=', stratum), '*')").alias("pool")))
    held = held.join(_small(strata, 8), "stratum")

    candidates = ", ".join(f"struct('{r}' as rule, array({', '.join(f'{float(c)}D' for c in CUTOFFS[r])}) as cs, {r} as v)" for r in RATIOS)
    # how many cutoffs a value exceeds, first; then cumulative counts over at most eleven steps
    steps = (
        held.where("choosing").selectExpr("pool", "quality", f"explode(array({candidates})) c")
        .selectExpr("pool", "quality", "c.rule", "c.cs", "size(filter(c.cs, x -> c.v > x)) step")
        .groupBy("pool", "rule", "cs", "step")
        .agg(F.sum("quality").alias("good"), F.sum(F.lit(1) - F.col("quality")).alias("bad"))
    )
    losses = (
        steps.groupBy("pool", "rule", "cs")
        .agg(F.sum("good").alias("n"), F.collect_list(F.struct("step", "good", "bad")).alias("steps"))
        .selectExpr("pool", "rule", "n", "steps", "posexplode(cs) as (p, cutoff)")
        .selectExpr(
            "pool", "rule", "n", "p", "cutoff",
            "aggregate(filter(steps, x -> x.step > p), 0L, (s, x) -> s + x.good) lost",
            "aggregate(filter(steps, x -> x.step > p), 0L, (s, x) -> s + x.bad) caught",
        )
        .where(f"caught > 0 and lost <= {risk}D * n")
    )
    # a pool's candidates in order: at most as many as there are cutoffs
    walk = losses.groupBy("pool").agg(F.array_sort(F.collect_list(F.expr("struct(lost, -p as tier, -caught as caught, rule, cutoff)"))).alias("walk"))
    value = "case " + " ".join(f"when c.rule = '{r}' then {r}" for r in RATIOS) + " end"
    first = f"array_position(transform(walk, c -> {value} > c.cutoff), true)"
    tested = held.where("not choosing and quality = 1").join(F.broadcast(walk) if many <= 1000 else walk, "pool").select("pool", F.expr(first).alias("step"))
    counts = tested.groupBy("pool", "step").count().groupBy("pool").agg(F.sum("count").alias("n"), F.collect_list(F.struct("step", "count")).alias("steps"))
    tail = f"""aggregate(sequence(0L, k), struct(n * ln(1D - {risk}D) as l, 0D as s),
        (a, i) -> struct(a.l + ln(greatest(n - i, 1L) / (i + 1D)) + ln({risk}D / (1D - {risk}D)) as l, a.s + exp(a.l) as s), a -> a.s)"""
    passed = (
        counts.join(walk, "pool")
        .selectExpr("pool", "n", "steps", "posexplode(walk) as (p, c)")
        .selectExpr("pool", "n", "p", "c.rule", "c.cutoff", "aggregate(filter(steps, x -> x.step between 1 and p + 1), 0L, (s, x) -> s + x.count) k")
        .withColumn("passed", F.expr(f"{tail} <= {level}D / {many}"))
    )
    ends = passed.groupBy("pool").agg(F.coalesce(F.min(F.expr("if(passed, null, p)")), F.lit(10**6)).alias("end"))
    admitted = passed.join(ends, "pool").where("p < end").groupBy("pool", "rule").agg(F.min("cutoff").alias("cutoff"))
    return strata.join(admitted, "pool").select("stratum", "rule", "cutoff")


def _ratios(d: DataFrame) -> DataFrame:
    return d.withColumns({r: F.expr(f"coalesce(try_divide({x.split(' / ')[0]}, {x.split(' / ')[1]}), 0D)") for r, x in RATIOS.items()})


def _judged(d: DataFrame, found: DataFrame) -> DataFrame:
    """d with failed_rules and kept."""
    by_stratum = cut(found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")))
    by_stratum = _small(by_stratum, 16)
    failed = ", ".join(f"if({r} > cuts['{r}'], '{r}', null)" for r in RATIOS)
    return d.join(by_stratum, "stratum", "left").withColumns(
        {"failed_rules": F.expr(f"array_compact(array({failed}))"), "kept": F.expr(f"not base_failed and size(array_compact(array({failed}))) = 0")}
    )


def _marks(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.select(labels[id_col].cast("long").alias("id"), labels["quality"].cast("long").alias("quality"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = RISK,
    level: float = LEVEL,
    rest: bool = False,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, failed_rules);
    with rest also the struct rest of all columns of docs.

    Null or empty texts count 0 and fail. A null stratum is the stratum ''. labels has the id and quality,
    1 for good; null labels and labels of no document don't count, several labels of an id count each. A null id
    has no label; of the words' ratios one without a denominator is 0. Repeated rows give repeated rows; other columns are ignored; empty docs give none and
    empty labels leave the base rules alone.
    """
    own = docs.select(
        docs[id_col].cast("long").alias("id"),
        docs[text_col].alias("text"),
        F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"),
        *([F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("rest")] if rest else []),
    )
    d = base_columns(own).withColumn("base_failed", base_failed()).drop("text")
    # written once: the labelled holdouts and the verdicts read it, the former without the rest
    d = cut(d)
    found = cutoffs(_ratios(d.drop("rest")), _marks(labels, id_col), risk, level)
    return _judged(_ratios(d), found).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum",
        "failed_rules", *(["rest"] if rest else []),
    )


__all__ = ["base_columns", "cutoffs", "quality_rules"]
