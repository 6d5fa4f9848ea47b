"""Version chains, lifecycle rules, orphan sweeps and tier plans over object metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chain(versions: DataFrame, key: str = "key", seq: str = "seq", modified: str = "last_modified") -> DataFrame:
    """versions with rank (0 newest), noncurrent_since (when the next newer one came) and only (the chain's sole row)."""
    newest = Window.partitionBy(key).orderBy(F.desc(seq))
    return versions.withColumns(
        {"rank": F.row_number().over(newest) - 1, "noncurrent_since": F.lag(modified).over(newest), "only": F.count("*").over(Window.partitionBy(key)) == 1}
    )


def midnight_after(anchor: Column, days: Column) -> Column:
    """The first UTC midnight after anchor + days; days 0: the anchor itself."""
    return F.when(days == 0, anchor).otherwise(F.date_trunc("day", anchor) + F.make_dt_interval(days + 1))


def _marker(df: DataFrame) -> Column:
    return F.coalesce(F.col("is_delete_marker"), F.lit(False)) if "is_delete_marker" in df.columns else F.lit(False)


def noncurrent_expired(chained: DataFrame, days: int, keep_newest: int, now: Column) -> DataFrame:
    """Versions that are no longer current, beyond the newest `keep_newest` of those, and due; a delete marker has
    its place among them but never goes this way."""
    due = midnight_after(F.col("noncurrent_since"), F.lit(days)) <= now
    return chained.where((F.col("rank") - 1 >= keep_newest) & due & ~_marker(chained))


def expired_markers(chained: DataFrame) -> DataFrame:
    """Delete markers that are their key's only version."""
    return chained.where(F.col("only") & _marker(chained))


def due(anchor: Column, rule: dict, now: Column) -> Column:
    """Whether a rule's date, or so many days after the anchor, has come; a date wins over days."""
    at = F.lit(rule["date"]).cast("timestamp") if rule.get("date") else midnight_after(anchor.cast("timestamp"), F.lit(rule["days"]))
    return at <= now


def transitions(objects: DataFrame, rules: list[dict], now: Column) -> DataFrame:
    """(key, storage_class, rule): of each object's due transitions the one that became due last; of equal ones the
    first rule's."""
    cases = []
    for n, r in enumerate(x for x in rules if x.get("enabled", True)):
        for t in r.get("transitions", []):
            at = F.lit(t["date"]).cast("timestamp") if t.get("date") else midnight_after(F.col("last_modified").cast("timestamp"), F.lit(t["days"]))
            own = F.struct(at.alias("at"), F.lit(-n).alias("n"), F.lit(t["class"]).alias("storage_class"), F.lit(r["id"]).alias("rule"))
            cases.append(F.when(matches(**r.get("filter", {})) & (at <= now), own))
    if not cases:
        return objects.limit(0).select("key", F.lit("").alias("storage_class"), F.lit("").alias("rule"))
    best = F.array_max(F.array_compact(F.array(*cases)))
    return objects.withColumn("__b", best).where("__b is not null").select("key", "__b.storage_class", "__b.rule")


def aborts(uploads: DataFrame, rules: list[dict], now: Column) -> DataFrame:
    """Uploads (key, upload_id, initiated) that a rule's abort days end; tags and sizes select none."""
    hit = F.lit(False)
    for r in rules:
        f = r.get("filter", {})
        if r.get("enabled", True) and r.get("abort_days") is not None and not {"tags", "larger", "smaller"} & set(f):
            hit = hit | (matches(**f) & (midnight_after(F.col("initiated").cast("timestamp"), F.lit(r["abort_days"])) <= now))
    return uploads.where(hit)


def lifecycle_pass(versions: DataFrame, uploads: DataFrame, rules: list[dict], now: Column) -> DataFrame:
    """(kind, key, id): what one pass over the rules does to versions (key, seq, last_modified, size, is_delete_marker)
    and uploads. kind: expire (a current object), marker (an only delete marker), version (a noncurrent one), abort.

    The chains are ranked once; each rule's thresholds are its own."""
    live = [r for r in rules if r.get("enabled", True)]
    c = chain(versions)
    marker, no = _marker(versions), F.lit(False)
    expire, only, old = no, no, no
    for r in live:
        own = matches(**r.get("filter", {}))
        if r.get("days") is not None or r.get("date"):
            expire = expire | (own & due(F.col("last_modified"), r, now))
        if r.get("expired_marker") and not r.get("filter", {}).get("tags"):
            only = only | own
        if n := r.get("noncurrent"):
            old = old | (own & (F.col("rank") - 1 >= n.get("keep", 0)) & due(F.col("noncurrent_since"), n, now))
    kind = F.when((F.col("rank") == 0) & ~marker & expire, "expire").when(F.col("only") & marker & only, "marker").when((F.col("rank") > 0) & ~marker & old, "version")
    acted = c.withColumn("kind", kind).where("kind is not null").select("kind", "key", F.col("seq").cast("string").alias("id"))
    return acted.union(aborts(uploads, live, now).select(F.lit("abort").alias("kind"), "key", F.col("upload_id").cast("string")))


def matches(prefix: str | None = None, tags: dict[str, str] | None = None, larger: int | None = None, smaller: int | None = None) -> Column:
    """A rule's filter: all of prefix, tags, and sizes strictly between."""
    out = F.lit(True)
    if prefix:
        out = out & F.col("key").startswith(prefix)
    for k, v in (tags or {}).items():
        out = out & F.coalesce(F.col("tags")[k] == v, F.lit(False))
    if larger is not None:
        out = out & (F.col("size") > larger)
    if smaller is not None:
        out = out & (F.col("size") < smaller)
    return out


def earliest_expiry(objects: DataFrame, rules: list[dict]) -> DataFrame:
    """(key, expires, rule): the earliest date of the enabled rules that match; a rule's date wins over its days."""
    cases = []
    for r in rules:
        if r.get("enabled", True):
            at = F.lit(r["date"]).cast("timestamp") if r.get("date") else midnight_after(F.col("last_modified").cast("timestamp"), F.lit(r["days"]))
            cases.append(F.when(matches(**r.get("filter", {})), F.struct(at.alias("expires"), F.lit(r["id"]).alias("rule"))))
    best = F.array_min(F.array_compact(F.array(*cases))) if cases else F.lit(None).cast("struct<expires:timestamp,rule:string>")
    return objects.withColumn("__b", best).where("__b is not null").select("key", "__b.expires", "__b.rule")


def orphans(chunks: DataFrame, *owners: DataFrame, on: list[str]) -> DataFrame:
    """Rows that none of the owners has: an anti join after another, no OR in a join condition."""
    for owner in owners:
        chunks = chunks.join(owner.select(*on).distinct(), on, "left_anti")
    return chunks


def reclaim(objects: DataFrame, need: int, order: str = "mtime") -> DataFrame:
    """Oldest objects until their bytes reach need. Days are summed first; only the last day's objects are ranked."""
    day = F.to_date(order)
    days = objects.groupBy(day.alias("d")).agg(F.sum("size").alias("bytes"))
    before = days.withColumn("before", F.coalesce(F.sum("bytes").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = before.where(F.col("before") < need).drop("bytes")
    own = Window.partitionBy("d").orderBy(order, "key").rowsBetween(Window.unboundedPreceding, -1)
    run = objects.withColumn("d", day).join(last, "d").withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    return run.where(F.col("run") < need).drop("d", "before", "run")


def reclaim_to_watermark(objects: DataFrame, capacity: int, high: float, low: float, order: str = "mtime") -> DataFrame:
    """Oldest objects that bring the bytes in use down to low * capacity; none while they are at most high * capacity."""
    used = objects.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long")).first()[0]
    return reclaim(objects, used - int(low * capacity) if used > high * capacity else 0, order)


def heat(reads: DataFrame, window_s: int, threshold: int, key: str = "key", at: str = "ts", now: Column | None = None) -> DataFrame:
    """(key, reads, promoted): reads since the last gap longer than the window; promoted at the threshold.

    With now, a key whose last read is longer ago than the window has 0 reads."""
    w = Window.partitionBy(key).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    run = reads.withColumn("s", F.sum(F.when(gap > window_s * 1_000_000, 1).otherwise(0)).over(w))
    counts = run.groupBy(key, "s").agg(F.count("*").alias("n"), F.max(micros).alias("last"))
    out = counts.groupBy(key).agg(F.max_by("n", "s").alias("reads"), (F.max("n") >= threshold).alias("promoted"), F.max("last").alias("last"))
    if now is not None:
        stale = F.unix_micros(now.cast("timestamp")) - F.col("last") > window_s * 1_000_000
        out = out.withColumn("reads", F.when(stale, F.lit(0).cast("long")).otherwise(F.col("reads")))
    return out.drop("last")
