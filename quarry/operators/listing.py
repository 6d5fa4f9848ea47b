"""Object listings: prefix filter, delimiter rollup, exclusive-after pages and their markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def common_prefix(key: Column, prefix: str, delimiter: str | None) -> Column:
    """Key up to and with the first delimiter after the prefix; null if there is none."""
    if not delimiter:
        return F.lit(None).cast("string")
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(at > 0, F.substring(key, F.lit(1), at + len(delimiter) - 1))


def rollup(objects: DataFrame, prefix: str = "", delimiter: str | None = None, key: str = "key") -> DataFrame:
    """(name, is_prefix): keys, and each common prefix once. Partial aggregation comes before the shuffle."""
    own = objects.where(F.col(key).startswith(prefix)) if prefix else objects
    cp = common_prefix(F.col(key), prefix, delimiter)
    return own.select(F.coalesce(cp, F.col(key)).alias("name"), cp.isNotNull().alias("is_prefix")).groupBy("name").agg(F.max("is_prefix").alias("is_prefix"))


def page_rows(names: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first `most` rows with truncated and next_marker, the name of the last of them if there are more.

    A top-k of most + 1 rows; the window sees those alone."""
    if most == 0:
        return names.limit(0).withColumns({"truncated": F.lit(False), "next_marker": F.lit(None).cast("string")})
    by = order or (F.col("name").asc(),)
    found = names.orderBy(*by).limit(most + 1).withColumn("__n", F.row_number().over(Window.orderBy(*by)))
    whole = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    truncated = F.max("__n").over(whole) > most
    found = found.withColumns({"truncated": truncated, "next_marker": F.when(truncated, F.max(F.when(F.col("__n") == most, F.col("name"))).over(whole))})
    return found.where(F.col("__n") <= most).drop("__n")


def listing_page(objects: DataFrame, prefix: str = "", delimiter: str | None = None, after: str | None = None, most: int = 1000, key: str = "key") -> DataFrame:
    """(name, is_prefix, truncated, next_marker): keys and common prefixes after the marker, each prefix once."""
    found = rollup(objects, prefix, delimiter, key)
    return page_rows(found.where(F.col("name") > after) if after else found, most)


def past_page(objects: DataFrame, prefix: str = "", delimiter: str | None = None, after: str | None = None, most: int = 1000, key: str = "key") -> bool:
    """Whether there are more than `most` names after the marker."""
    found = rollup(objects, prefix, delimiter, key)
    return (found.where(F.col("name") > after) if after else found).limit(most + 1).count() > most


def pair_listing(
    rows: DataFrame, first: str, second: str, prefix: str = "", delimiter: str | None = None, marker: tuple | None = None, most: int = 1000, second_descending: bool = False
) -> DataFrame:
    """(name, second, is_prefix, truncated, next_marker): a page of uploads or versions with rollup.

    A common prefix stands for all its rows, has no second part, and isn't told again after a marker within it."""
    own = rows.where(F.col(first).startswith(prefix)) if prefix else rows
    cp = common_prefix(F.col(first), prefix, delimiter)
    entries = own.select(F.coalesce(cp, F.col(first)).alias("name"), F.when(cp.isNull(), F.col(second)).alias(second), cp.isNotNull().alias("is_prefix")).distinct()
    if marker:
        entries = entries.where(F.when(F.col("is_prefix"), F.col("name") > marker[0]).otherwise(after_pair("name", second, marker, second_descending)))
    return page_rows(entries, most, F.col("name").asc(), F.col(second).desc() if second_descending else F.col(second).asc())


class UnorderedPager:
    """A page over objects that come in any order, a frame at a time; holds most + 1 names between frames."""

    def __init__(self, prefix: str = "", delimiter: str | None = None, after: str | None = None, most: int = 1000, key: str = "key"):
        self.prefix, self.delimiter, self.after, self.most, self.key = prefix, delimiter, after, most, key
        self.held: dict[str, bool] = {}

    def offer(self, objects: DataFrame) -> None:
        if self.most == 0:
            return
        found = rollup(objects, self.prefix, self.delimiter, self.key)
        found = found.where(F.col("name") > self.after) if self.after else found
        if self.saturated:  # larger names can't get in
            found = found.where(F.col("name") < max(self.held))
        self.held |= {r["name"]: r["is_prefix"] for r in found.orderBy("name").limit(self.most + 1).collect()}
        self.held = {k: self.held[k] for k in sorted(self.held)[: self.most + 1]}

    @property
    def saturated(self) -> bool:
        return len(self.held) > self.most

    def finish(self) -> Page:
        names = sorted(self.held)[: self.most]
        return Page([(k, self.held[k]) for k in names], self.saturated, names[-1] if self.saturated else None)


@dataclass(frozen=True)
class Page:
    rows: list
    truncated: bool
    next_marker: str | None


def page(objects: DataFrame, prefix: str = "", delimiter: str | None = None, after: str | None = None, most: int = 1000, key: str = "key") -> Page:
    """The first `most` names after the marker, in byte order; one more is looked for to tell whether there are others."""
    if most == 0:
        return Page([], False, None)
    rows = listing_page(objects, prefix, delimiter, after, most, key).collect()
    return Page([(r["name"], r["is_prefix"]) for r in rows], bool(rows) and rows[0]["truncated"], rows[0]["next_marker"] if rows else None)


def page_ordered(objects: DataFrame, prefix: str = "", after: str | None = None, most: int = 1000, key: str = "key") -> DataFrame:
    """The first `most` whole rows after the marker, without rollup: a top-k, never a full sort."""
    own = objects.where(F.col(key).startswith(prefix)) if prefix else objects
    return (own.where(F.col(key) > after) if after else own).orderBy(key).limit(most)


def pair_page(rows: DataFrame, first: str, second: str, marker: tuple[str, str | None] | None = None, most: int = 1000, second_descending: bool = False) -> DataFrame:
    """Pages of uploads (key, upload id) or, with the second descending, of versions (key, newest first)."""
    own = rows.where(after_pair(first, second, marker, second_descending)) if marker else rows
    return own.orderBy(first, F.desc(second) if second_descending else F.asc(second)).limit(most)


def after_pair(first: str, second: str, marker: tuple[str, str | None], second_descending: bool = False) -> Column:
    """Rows beyond a (key, id) marker; without an id, beyond all rows of the key."""
    a, b = marker
    more = F.col(first) > a
    if b is None:
        return more
    return more | ((F.col(first) == a) & ((F.col(second) < b) if second_descending else (F.col(second) > b)))
