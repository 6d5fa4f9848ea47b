"""What a request asks of objects, as columns: byte ranges, conditions, tags, cross-origin rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and characters of tags.
MAX_TAGS, MAX_TAG_KEY, MAX_TAG_VALUE = 10, 128, 256
TAG_TEXT = r"^[\p{L}\p{Z}\p{N}_.:/=+\-@]*$"


def scan_range(start: int | None, end: int | None, size: int) -> tuple[int, int | None]:
    """First and last byte (None: to the end) of a scan; an end alone asks for that many last bytes."""
    if start is None and end is None:
        raise ValueError("scan range: neither start nor end")
    if (start or 0) < 0 or (end or 0) < 0:
        raise ValueError("scan range: negative")
    if start is None:
        if not 1 <= end <= size:
            raise ValueError("scan range: the end alone must be 1 to the object's size")
        return size - end, size - 1
    if end is not None and start > end:
        raise ValueError("scan range: start after end")
    if max(start, end or 0) >= size:
        raise ValueError("scan range: beyond the object")
    return start, end


def byte_range(content: Column, first: int | None = None, last: int | None = None, suffix: int | None = None) -> Column:
    """The bytes first..last, or the last `suffix` ones, cut at the object's end; null where no byte is in range."""
    b = content.cast("binary")
    n = F.octet_length(b)
    start = F.greatest(n - suffix, F.lit(0)) if suffix is not None else F.lit(first or 0)
    end = n - 1 if last is None else F.least(F.lit(last), n - 1)
    return F.when(start <= end, F.substring(b, start + 1, end - start + 1))


def condition_failure(etag: Column, modified: Column, if_match: Column, if_none_match: Column, if_unmodified: Column, if_modified: Column) -> Column:
    """The first condition that fails, or null: match, unmodified_since, none_match, modified_since.

    Null conditions don't hold. Tags are in wire form (*, "x", W/"x"), a weak one never meets if_match. Dates count
    whole seconds; if_unmodified is ignored beside if_match, if_modified beside if_none_match.
    """
    second = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / 1_000_000)
    own = F.concat(F.lit('"'), etag, F.lit('"'))
    weak = F.regexp_replace(if_none_match, "^W/", "")
    return (
        F.when(if_match.isNotNull() & ~((if_match == "*") | (if_match == own)), "match")
        .when(if_match.isNull() & (second(modified) > second(if_unmodified)), "unmodified_since")
        .when((weak == "*") | (weak == own), "none_match")
        .when(if_none_match.isNull() & (second(modified) <= second(if_modified)), "modified_since")
    )


def tags_of(wire: Column, limit: int = MAX_TAGS) -> Column:
    """A map from k=v&k=v with percent escapes; an invalid text (no =, too many, too long, a key twice) is an empty map."""
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    pairs = F.filter(F.split(wire, "&"), lambda p: p != "")
    cut = F.transform(pairs, lambda p: F.split(p, "=", 2))
    both = F.transform(cut, lambda p: F.struct(decoded(p[0]).alias("k"), decoded(F.get(p, F.lit(1))).alias("v")))
    fits = lambda c, most: c.rlike(TAG_TEXT) & (F.char_length(c) <= most)
    valid = F.forall(both, lambda p: F.coalesce((p["k"] != "") & fits(p["k"], MAX_TAG_KEY) & fits(p["v"], MAX_TAG_VALUE), F.lit(False)))
    keys = F.transform(both, lambda p: p["k"])
    good = valid & (F.size(both) <= limit) & (F.size(F.array_distinct(keys)) == F.size(both))
    return F.map_from_entries(F.when(good, both).otherwise(F.array().cast("array<struct<k:string,v:string>>")))


def tags_wire(tags: Column) -> Column:
    """The tags in the order of their keys, with percent, equals, ampersand, plus and space escaped."""

    def escaped(c: Column) -> Column:
        for mark in "%=&+ ":
            c = F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
        return c

    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]))), "&")


def _like(patterns: list[str], fold: bool = False) -> str:
    body = "|".join(".*".join(map(re.escape, p.split("*"))) for p in patterns)
    return f"{'(?i)' if fold else ''}^(?:{body})$"


def cors_rule(rules: list[dict], origin: Column, method: Column, headers: Column | None = None) -> Column:
    """Number of the first rule (origins, methods, headers or none) that takes the origin, null if it refuses the
    method or a header; later rules are not tried. Without `headers`, they are not looked at."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        ok = F.upper(method).isin([m.upper() for m in r["methods"]])
        if headers is not None:
            allowed = r.get("headers")
            ok &= F.size(headers) == 0 if allowed is None else F.forall(headers, lambda h: h.rlike(_like(allowed, True)))
        out = F.when(origin.rlike(_like(r["origins"])), F.when(ok, k)).otherwise(out)
    return out
