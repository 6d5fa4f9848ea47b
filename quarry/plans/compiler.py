"""Expressions -> Columns.

A compiled value knows its class statically where it can: num, str, bool, null; or dyn, whose class is in the
data (JSON). NULL and MISSING are kept apart by a presence column. Comparisons that can't be decided are
FALSE, IN and BETWEEN are UNKNOWN then. Typed columns against literals of their class compile to the
bare comparison, so that they reach the scan as pushed filters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.parser import Lit, Num, Op, Ref

#: Numbers that are no integers: 28 digits before the point and 10 behind it.
DEC = "decimal(38,10)"
LIKE_CELLS = 10_000_000
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass
class Val:
    """kind: num | str | bool | null | dyn | json. For dyn, tag is one of n(ull) b d(igits) s j and col the text."""

    kind: str
    col: Column
    present: Column | None = None
    tag: Column | None = None
    native: Column | None = None  # a scan's own numeric column, to compare without a cast
    whole: bool = False  # native is of an integral type


def fail(text: str) -> Column:
    return F.raise_error(F.lit(text))


def to_number(text: Column) -> Column:
    """The decimal that a text spells, else null; more than 28 digits are an error."""
    ok = text.rlike(_NUMBER)
    digits = F.length(F.regexp_replace(F.regexp_replace(text, r"[eE].*$", ""), r"[^0-9]", ""))
    return F.when(~ok, F.lit(None).cast(DEC)).when((F.length(text) > 28) & (digits > 28), fail("value: more than 28 digits").cast(DEC)).otherwise(text.try_cast(DEC))


def display(number: Column) -> Column:
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def number_of(v: Val, strict: bool = False) -> Column:
    """The value as a decimal; what is no number is null, or an error if strict."""
    if v.kind == "num":
        return v.col.cast(DEC)
    if v.kind == "null":
        return F.lit(None).cast(DEC)
    if v.kind == "str":
        n = to_number(v.col)
        return F.when(v.col.isNotNull() & n.isNull(), fail("value: not a number").cast(DEC)).otherwise(n) if strict else n
    if v.kind == "dyn":
        n = F.when(v.tag.isin("d", "s"), to_number(v.col))
        return F.when((v.tag != "n") & n.isNull(), fail("value: not a number").cast(DEC)).otherwise(n) if strict else n
    return F.when(v.col.isNotNull(), fail("value: not a number").cast(DEC)) if strict else F.lit(None).cast(DEC)


def is_null(v: Val) -> Column:
    return F.lit(True) if v.kind == "null" else v.tag == "n" if v.kind == "dyn" else v.col.isNull()


def _is(v: Val, tag: str) -> Column:
    kinds = {"s": "str", "d": "num", "b": "bool"}
    return v.tag == tag if v.kind == "dyn" else F.lit(v.kind == kinds[tag]) & v.col.isNotNull() if v.kind != "null" else F.lit(False)


def comparison(op: str, a: Val, b: Val) -> Column:
    """TRUE, FALSE or NULL (can't be compared)."""
    run = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    null = F.lit(None).cast("boolean")
    if "null" in (a.kind, b.kind) or "json" in (a.kind, b.kind):
        return null
    if a.kind == b.kind == "bool":
        return run(a.col, b.col) if op in ("=", "!=") else null
    if a.kind == b.kind == "str":
        return run(a.col, b.col)
    if a.kind == b.kind == "num":
        return run(a.native if a.native is not None else a.col, b.native if b.native is not None else b.col)
    if "dyn" not in (a.kind, b.kind):
        return null if "bool" in (a.kind, b.kind) else run(number_of(a), number_of(b))
    out = F.when(_is(a, "s") & _is(b, "s"), run(a.col.cast("string"), b.col.cast("string")))
    out = out.when((_is(a, "d") | _is(b, "d")) & ~_is(a, "b") & ~_is(b, "b"), run(number_of(a), number_of(b)))
    return out.when(_is(a, "b") & _is(b, "b"), run(a.col.cast("string"), b.col.cast("string"))) if op in ("=", "!=") else out


def truth(v: Val) -> Column:
    """A condition's value: boolean, or null for NULL; anything else is false."""
    if v.kind == "bool":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    if v.kind == "dyn":
        return F.when(v.tag == "b", v.col == "true").when(v.tag == "n", F.lit(None).cast("boolean")).otherwise(False)
    return F.when(v.col.isNotNull(), F.lit(False))


def like_regex(pattern: str, escape: str | None) -> str:
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if escape and c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append("." if c == "_" else ".*" if c == "%" else re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + r"\z"


def like(v: Val, p: Val, pattern, escape: str | None, negated: bool) -> Column:
    """False, negated or not, if either side is no string."""
    if isinstance(pattern, Lit) and isinstance(pattern.value, str):
        if v.kind not in ("str", "dyn"):
            return F.lit(False)
        body = pattern.value
        plain = body.strip("%")
        simple = not (escape and escape in body) and "_" not in body and "%" not in plain
        if simple and not body.startswith("%") and not body.endswith("%"):
            hit = v.col == plain
        elif simple and plain and not body.startswith("%"):
            hit = v.col.startswith(plain)
        elif simple and plain and not body.endswith("%"):
            hit = v.col.endswith(plain)
        elif simple and plain:
            hit = v.col.contains(plain)
        else:
            hit = v.col.rlike(like_regex(body, escape))
        many = F.length(v.col).cast("long") * (len(body) + 1) > LIKE_CELLS
        hit = hit if simple else F.when(many, fail("value: LIKE is too large").cast("boolean")).otherwise(hit)
        return F.coalesce(_is(v, "s") & (~hit if negated else hit), F.lit(False))
    if v.kind not in ("str", "dyn") or p.kind not in ("str", "dyn"):
        return F.lit(False)
    body = pattern_regex(p.col, escape)
    hit = F.regexp_like(v.col, body)
    return F.coalesce(_is(v, "s") & _is(p, "s") & (~hit if negated else hit), F.lit(False))


def pattern_regex(pattern: Column, escape: str | None) -> Column:
    """A LIKE pattern from the data as a regular expression, character by character."""
    quote = lambda c: F.when(c.rlike("^[A-Za-z0-9 ]$"), c).otherwise(F.concat(F.lit("\\Q"), c, F.lit("\\E")))
    pair = lambda r, e: F.struct(r.alias("r"), e.alias("e"))

    def step(a: Column, c: Column) -> Column:
        wild = F.when(c == "_", F.lit(".")).when(c == "%", F.lit(".*")).otherwise(quote(c))
        plain = pair(F.concat(a["r"], wild), F.lit(False))
        if escape is None:
            return plain
        return F.when(a["e"], pair(F.concat(a["r"], quote(c)), F.lit(False))).when(c == F.lit(escape), pair(a["r"], F.lit(True))).otherwise(plain)

    chars = F.filter(F.split(pattern, ""), lambda c: c != "")
    last = lambda a: F.concat(a["r"], F.when(a["e"], quote(F.lit(escape or ""))).otherwise(""), F.lit("\\z"))
    return F.aggregate(chars, pair(F.lit("(?s)^"), F.lit(False)), step, last)


def _exact(x: Column, y: Column, run, *kinds: str) -> Column:
    """run over both sides in the first of the kinds that holds the two values unchanged; else as they are.

    Decimals of 38 digits leave an operation few digits behind the point, those of fewer digits enough."""
    out = run(x, y)
    for kind in reversed(kinds):
        a, b = x.try_cast(kind), y.try_cast(kind)
        out = F.when((a == x) & (b == y), run(a, b)).otherwise(out)
    return out


def _integral(v: Val) -> Column:
    """A whole number of 64 bits; anything else is an error."""
    if v.whole:
        return v.native.cast("long")
    n = number_of(v, strict=True)
    whole = F.when(F.floor(n) == n, n.try_cast("long"))
    return F.when(n.isNotNull() & whole.isNull(), fail("value: % needs integers").cast("long")).otherwise(whole)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "%":
        x, y = _integral(a), _integral(b)
        rest = F.when(y == 0, fail("value: division by zero").cast("long")).otherwise(x % F.nullif(y, F.lit(0).cast("long")))
        return Val("num", rest, native=rest, whole=True)
    if a.whole and b.whole and op in "+-*":  # 64 bits while they fit, else decimal
        fn = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        x, y = a.native.cast("long"), b.native.cast("long")
        wide, tall = ((v.native.cast("decimal(28,0)"), v.native.cast("decimal(19,0)")) for v in (a, b))
        big = wide[0] + tall[0] if op == "+" else wide[0] - tall[0] if op == "-" else wide[1] * tall[1]
        return Val("num", F.coalesce(fn(x, y).cast("decimal(38,0)"), big.cast("decimal(38,0)")))
    x, y = number_of(a, strict=True), number_of(b, strict=True)
    if op in "+-":
        x, y = x.cast("decimal(37,10)"), y.cast("decimal(37,10)")
        return Val("num", (x + y if op == "+" else x - y).cast(DEC))
    if op == "*":
        out = _exact(x, y, lambda p, q: (p * q).cast(DEC), "decimal(18,9)")
        return Val("num", out)
    by = lambda p, q: F.bround(p / F.nullif(q, F.lit(0)), 10).cast(DEC)
    out = by(a.native.cast("decimal(19,0)"), b.native.cast("decimal(19,0)")) if a.whole and b.whole else _exact(x, y, by, "decimal(18,9)", "decimal(28,10)")
    return Val("num", F.when(y == 0, fail("value: division by zero").cast(DEC)).otherwise(out))


class Compiler:
    """resolve: Ref -> Val of the source at hand."""

    def __init__(self, resolve):
        self.resolve = resolve

    def value(self, e) -> Val:
        if isinstance(e, Ref):
            return self.resolve(e)
        if isinstance(e, Lit):
            if e.value is None:
                return Val("null", F.lit(None))
            return Val("bool", F.lit(e.value)) if isinstance(e.value, bool) else Val("str", F.lit(e.value))
        if isinstance(e, Num):
            if e.text.isdigit() and int(e.text) < 2**63:
                return Val("num", F.lit(int(e.text)).cast("long"), native=F.lit(int(e.text)), whole=True)
            if sum(c.isdigit() for c in re.sub(r"[eE].*", "", e.text)) > 28:
                raise ValueError("value: more than 28 digits")
            return Val("num", F.lit(e.text).cast(DEC))
        if e.op in ("+", "-", "*", "/", "%"):
            return arithmetic(e.op, self.value(e.args[0]), self.value(e.args[1]))
        if e.op in ("neg", "pos"):
            v = self.value(e.args[0])
            if v.whole:
                return Val("num", -v.native.cast("decimal(20,0)")) if e.op == "neg" else v
            n = number_of(v, strict=True)
            return Val("num", -n if e.op == "neg" else n)
        if e.op == "nested":
            return self.value(e.args[0])
        return Val("bool", self.condition(e, exact=True))

    def condition(self, e, exact: bool = False) -> Column:
        """A boolean column. Unless exact, NULL may stand for FALSE, as only TRUE passes a filter."""
        if not isinstance(e, Op) or e.op in ("+", "-", "*", "/", "%", "neg", "pos"):
            return truth(self.value(e))
        a = e.args
        if e.op == "nested":
            return self.condition(a[0], exact)
        if e.op in ("and", "or"):
            x, y = (self.condition(p, exact) for p in a)
            return x & y if e.op == "and" else x | y
        if e.op == "not":
            return ~self.condition(a[0], exact=True)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            c = comparison(e.op, self.value(a[0]), self.value(a[1]))
            return F.coalesce(c, F.lit(False)) if exact else c
        if e.op == "in":
            v = self.value(a[0])
            out = F.lit(False)
            for item in a[1:]:
                w = self.value(item)
                same = F.when(is_null(v) | is_null(w), F.lit(None).cast("boolean")).otherwise(F.coalesce(comparison("=", v, w), F.lit(False)))
                out = out | same
            return out
        if e.op == "between":
            v, lo, hi = (self.value(p) for p in a)
            low, high = comparison(">=", v, lo), comparison("<=", v, hi)
            return F.when(low.isNotNull() & high.isNotNull(), low & high) if exact else low & high
        if e.op in ("like", "not like"):
            escape = a[2].value if a[2] is not None else None
            return like(self.value(a[0]), self.value(a[1]), a[1], escape, e.op == "not like")
        if e.op == "is not":
            return ~F.coalesce(self.condition(a[0], exact=True), F.lit(False))
        v = self.value(a[0])
        here = v.present if v.present is not None else F.lit(True)
        if e.op == "is missing":
            return ~here
        if e.op == "is null":
            return here & is_null(v)
        want = e.op == "is true"
        return F.coalesce(here & _is(v, "b") & (truth(v) == want), F.lit(False))
