"""SELECT over one object: CSV, JSON lines, a JSON document or Parquet."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.requests import scan_range
from quarry.plans.compiler import DEC, Compiler, Val, display, fail, is_null, number_of, to_number
from quarry.plans.parser import Agg, Plan, Ref, Unsupported, parse, references
from quarry.sources import json_rows
from quarry.sources.csv_rows import CsvFormat, inflate, read_csv

MAX_ROW = 1 << 20


@dataclass(frozen=True)
class Input:
    kind: str = "PARQUET"  # CSV, JSON_LINES, JSON_DOCUMENT or PARQUET
    compression: str | None = None
    csv: CsvFormat = field(default_factory=CsvFormat)
    scan: tuple[int | None, int | None] | None = None  # first and last byte; a last one alone: so many last bytes


@dataclass(frozen=True)
class CsvOutput:
    field: str = ","
    record: str = "\n"
    quote: str = '"'
    escape: str = '"'
    always: bool = False

    def __post_init__(self):
        if any(len(x.encode()) != 1 for x in (self.field, self.quote, self.escape)) or self.quote in (self.field, self.record):
            raise ValueError("delimiters are one byte and differ from the quote")


@dataclass
class Result:
    """Keys and compiled values of the output over rows; entries holds SELECT * rows whose keys vary."""

    rows: DataFrame
    keys: list[str]
    values: list[Val]
    star: str | None = None  # "cells" or "entries"
    head: list[str] | None = None  # names of the cells
    lines: DataFrame | None = None  # of SELECT *, the rows with their JSON as line
    unnamed: str | None = None  # the first item that is no plain reference and has no alias

    def frame(self) -> DataFrame:
        """Typed columns; numbers as decimals or the scan's own type, JSON values as text."""
        if self.star:
            return self.rows.select(self.star)
        return self.rows.select(*((v.native if v.native is not None else v.col).alias(k) for k, v in zip(self.keys, self.values)))

    def csv(self, out: CsvOutput | None = None) -> DataFrame:
        """A column value with a record's line each, without its delimiter."""
        o = out or CsvOutput()
        special = "[" + re.escape(o.field + o.record + o.quote) + "]"

        def cell(c: Column) -> Column:
            quoted = F.concat(F.lit(o.quote), F.replace(c, F.lit(o.quote), F.lit(o.escape + o.quote)), F.lit(o.quote))
            return quoted if o.always else F.when(c.rlike(special), quoted).otherwise(c)

        if self.star == "cells":
            plain = F.array_join("cells", o.field)
            cells = F.transform("cells", cell)
            line = F.array_join(cells, o.field) if o.always else F.when(F.array_join("cells", "").rlike(special), F.array_join(cells, o.field)).otherwise(plain)
        elif self.star == "entries":
            line = F.array_join(F.transform("entries", lambda e: cell(F.coalesce(e["text"], F.lit("")))), o.field)
        else:
            if any(v.kind == "json" for v in self.values):
                raise ValueError("nested: a list or struct has no CSV form")
            line = F.concat_ws(o.field, *(cell(F.coalesce(text(v), F.lit(""))) for v in self.values))
        return self._capped(line)

    def json(self) -> DataFrame:
        """A column value with a JSON object each; MISSING values have no key, NULL is null, numbers keep their text."""
        if self.star == "cells":
            names = F.array(*(F.lit(h) for h in self.head or [])).cast("array<string>")
            key = lambda k: F.coalesce(F.get(names, k), F.concat(F.lit("_"), k + 1))
            pairs = F.transform("cells", lambda c, k: F.concat(_quoted(key(k)), F.lit(":"), _quoted(c)))
            return self._capped(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
        if self.star == "entries":
            return self._capped(F.col("line"), self.lines)
        if self.unnamed is not None:
            raise ValueError(f"alias: {self.unnamed} needs one, to be a JSON key")
        pairs = []
        for k, v in zip(self.keys, self.values):
            body = _tagged(v.tag, v.col) if v.kind == "dyn" else F.coalesce(_quoted(v.col) if v.kind == "str" else text(v), F.lit("null"))
            pair = F.concat(_quoted(F.lit(k)), F.lit(":"), body)
            pairs.append(pair if v.present is None else F.when(v.present, pair))
        return self._capped(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")))

    def _capped(self, line: Column, rows: DataFrame | None = None) -> DataFrame:
        return (self.rows if rows is None else rows).select(F.when(F.octet_length(line) > MAX_ROW, fail("too large: a row of more than 1 MiB").cast("string")).otherwise(line).alias("value"))


def text(v: Val) -> Column:
    if v.kind == "num":
        return v.native.cast("string") if v.whole else display(v.col)
    if v.kind == "json":
        return F.to_json(v.col, {"ignoreNullFields": "false"})
    return v.col.cast("string")


def _quoted(c: Column) -> Column:
    """A JSON string literal: to_json of an array of one, without its brackets."""
    j = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), j.substr(F.lit(2), F.length(j) - 2))


def _tagged(tag: Column, body: Column) -> Column:
    return F.when(tag == "n", "null").when(tag == "s", _quoted(body)).otherwise(body)


def _native(name: str, kind: T.DataType) -> Val:
    c = F.col(f"`{name.replace('`', '``')}`")
    if isinstance(kind, T.BooleanType):
        return Val("bool", c)
    if isinstance(kind, T.IntegralType):
        return Val("num", c.cast("long"), native=c, whole=True)
    if isinstance(kind, T.DecimalType):
        if kind.precision > 28:
            raise ValueError("format: a decimal of more than 28 digits")
        return Val("num", c, native=c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        return Val("num", F.when(odd, fail("format: not a finite number").cast(DEC)).otherwise(c.cast(DEC)), native=c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
        return Val("str", F.concat(whole, part, F.lit("Z")))
    if isinstance(kind, T.DateType):
        return Val("str", F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return Val("json", c)
    if isinstance(kind, T.StringType):
        return Val("str", c)
    raise ValueError(f"format: {kind.simpleString()} has no SQL form")



def _missing() -> Val:
    return Val("null", F.lit(None).cast("string"), present=F.lit(False))


def _named(steps: tuple, alias: str | None) -> tuple:
    """The steps after the row's alias."""
    name, quoted = steps[0]
    own = {"s3object"} | ({alias.lower()} if alias else set())
    return steps[1:] if len(steps) > 1 and name.lower() in own and name not in ("[]", "[k]") else steps


def _match(names: list[str], step: tuple) -> int | None:
    name, quoted = step
    if name == "[k]":
        name, quoted = quoted, True
    hits = [k for k, n in enumerate(names) if n == name or (not quoted and n.lower() == name.lower())]
    if len(hits) > 1:
        raise ValueError(f"ambiguous: {name}")
    return hits[0] if hits else None


def _position(step: tuple) -> int | None:
    m = re.fullmatch(r"_([1-9][0-9]*)", step[0]) if not step[1] else None
    return int(m[1]) - 1 if m else None


def run(source: DataFrame, names: list[str] | None, plan: Plan, resolve, star: str | None) -> Result:
    compiler = Compiler(resolve)
    rows = source if plan.where is None else source.where(compiler.condition(plan.where))
    if plan.aggregate:
        return _aggregated(rows, plan, compiler)
    if plan.limit is not None:
        order = [c for c in ("record_start", "seq") if c in rows.columns]
        rows = rows.orderBy(*order).limit(plan.limit) if order else rows.limit(plan.limit)
    if not plan.projections:
        if star:
            return Result(rows, [], [], star)
        return Result(rows, names, [_native(n, rows.schema[n].dataType) for n in names])
    keys, values = [], []
    for e, alias, written in plan.projections:
        keys.append(alias or (e.name if isinstance(e, Ref) else written))
        values.append(compiler.value(e))
    return Result(rows, keys, values, unnamed=_unnamed(plan))


def _unnamed(plan: Plan) -> str | None:
    return next((written for e, alias, written in plan.projections if not alias and not isinstance(e, Ref)), None)


def _aggregated(rows: DataFrame, plan: Plan, compiler: Compiler) -> Result:
    """One row always; NULL and MISSING are skipped; sums and means are decimals."""
    out, keys = [], []
    for k, (e, alias, written) in enumerate(plan.projections):
        keys.append(alias or written)
        if e.arg is None:
            out.append(F.count(F.lit(1)).alias(f"a{k}"))
            continue
        v = compiler.value(e.arg)
        if e.fn == "count":
            out.append(F.count(F.when(~is_null(v), 1)).alias(f"a{k}"))
        elif e.fn == "sum":
            out.append(F.sum(v.native.cast("decimal(19,0)") if v.whole else number_of(v, strict=True)).alias(f"a{k}"))
        elif e.fn == "avg":
            n = number_of(v, strict=True)
            out.append(F.bround(F.sum(n) / F.nullif(F.count(n), F.lit(0)), 10).alias(f"a{k}"))
        else:
            fn = F.min if e.fn == "min" else F.max
            if v.kind == "null":
                out.append(F.max(F.lit(None).cast("string")).alias(f"a{k}"))
                continue
            if v.kind == "num":
                out.append(fn(v.native if v.native is not None else v.col).alias(f"a{k}"))
                continue
            if v.kind not in ("str", "dyn"):
                raise ValueError("value: MIN and MAX need numbers or strings")
            # the first contributor decides: numbers from then on, or text
            body, here = v.col, ~is_null(v)
            n = F.when(here, to_number(body))
            order = F.struct(*(c for c in ("record_start", "seq") if c in rows.columns)) if "record_start" in rows.columns else F.monotonically_increasing_id()
            numeric = F.min_by(n.isNotNull(), F.when(here, order))
            odd = F.count(F.when(here & n.isNull(), 1))
            number = F.when(odd > 0, fail("value: not a number").cast("string")).otherwise(display(fn(n)))
            out.append(F.when(numeric, number).otherwise(fn(F.when(here, body))).alias(f"a{k}"))
    result = rows.agg(*out)
    kinds = [result.schema[f"a{k}"].dataType for k in range(len(out))]
    return Result(result, keys, [Val("str", F.col(f"a{k}")) if isinstance(t, T.StringType) else _native(f"a{k}", t) if not isinstance(t, T.DecimalType) else Val("num", F.col(f"a{k}")) for k, t in enumerate(kinds)], unnamed=_unnamed(plan))


def select_frame(df: DataFrame, sql: str) -> Result:
    """SELECT over a typed frame, such as a Parquet scan; the columns the statement doesn't name are not read."""
    plan = parse(sql)
    if plan.path:
        raise Unsupported("a FROM path over Parquet")
    names = df.columns

    def resolve(ref: Ref) -> Val:
        steps = _named(ref.steps, plan.alias)
        at = _position(steps[0])
        at = _match(names, steps[0]) if at is None else at if at < len(names) else None
        if at is None:
            return _missing()
        v, present = _native(names[at], df.schema[at].dataType), None
        for s, flag in steps[1:]:
            kind = v.col is not None and df.select(v.col.alias("x")).schema["x"].dataType
            if s == "[]" and isinstance(kind, T.ArrayType):
                if flag < 0:
                    return _missing()
                c, t, here = F.get(v.col, F.lit(flag)), kind.elementType, F.coalesce(F.size(v.col) > flag, F.lit(False))
                present = here if present is None else present & here
            elif s != "[]" and isinstance(kind, T.StructType):
                k = _match(kind.names, (flag, True) if s == "[k]" else (s, flag))
                if k is None:
                    return _missing()
                c, t = v.col.getField(kind.names[k]), kind.fields[k].dataType
            else:
                return _missing()
            inner = _native("x", t)
            v = Val(inner.kind, c, native=c if inner.native is not None else None, present=present, whole=inner.whole)
        return v

    return run(df, names, plan, resolve, None)


def select(spark: SparkSession, path: str, sql: str, source: Input | None = None) -> Result:
    source = source or Input()
    plan = parse(sql)
    if source.kind == "PARQUET":
        if source.scan or source.compression not in (None, "", "NONE"):
            raise ValueError("Parquet takes neither a scan range nor a compression")
        return select_frame(spark.read.parquet(path), sql)
    if source.scan and source.compression in (None, "", "NONE"):
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        source = replace(source, scan=scan_range(*source.scan, size))
    if source.kind == "CSV":
        if plan.path:
            raise Unsupported("a FROM path over CSV")
        rows, head = read_csv(spark, path, source.csv, source.compression, source.scan)

        def cell(ref: Ref) -> Val:
            steps = _named(ref.steps, plan.alias)
            at = _position(steps[0]) if len(steps) == 1 else -1
            if at is None:
                at = _match(head, steps[0]) if head is not None else -1
                if at is None:
                    raise ValueError(f"missing header: {steps[0][0]}")
            if at < 0:
                return _missing()
            return Val("str", F.get("cells", F.lit(at)), present=F.size("cells") > at)

        result = run(rows, None, plan, cell, "cells")
        result.head = head
        return result
    refs = list(dict.fromkeys(r.steps for e in [*(p[0] for p in plan.projections), plan.where] if e is not None for r in references(e)))
    star = not plan.projections
    plain = source.compression in (None, "", "NONE")
    if source.kind == "JSON_LINES" and plain and not source.scan:
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    elif source.kind in ("JSON_LINES", "JSON_DOCUMENT"):
        # one task finds where the records begin; they are parsed by many
        unpack = inflate(source.compression)
        split = json_rows.line_splitter(unpack, source.scan) if source.kind == "JSON_LINES" else json_rows.element_splitter(unpack, source.scan)
        whole = spark.read.format("binaryFile").load(path).select("content")
        lines = whole.mapInArrow(split, "value string, at long").repartition(spark.sparkContext.defaultParallelism)
    else:
        raise ValueError(f"unknown input {source.kind}")
    made = lambda what: lines.mapInArrow(json_rows.reader(plan.path, refs, plan.alias, what, source.kind == "JSON_LINES"), json_rows.schema(len(refs)))

    def value(ref: Ref) -> Val:
        v = F.col("refs")[refs.index(ref.steps)]
        return Val("dyn", v["text"], present=v["present"], tag=v["tag"])

    result = run(made("entries" if star else None), None, plan, value, "entries")
    if star:  # whole rows as JSON are written where they are parsed
        result.lines = run(made("line"), None, plan, value, "line").rows
    return result


__all__ = ["Agg", "CsvOutput", "Input", "Result", "select", "select_frame"]
