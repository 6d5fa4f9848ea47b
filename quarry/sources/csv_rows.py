"""CSV records as arrays of cells: ragged rows, comments and quoted record delimiters.

Records of one line are split by the JVM in parallel. Where some line has a quote left open, a first pass learns what
each line does to an open and to a closed quote, the driver carries this from split to split, and a second pass joins
the lines of each record, in parallel, too. Where an escape is no quote, a scan range needs record offsets, or the
object is compressed, one task reads the object whole; lines without a quote are cut at once there, too.
"""

from __future__ import annotations

import bz2
import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RECORD = 1 << 20


@dataclass(frozen=True)
class CsvFormat:
    field: str = ","
    record: str = "\n"
    quote: str = '"'
    escape: str = '"'
    comments: str | None = None
    header: str = "NONE"  # USE, IGNORE or NONE
    multiline: bool = True


def inflate(kind: str | None):
    """Whole content of an object, all members of it."""
    if kind in (None, "", "NONE"):
        return lambda b: b
    if kind == "GZIP":
        return gzip.decompress
    if kind == "BZIP2":
        return bz2.decompress
    raise ValueError(f"unsupported: compression {kind}")


def records(data: bytes, f: CsvFormat) -> Iterator[tuple[int, list[str]]]:
    """(offset of the first byte, cells) of each record that isn't a comment."""
    text, quote, escape = data.decode(), f.quote, f.escape
    at, n, byte = 0, len(text), 0
    ascii_only = text.isascii()
    while at < n:
        start = at
        if f.comments and text[at] == f.comments:
            end = text.find(f.record, at)
            at = n if end < 0 else end + len(f.record)
            byte += at - start if ascii_only else len(text[start:at].encode())
            continue
        end = text.find(f.record, at)
        end = n if end < 0 else end
        if text.find(quote, at, end) < 0:  # nothing quoted
            cells, at = text[at:end].split(f.field), end
            yield from _record(cells, start, min(n, at + len(f.record)), byte, f)
            at = min(n, at + len(f.record))
            byte += at - start if ascii_only else len(text[start:at].encode())
            continue
        cells, cell, quoted = [], [], False
        while at < n:
            c = text[at]
            if quoted:
                if escape == quote and c != quote:  # all up to the next quote
                    end = text.find(quote, at)
                    end = n if end < 0 else end
                    cell.append(text[at:end])
                    at = end
                    continue
                if c == escape and at + 1 < n and (text[at + 1] == quote or (escape != quote and text[at + 1] == escape)):
                    cell.append(text[at + 1])
                    at += 2
                    continue
                if c == quote:
                    quoted = False
                else:
                    cell.append(c)
                at += 1
            elif c == quote and not cell:
                quoted, at = True, at + 1
            elif c == f.field:
                cells.append("".join(cell))
                cell, at = [], at + 1
            elif text.startswith(f.record, at):
                break
            else:
                cell.append(c)
                at += 1
        cells.append("".join(cell))
        at = min(n, at + len(f.record))
        yield from _record(cells, start, at, byte, f)
        byte += at - start if ascii_only else len(text[start:at].encode())


def _record(cells: list[str], start: int, end: int, byte: int, f: CsvFormat) -> Iterator[tuple[int, list[str]]]:
    if f.record == "\n" and cells[-1].endswith("\r"):
        cells[-1] = cells[-1][:-1]
    if cells != [""]:
        if end - start > MAX_RECORD // 4 and sum(len(c.encode()) + 1 for c in cells) > MAX_RECORD:
            raise ValueError("too large: a record of more than 1 MiB")
        yield byte, cells


def _one_line_each(spark: SparkSession, path: str, f: CsvFormat) -> bool:
    """Whether each line with a quote is whole cells, plain or quoted, and no other escape is in use."""
    value, q, d = F.col("value"), re.escape(f.quote), re.escape(f.field)
    cell = f"(?:[^{q}{d}]*+|{q}(?:[^{q}]++|{q}{q})*+{q})"
    odd = ~value.rlike(f"^{cell}(?:{d}{cell})*+\r?$") if f.escape == f.quote else F.lit(True)
    return spark.read.text(path, lineSep=f.record).where(value.contains(f.quote) & odd).isEmpty()


class _Quotes:
    """Patterns of cells whose escape is the quote; a quote within a plain cell is text, as is what follows a closed one."""

    def __init__(self, f: CsvFormat):
        q, d = re.escape(f.quote), re.escape(f.field)
        self.body = f"(?:[^{q}]++|{q}{q})*+"
        self.cell = f"{d}(?:{q}{self.body}(?:{q}[^{d}]*+|\\z)|[^{d}]*+)"
        whole = f"(?:{q}{self.body}{q}[^{d}]*+|(?!{q})[^{d}]*+)"
        self.opens = f"^(?:{whole}{d})*+{q}{self.body}\\z"  # from between two records
        self.keeps = f"^{self.body}(?:{q}[^{d}]*+(?:{d}{whole})*+{d}{q}{self.body})?+\\z"  # from within quotes
        self.parts = f"(?s)^{q}({self.body})(?:{q}(.*))?+\\z"


def _cells(value: Column, f: CsvFormat) -> Column:
    """The cells of a record, with or without quotes and record delimiters in them."""
    at = _Quotes(f)

    def cell(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, at.parts, 1), F.lit(f.quote * 2), F.lit(f.quote))
        return F.when(c.startswith(f.quote), F.concat(inner, F.regexp_extract(c, at.parts, 2))).otherwise(c)

    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(f.field), value), F.lit(at.cell), F.lit(0)), lambda c: cell(F.substr(c, F.lit(2))))
    return F.when(value.contains(f.quote), quoted).otherwise(F.split(value, re.escape(f.field), -1))


def _after(code: np.ndarray, open_before: bool) -> np.ndarray:
    """Whether a quote is open after each line. Of a code, bit 0 is that after none was open, bit 1 after one was."""
    turns = np.cumsum(code == 1) % 2 == 1
    last = np.maximum.accumulate(np.where((code == 0) | (code == 3), np.arange(len(code)), -1))
    return np.where(last >= 0, (code[last] == 3) ^ turns[last], open_before) ^ turns


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(file and block, first row, end) of the rows of each split in a batch."""
    file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(file)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield (int(file[a]), int(block[a])), a, b


_SPLIT = ["file", "block", "first", "n", "size", "end0", "end1", "tail0", "tail0_at", "tail1", "tail1_at", "head", "head_size"]


def _splits(width: int):
    """A row for each split: its lines and bytes, and for both states before it the state after, the line (id and byte) where the record left open began, and the last line of a record that was open before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], dict] = {}
        for batch in batches:
            for key, a, b in _runs(batch):
                code, size = batch.column("code").to_numpy()[a:b], np.cumsum(batch.column("size").to_numpy()[a:b].astype(np.int64) + width)
                first = batch.column("id")[a].as_py()
                x = found.setdefault(key, dict.fromkeys(_SPLIT) | {"file": key[0], "block": key[1], "first": first, "n": 0, "size": 0, "end0": 0, "end1": 1})
                for state in (0, 1):
                    after = _after(code, bool(x[f"end{state}"]))
                    before = np.concatenate([[bool(x[f"end{state}"])], after[:-1]])
                    opening = np.flatnonzero(~before & after)
                    if len(opening):
                        k = int(opening[-1])
                        x |= {f"tail{state}": first + k, f"tail{state}_at": x["size"] + (int(size[k - 1]) if k else 0)}
                    if state and x["head"] is None and not after.all():
                        k = int(np.argmin(after))
                        x |= {"head": first + k, "head_size": x["size"] + int(size[k])}
                    x[f"end{state}"] = int(after[-1])
                x["n"] += b - a
                x["size"] += int(size[-1])
        if found:
            yield pa.RecordBatch.from_pylist(list(found.values()), pa.schema([(c, pa.int64()) for c in _SPLIT]))

    return run


def _carried(splits: list, files: list, width: int) -> tuple[dict, list]:
    """What each split has to know, and the pieces of records that lie in several splits or are left open by the end of a file.

    A split's: byte of its first line, byte of its file, first line (id) after a record begun before, line where one begins that is left open.
    A piece: partition, first and last line, byte of the record, byte of the file, place in the record, and what follows it.
    """
    own: dict[int, list] = {}
    for x in splits:
        own.setdefault(x["file"], []).append(x)
    known, pieces, base = {}, [], 0
    for file in sorted(files, key=lambda r: r["path"]):
        at, left, size, k = base, None, 0, 0  # left: byte of the open record

        def piece(lo: int, hi: int, more: int) -> None:
            nonlocal size, k
            size, k = size + more, k + 1
            if size > 3 * MAX_RECORD + width:  # a quote of a cell is three bytes at most
                raise ValueError("too large: a record of more than 1 MiB")
            pieces.append((lo >> 33, lo, hi, left, base, k, None))

        for x in sorted(own.get(file["file"], []), key=lambda r: r["block"]):
            last, begin, state = x["first"] + x["n"] - 1, x["first"], int(left is not None)
            if left is not None:
                begin = (last if x["head"] is None else x["head"]) + 1
                piece(x["first"], begin - 1, x["size"] if x["head"] is None else x["head_size"])
            tail = x[f"tail{state}"] if x[f"end{state}"] else None
            if tail is not None:
                left, size, k = at + x[f"tail{state}_at"], 0, 0
                piece(tail, last, x["size"] - x[f"tail{state}_at"])
            elif not x[f"end{state}"]:
                left = None
            known[x["file"], x["block"]] = (at, base, begin, last + 1 if tail is None else tail)
            at += x["size"]
        if left is not None and at - base in (file["length"], file["length"] - 3):  # (less a byte order mark) the last line has its delimiter
            pieces[-1] = (*pieces[-1][:-1], True)
        base = at
    return known, pieces


def _joined(known: dict, f: CsvFormat):
    """(record_start, file, value) of the records that lie within a split."""
    width = len(f.record.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, held, held_at, held_size = None, 0, None, 0, 0
        for batch in batches:
            for key, a, b in _runs(batch):
                start, base, begin, end = known[key]
                if key != here:
                    here, at, held, held_size = key, start, None, 0
                size = np.cumsum(batch.column("size").to_numpy()[a:b].astype(np.int64) + width)
                byte = at + np.concatenate([[0], size])
                at = int(byte[-1])
                first = batch.column("id")[a].as_py()
                lo, hi = max(0, begin - first), min(b - a, end - first)
                if lo >= hi:
                    continue
                after = _after(batch.column("code").to_numpy()[a + lo : a + hi], held is not None)
                starts = np.flatnonzero(~np.concatenate([[held is not None], after[:-1]]))
                lines, where = batch.column("value").slice(a + lo, hi - lo), byte[lo:hi][starts]
                if held is not None:
                    starts, where = np.concatenate([[0], starts + len(held)]), np.concatenate([[held_at], where])
                    lines = pa.concat_arrays([held, lines])
                ends = np.append(starts[1:], len(lines))
                if after[-1]:
                    held, held_at, held_size = lines.slice(int(starts[-1])), int(where[-1]), int(byte[hi] - where[-1])
                    if held_size > 3 * MAX_RECORD + width:
                        raise ValueError("too large: a record of more than 1 MiB")
                    starts, where, ends = starts[:-1], where[:-1], ends[:-1]
                else:
                    held = None
                if len(starts):
                    offsets = pa.array(np.append(starts, ends[-1]), pa.int32())
                    value = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), f.record)
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(np.full(len(where), base), pa.int64()), value], ["record_start", "file", "value"])

    return run


def _read_open(spark: SparkSession, path: str, f: CsvFormat) -> tuple[DataFrame, list[str] | None]:
    """Records of one line or several, each file on its own; record_start is the first byte, counted through the files."""
    at, width = _Quotes(f), len(f.record.encode())
    file = F.xxhash64("_metadata.file_path").alias("file")
    scan = spark.read.text(path, lineSep=f.record).select(F.monotonically_increasing_id().alias("id"), file, F.col("_metadata.file_block_start").alias("block"), "value")
    # the RDD of a plan keeps its splits, another plan over the same files may have others
    lines = DataFrame(spark._jsparkSession.internalCreateDataFrame(scan._jdf.queryExecution().toRdd(), scan._jdf.schema(), False), spark)
    value = F.col("value")
    opens = value.rlike(at.opens) & (~value.startswith(f.comments) if f.comments else F.lit(True))
    code = F.when(~value.contains(f.quote), 2).otherwise(opens.cast("int") + 2 * value.rlike(at.keeps).cast("int"))
    coded = lines.select("id", "file", "block", F.octet_length("value").alias("size"), code.alias("code"), "value")
    splits = coded.drop("value").mapInArrow(_splits(width), ", ".join(f"{c} long" for c in _SPLIT)).collect()
    files = spark.read.format("binaryFile").load(path).select(file, F.col("_metadata.file_path").alias("path"), "length").collect()
    known, pieces = _carried(splits, files, width)
    found = coded.mapInArrow(_joined(known, f), "record_start long, file long, value string")
    if pieces:
        cut = F.broadcast(spark.createDataFrame(pieces, "part long, lo long, hi long, record_start long, base long, k int, ends boolean"))
        own = lines.select("id", "value").join(cut, (F.shiftright("id", 33) == F.col("part")) & F.col("id").between(F.col("lo"), F.col("hi")))
        own = own.groupBy("record_start", F.col("base").alias("file")).agg(F.array_sort(F.collect_list(F.struct("k", "id", "value"))).alias("lines"), F.bool_or("ends").alias("ends"))
        text = F.array_join(F.transform("lines", lambda x: x["value"]), f.record)
        found = found.unionAll(own.select("record_start", "file", F.when(F.col("ends"), F.concat(text, F.lit(f.record))).otherwise(text).alias("value")))
    if f.comments:
        found = found.where(~value.startswith(f.comments))
    if f.record == "\n":
        found = found.withColumn("value", F.when(F.endswith(value, F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(value))
    found = found.where(~value.isin("", f.quote, f.quote * 2))
    cells = _cells(value, f)
    large = (F.octet_length(value) >= MAX_RECORD) & (F.aggregate(cells, F.lit(0), lambda n, c: n + F.octet_length(c) + 1) > MAX_RECORD)
    bad = F.when(~F.is_valid_utf8(value), "format: not UTF-8").when(large, "too large: a record of more than 1 MiB")
    rows = found.select("record_start", F.lit(0).cast("long").alias("seq"), F.when(bad.isNotNull(), F.raise_error(bad).cast("array<string>")).otherwise(cells).alias("cells"), "file")
    if f.header == "NONE":
        return rows.drop("file"), None
    heads = rows.groupBy("file").agg(F.min("record_start").alias("at"), F.min_by("cells", "record_start").alias("cells")).orderBy("file").collect()
    rows = rows.where(~F.col("record_start").isin([h["at"] for h in heads])).drop("file")
    return rows, ([] if not heads else heads[0]["cells"]) if f.header == "USE" else None


def read_csv(spark: SparkSession, path: str, f: CsvFormat, compression: str | None = None, scan: tuple[int, int | None] | None = None) -> tuple[DataFrame, list[str] | None]:
    """(rows (record_start, seq, cells), header names or None)."""
    plain = not scan and compression in (None, "", "NONE")
    whole_lines = plain and (not f.multiline or _one_line_each(spark, path, f))
    if plain and not whole_lines and f.escape == f.quote and len(f.record) == 1:
        return _read_open(spark, path, f)
    if not whole_lines:
        unpack = inflate(compression)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content").to_pylist():
                    held: list[tuple[int, list[str]]] = []
                    for k, (at, cells) in enumerate(records(unpack(content), f)):
                        if k == 0 and f.header != "NONE":
                            continue
                        if scan and (at < scan[0] or (scan[1] is not None and at > scan[1])):
                            continue
                        held.append((at, cells))
                        if len(held) == 5000:
                            yield pack(held)
                            held = []
                    if held:
                        yield pack(held)

        def pack(held):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([0] * len(held), pa.int64()), pa.array([r[1] for r in held], pa.list_(pa.string()))], ["record_start", "seq", "cells"])

        whole = spark.read.format("binaryFile").load(path)
        rows = whole.select("content").mapInArrow(run, "record_start long, seq long, cells array<string>")
        head = None
        if f.header == "USE":

            def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for content in batch.column("content").to_pylist():
                        yield pack([next(records(unpack(content), f), (0, []))])

            # the cells of the first record alone reach the driver
            found = whole.select("content").mapInArrow(first, "record_start long, seq long, cells array<string>").first()
            head = found["cells"] if found else []
        return rows, head
    # a record is a line: split after each delimiter that an even number of quotes follows
    lines = spark.read.text(path, lineSep=f.record).withColumn("record_start", F.monotonically_increasing_id()).where("value <> ''")
    if f.comments:
        lines = lines.where(~F.col("value").startswith(f.comments))
    if f.record == "\n":
        lines = lines.withColumn("value", F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    lines = lines.withColumn("value", F.when(F.octet_length("value") > MAX_RECORD, F.raise_error(F.lit("too large: a record of more than 1 MiB")).cast("string")).otherwise(F.col("value")))
    q, d = ("\\" + f.quote), ("\\" + f.field)
    plain = F.split("value", d, -1)
    cells = F.split("value", f"{d}(?=(?:[^{q}]*{q}[^{q}]*{q})*[^{q}]*$)", -1)
    strip = F.transform(cells, lambda c: F.when(c.startswith(f.quote) & c.endswith(f.quote) & (F.length(c) > 1), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit(f.escape + f.quote), F.lit(f.quote))).otherwise(c))
    rows = lines.select("record_start", F.lit(0).cast("long").alias("seq"), F.when(F.col("value").contains(f.quote), strip).otherwise(plain).alias("cells"))
    if f.header == "NONE":
        return rows, None
    first = rows.first()  # of the object's first split, which alone is read
    return (rows.where(F.col("record_start") != first["record_start"]) if first else rows), (list(first["cells"]) if first and f.header == "USE" else None)


__all__ = ["CsvFormat", "inflate", "read_csv", "records"]
