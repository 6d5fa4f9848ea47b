"""JSON objects as rows, with number tokens, key order and MISSING kept.

A Python reader walks the FROM path and emits only what the statement refers to: for each reference a struct
(present, tag, text), and for SELECT * the row's entries in order. Tags: n null, b boolean, d number, s string,
j object or array. Line files are read line by line in parallel. Of a document one task finds the elements of
the root array, by its brackets, quotes and commas alone; they are parsed by many.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MISSING = object()
MAX_RECORD = 1 << 20
VALUE = "struct<present:boolean,tag:string,text:string>"


class Number(str):
    """A number's own text."""

    __slots__ = ()


class Entries(list):
    """An object's (key, value) pairs in order."""

    __slots__ = ()


def _constant(token: str):
    raise ValueError(f"format: {token} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_constant, object_pairs_hook=Entries)


def loads(text: str):
    """The value that a text spells, white space around it allowed."""
    return _DECODER.decode(text)


def load_element(text: str):
    """The value that begins a text; what separates it from the next element may follow."""
    value, end = _DECODER.raw_decode(text)
    if len(text) - end > 1 and text[end:].strip(" \t\r\n") not in ("", ","):
        raise ValueError("format: something follows an element")
    return value


_string = json.encoder.encode_basestring


def dumps(v) -> str:
    kind = type(v)
    if kind is Number:
        return v
    if kind is str:
        return _string(v)
    if kind is Entries:
        return "{" + ",".join([_string(k) + ":" + dumps(x) for k, x in v]) + "}"
    if kind is list:
        return "[" + ",".join([dumps(x) for x in v]) + "]"
    return "null" if v is None else "true" if v else "false"


def cell(v) -> tuple[bool, str | None, str | None]:
    if v is MISSING:
        return (False, "n", None)
    if v is None:
        return (True, "n", None)
    if isinstance(v, bool):
        return (True, "b", "true" if v else "false")
    if isinstance(v, Number):
        return (True, "d", str(v))
    return (True, "s", v) if isinstance(v, str) else (True, "j", dumps(v))


def lookup(v, name: str, exact: bool):
    """The value of a key; of equal keys the last. Two keys that differ in case only are ambiguous, unless exact."""
    if not isinstance(v, Entries):
        return MISSING
    found = {k: x for k, x in v if k == name or (not exact and k.lower() == name.lower())}
    if len(found) > 1:
        raise ValueError(f"ambiguous: {name}")
    return next(iter(found.values()), MISSING)


def walk(v, path: tuple) -> Iterator:
    """The rows that the FROM path makes of a root; one MISSING row where it leads nowhere."""
    if not path:
        yield v
        return
    step, rest = path[0], path[1:]
    if step[0] == "wild":
        if isinstance(v, Entries):
            inner = list(dict(v).values())
        else:
            inner = v if isinstance(v, list) else []
        if not inner:
            yield MISSING
        for x in inner:
            yield from walk(x, rest)
        return
    if step[0] == "name":
        x = lookup(v, step[1], exact=False)
    else:
        x = v[step[1]] if isinstance(v, list) and not isinstance(v, Entries) and 0 <= step[1] < len(v) else MISSING
    if x is MISSING:
        yield MISSING
    else:
        yield from walk(x, rest)


def resolve(row, steps: tuple, alias: str | None):
    """A reference's value: alias first, _1 as a key or the whole row, else a key; a scalar row answers to any name."""
    name, quoted = steps[0]
    rest = steps[1:]
    if name == "[]" or name == "[k]":
        return MISSING
    same = name == alias if quoted else alias is not None and name.lower() == alias.lower()
    if same or (not quoted and alias is None and name.lower() == "s3object"):
        v = row
        if not rest:
            return v
    else:
        v = _first(row, name, quoted)
    first = v is row and bool(rest)
    for s, flag in rest:
        if v is MISSING:
            return MISSING
        if s == "[]":
            v = v[flag] if isinstance(v, list) and not isinstance(v, Entries) and 0 <= flag < len(v) else MISSING
        elif s == "[k]":
            v = lookup(v, flag, exact=True)
        else:
            v = _first(v, s, flag) if first else lookup(v, s, exact=flag)
        first = False
    return v


def _first(row, name: str, quoted: bool):
    if row is MISSING:
        return MISSING
    if name == "_1" and not quoted:
        own = lookup(row, "_1", exact=True)
        return row if own is MISSING else own
    if not isinstance(row, list):
        return MISSING if quoted else row
    return lookup(row, name, exact=quoted)


def schema(n: int) -> str:
    return "record_start long, seq long, refs array<" + VALUE + ">, entries array<struct<key:string,tag:string,text:string>>, line string"


_OFFSETS = pa.int32()
_VALUE_NAMES, _ENTRY_NAMES = ["present", "tag", "text"], ["key", "tag", "text"]
#: Rows of a batch, and its bytes unless one record has more.
SIZE, _SLICE_BYTES = 5000, 32 << 20
_SPACE, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_MARK[list(b'",[]{}')] = True


class _Batch:
    """Columns of rows (record_start, seq, refs, entries), cell by cell."""

    def __init__(self, refs: int):
        self.refs = refs
        self.at, self.seq, self.ends = [], [], [0]
        self.present, self.tags, self.texts = [], [], []
        self.keys, self.entry_tags, self.entry_texts = [], [], []
        self.lines = []

    def value(self, v) -> None:
        here, tag, text = cell(v)
        self.present.append(here)
        self.tags.append(tag)
        self.texts.append(text)

    def entries(self, row: Entries) -> None:
        own = dict(row)
        keys, tags, texts = self.keys, self.entry_tags, self.entry_texts
        for k, v in own.items():
            keys.append(k)
            kind = type(v)
            if kind is Number:
                tags.append("d")
                texts.append(v)
            elif kind is str:
                tags.append("s")
                texts.append(v)
            else:
                _, tag, text = cell(v)
                tags.append(tag)
                texts.append(text)

    def row(self, at: int, seq: int) -> None:
        self.at.append(at)
        self.seq.append(seq)
        self.ends.append(len(self.keys))

    def arrow(self) -> pa.RecordBatch:
        text = pa.string()
        values = pa.StructArray.from_arrays([pa.array(self.present, pa.bool_()), pa.array(self.tags, text), pa.array(self.texts, text)], _VALUE_NAMES)
        refs = pa.ListArray.from_arrays(pa.array(np.arange(len(self.at) + 1) * self.refs, _OFFSETS), values)
        entries = pa.StructArray.from_arrays([pa.array(x, text) for x in (self.keys, self.entry_tags, self.entry_texts)], _ENTRY_NAMES)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.at, pa.int64()), pa.array(self.seq, pa.int64()), refs, pa.ListArray.from_arrays(pa.array(self.ends, _OFFSETS), entries), pa.array(self.lines or [None] * len(self.at), text)],
            ["record_start", "seq", "refs", "entries", "line"],
        )


def reader(path: tuple, refs: list[tuple], alias: str | None, star: str | None, lines: bool):
    """From batches (value, at) of records: lines, none of them blank, or the elements of a document. star: what
    a whole row becomes, "entries" or a JSON "line"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batch(len(refs))
        for batch in batches:
            for text, at in zip(batch.column("value").to_pylist(), batch.column("at").to_pylist()):
                if len(text) > MAX_RECORD // 4 and len(text.encode()) > MAX_RECORD:
                    raise ValueError("too large: a record of more than 1 MiB")
                if not lines:  # an empty root array has one MISSING record
                    root = load_element(text) if text else MISSING
                elif text.strip():
                    root = loads(text)
                else:
                    raise ValueError("format: a blank line")
                for seq, row in enumerate(walk(root, path)):
                    for r in refs:
                        out.value(resolve(row, r, alias))
                    if star == "line":
                        own = dict(row) if isinstance(row, Entries) else {}
                        out.lines.append(dumps(row if len(own) == len(row) else Entries(own.items())) if own else "{}")
                    elif star and isinstance(row, Entries):
                        out.entries(row)
                    out.row(at, seq)
                if len(out.at) >= SIZE:
                    yield out.arrow()
                    out = _Batch(len(refs))
        if out.at:
            yield out.arrow()

    return run


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(value, at) of the slices, in batches; what lies between a slice and the next goes with it."""
    lo = 0
    while lo < len(start):
        hi = min(lo + SIZE, max(lo + 1, int(np.searchsorted(end, start[lo] + _SLICE_BYTES, "right"))))
        base = int(start[lo])
        offsets = np.append(start[lo:hi], end[hi - 1]) - base
        values = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[base : int(end[hi - 1])].tobytes()))
        yield pa.RecordBatch.from_arrays([values, pa.array(start[lo:hi], pa.int64())], ["value", "at"])
        lo = hi


def _in_range(start: np.ndarray, scan) -> np.ndarray:
    """Records count where their first byte is in the range."""
    return np.ones(len(start), bool) if not scan else (start >= scan[0]) & (start <= (scan[1] if scan[1] is not None else start))


def line_splitter(unpack, scan):
    """From batches (content) of whole objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = np.frombuffer(unpack(content.as_py()), np.uint8)
                end = np.append(np.flatnonzero(data == 10), len(data))
                start = np.append(0, end[:-1] + 1)
                keep = _in_range(start, scan) & (start < len(data))
                yield from _slices(data, start[keep], end[keep])

    return run


def elements(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the root array's elements, white space and all; of any other root, of the whole."""
    whole = data.tobytes()
    first, last = len(data) - len(whole.lstrip(b" \t\r\n")), len(whole.rstrip(b" \t\r\n")) - 1
    if last < 0 or data[first] != 91:
        return np.array([0]), np.array([len(data)])
    marks = _MARK[data]
    slash = np.flatnonzero(data == 92)
    if len(slash):  # the second, fourth ... of a run of backslashes is escaped itself
        head = np.ones(len(slash), bool)
        head[1:] = np.diff(slash) > 1
        run = np.maximum.accumulate(np.where(head, np.arange(len(slash)), 0))
        escapes = slash[(np.arange(len(slash)) - run) % 2 == 0] + 1
        marks[escapes[escapes < len(data)]] = False
    marks = np.flatnonzero(marks)
    kind = data[marks]
    inside = np.cumsum(kind == 34) % 2 == 1
    marks, kind = marks[~inside & (kind != 34)], kind[~inside & (kind != 34)]
    depth = np.cumsum(((kind | 32) == 123).astype(np.int64) - ((kind | 32) == 125))
    closed = np.flatnonzero(depth == 0)
    if not len(closed) or marks[closed[0]] != last or kind[closed[0]] != 93:
        raise ValueError("format: the document does not end with its root array")
    cuts = marks[(depth == 1) & (kind == 44)]
    start, end = np.append(first, cuts) + 1, np.append(cuts, last)
    if len(start) == 1 and not bytes(data[start[0] : end[0]]).strip():
        return start[:0], end[:0]
    return start, end


def element_splitter(unpack, scan):
    """From batches (content) of whole documents. A root array has a record for each element; an empty one MISSING."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = np.frombuffer(unpack(content.as_py()), np.uint8)
                if not len(data):
                    continue
                start, end = elements(data)
                if not len(start):
                    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], pa.int64())], ["value", "at"])
                    continue
                while len(early := np.flatnonzero(_SPACE[data[np.minimum(start, len(data) - 1)]] & (start < end))):
                    start[early] += 1  # of an element, not of the space before it
                if (start >= end).any():
                    raise ValueError("format: an element is missing")
                keep = _in_range(start, scan)
                yield from _slices(data, start[keep], end[keep])

    return run
