"""Removal of long repeated word sequences.

Every window of a fixed number of words gets a Rabin-Karp hash. The windows are dealt over the cluster by
a second, independent hash and counted there; of equal windows the earliest (smaller document id, then
earlier start) stays, the words of the others go. Adjoining windows are merged into maximal intervals.

* A task first drops windows that it has met itself, so that a sequence in a third of all documents sends
  about one row a task, not one a document.
* Only 64-bit hashes and one-byte steps between starts travel, never the text of a window. Equal windows
  must agree in the hash and in the partition that the second hash names: 64 + log2(partitions) bits.
* spark.sql.shuffle.partitions should leave a partition a few ten million windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._spark import NULL_ID, cut, documents, partitions, real_id

WINDOW = 20
#: Windows that a task holds before it sends them.
HELD = 400_000
#: Documents of a batch of intervals.
BATCH = 50_000
_BASE = 0xA0761D6478BD642F
_SENT = "kind int, part int, ids binary, tags binary, counts binary, hashes binary, steps binary, far binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _row(kind: int, part: int, *columns: np.ndarray) -> pa.RecordBatch:
    cells = [x.tobytes() for x in columns] + [b""] * (6 - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], _NAMES
    )


def _ranks(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Rank of each document by (id, tag); equal rows share one."""
    order = np.lexsort((tags, ids))
    a, b = ids[order], tags[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return out


def _later(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later): the rows that are the earliest of their hash, and those that start after it."""
    if (np.diff(place) < 0).any():
        by = np.argsort(place, kind="stable")
        order = by[np.argsort(h[by], kind="stable")]
    else:
        order = np.argsort(h, kind="stable")
    hs, ps = h[order], place[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(hs)), 0))
    first, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order] = new
    later[order] = ps != ps[lead]
    return first, later


def _docs_of(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values: (value, length)."""
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
    return doc[at[:-1]], np.diff(at).astype(np.int32)


def _found(ids, tags, doc, start, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows that tell a document's partition which of its windows are repeats."""
    to = (tx.mix(ids.view(np.uint64)) % tx.U(parts)).astype(np.int32)[doc]
    for part, (d, s) in tx.dealt(to, [doc, start]):
        order = np.argsort(d, kind="stable")
        own, counts = _docs_of(d[order])
        yield _row(1, part, ids[own], tags[own], counts, s[order].astype(np.int32))


def _send(width: int, parts: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        many = np.cumsum([0] + [len(x[0]) for x in held])
        ids, tags, start, h, h2 = (np.concatenate([x[k] for x in held]) for k in (0, 1, 3, 4, 5))
        doc = np.concatenate([x[2] + n for x, n in zip(held, many)])
        rank = _ranks(ids, tags)
        place = rank[doc] << 32 | start
        first, later = _later(h, place)
        yield from _found(ids, tags, doc[later], start[later], parts)
        keep = np.flatnonzero(first)
        keep = keep[np.argsort(place[keep], kind="stable")]
        to = (h2[keep] % tx.U(parts)).astype(np.int32)
        for part, (d, s, hs) in tx.dealt(to, [doc[keep], start[keep], h[keep]]):
            own, counts = _docs_of(d)
            step = np.diff(s, prepend=0)
            head = np.cumsum(counts) - counts
            step[head] = s[head]
            yield _row(0, part, ids[own], tags[own], counts, hs, np.minimum(step, 255).astype(np.uint8), step[step >= 255].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in tx.text_blocks(batch.column("text")):
                a, b, counts = tx.words(data, bounds)
                w = tx.word_hashes(data, a, b)
                at, inside = tx.windows(counts, width)
                if not len(at):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.maximum(counts - width + 1, 0))
                held.append((ids[lo:hi], tags[lo:hi], doc, inside, tx.mix(tx.rolling(w, width))[at], tx.mix(tx.rolling(tx.mix(w), width, _BASE))[at]))
                n += len(at)
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _cells(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in _NAMES}


def _count(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == 1).all():
                yield batch
                continue
            for x in _cells(batch):
                if x["kind"] == 1:
                    yield _row(1, x["part"], *(tx.of(x[c], np.uint8) for c in ("ids", "tags", "counts", "hashes")))
                    continue
                counts = tx.of(x["counts"], np.int32)
                step = tx.of(x["steps"], np.uint8).astype(np.int64)
                step[step == 255] = tx.of(x["far"], np.int32)
                sums = np.cumsum(step)
                head = np.cumsum(counts) - counts
                start = sums - np.repeat(sums[head] - step[head], counts)
                held.setdefault(x["part"], []).append((tx.of(x["ids"], np.int64), tx.of(x["tags"], np.int64), counts, tx.of(x["hashes"], tx.U), start.astype(np.int32)))
        while held:
            _, own = held.popitem()
            ids, tags, counts, h, start = (np.concatenate([x[k] for x in own]) for k in range(5))
            del own
            doc = np.repeat(np.arange(len(ids)), counts)
            _, later = _later(h, _ranks(ids, tags)[doc] << 32 | start)
            yield from _found(ids, tags, doc[later], start[later], parts)

    return run


def _merge(width: int):
    """Maximal intervals of words covered by repeated windows, a row for each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [
            (tx.of(x["ids"], np.int64), tx.of(x["tags"], np.int64), tx.of(x["counts"], np.int32), tx.of(x["hashes"], np.int32))
            for batch in batches
            for x in _cells(batch)
        ]
        if not own:
            return
        ids, tags, counts, start = (np.concatenate([x[k] for x in own]) for k in range(4))
        rank = _ranks(ids, tags)
        of_rank = np.zeros(rank.max() + 1, np.int64)
        of_rank[rank] = np.arange(len(ids))
        place = np.unique(np.repeat(rank, counts) << 32 | start)
        doc, s = place >> 32, place & 0xFFFFFFFF
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + width)))
        at = np.flatnonzero(new)
        end = s[np.concatenate((at[1:] - 1, [len(s) - 1]))] + width
        docs, many = _docs_of(doc[at])
        lists = np.concatenate(([0], np.cumsum(many)))
        first, last = s[at].astype(np.int32), end.astype(np.int32)
        for lo in range(0, len(docs), BATCH):
            own = of_rank[docs[lo : lo + BATCH]]
            cells = lists[lo : lo + BATCH + 1]
            inside = pa.array((cells - cells[0]).astype(np.int32))
            spans = (pa.ListArray.from_arrays(inside, pa.array(x[cells[0] : cells[-1]])) for x in (first, last))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(tags[own]), *spans], ["id", "tag", "starts", "ends"])

    return run


#: The words of a text; what lies between the removed intervals, in order.
_WORDS = r"array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')"
_KEPT = "if(starts is null, words, flatten(zip_with(concat(array(0), ends), concat(starts, array(size(words))), (a, b) -> slice(words, a + 1, b - a))))"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, starts, ends), a row for each row of docs; with rest also the
    struct rest of the other columns of docs.

    A word goes if a window of `window` words covers it whose sequence also starts earlier: in a smaller
    id, or before it in the same document. Windows are judged on the input. starts and ends are the removed
    intervals in words (null: none); kept_text has the other words with one space between.

    Null or empty texts and texts shorter than a window keep all words. A null id comes after all others and
    stays null. Rows with one id and one text are the same document and are treated alike; rows with one id
    and other texts are ordered by a hash of the text. Other columns are ignored; an empty table gives none.
    """
    parts = partitions(docs.sparkSession)
    own = documents(docs, id_col, text_col).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    sent = own.mapInArrow(_send(window, parts), _SENT).repartitionById(parts, F.col("part"))
    found = sent.mapInArrow(_count(parts), _SENT).repartitionById(parts, F.col("part"))
    spans = cut(found.mapInArrow(_merge(window), "id long, tag long, starts array<int>, ends array<int>"))
    others = [docs[c].alias(c) for c in docs.columns if rest and c not in (id_col, text_col)]
    whole = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"),
        docs[text_col].cast("string").alias("text"),
        *([F.struct(*others).alias("rest") if others else F.lit(None).alias("rest")] if rest else []),
    ).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    cut_up = whole.join(spans, ["id", "tag"], "left").withColumn("words", F.expr(_WORDS)).withColumn("kept", F.expr(_KEPT))
    return cut_up.select(
        real_id(F.col("id")).alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        (F.size("words") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", " ").alias("kept_text"),
        "starts", "ends", *(["rest"] if rest else []),
    )
