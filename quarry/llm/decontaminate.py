"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared if they share a seed, a run of `shortest` words (Karp-Rabin
hashes of all runs of the document are looked up in those of the benchmark). Seeds on one diagonal join to
maximal matches. The longest match is marked first; words of either side that are marked can't match again,
so what is left of an overlapping match goes back in line with its new length. The tiles' share of the item's
words is its coverage, whatever order the passages have in the document.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._spark import NULL_ID, documents, real_id

SHORTEST, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in blocks of about that size.
BROADCAST_BYTES = 16 << 20
_OUT = "id long, item long, n_item_words long, n_covered long, coverage double, item_starts array<int>, doc_starts array<int>, lengths array<int>"


class Benchmark:
    """Items and their seeds. An item of fewer words than `shortest` is its own and only seed."""

    def __init__(self, items: list[tuple[int, str]], shortest: int):
        self.ids = [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b" ".join(texts), np.uint8)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds[-1] = max(0, bounds[-1] - 1)
        a, b, self.counts = tx.words(data, bounds)
        h = tx.word_hashes(data, a, b, lower=True)
        head = np.cumsum(self.counts) - self.counts
        seeds = defaultdict(list)
        for k, (at, n) in enumerate(zip(head.tolist(), self.counts.tolist())):
            width = min(shortest, n)
            for p, x in enumerate(tx.rolling(h[at : at + n], width).tolist() if width else ()):
                seeds[width].append((x, k, p))
        self.seeds = {}
        for width, rows in seeds.items():
            rows.sort()
            self.seeds[width] = (np.array([r[0] for r in rows], tx.U), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def hits(self, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(document, item, seed width, positions in the item, positions in the document) of each pair with a seed."""
        for width, (seed, item, place) in self.seeds.items():
            at, inside = tx.windows(counts, width)
            if not len(at):
                continue
            r = tx.rolling(h, width)[at]
            doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
            lo, hi = np.searchsorted(seed, r, "left"), np.searchsorted(seed, r, "right")
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            many = (hi - lo)[found]
            row = np.repeat(lo[found], many) + tx.ragged(many)
            d, j, p, t = np.repeat(doc[found], many), item[row], place[row], np.repeat(inside[found], many)
            order = np.lexsort((p, t, j, d))
            d, j, p, t = d[order], j[order], p[order], t[order]
            cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (j[1:] != j[:-1]), [True])))
            for x, y in zip(cut[:-1], cut[1:]):
                yield int(d[x]), int(j[x]), width, p[x:y], t[x:y]


def tiles(item_at: np.ndarray, doc_at: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles, from the places of common seeds of width words."""
    order = np.lexsort((item_at, doc_at - item_at))
    p, t = item_at[order], doc_at[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(t - p) != 0) | (np.diff(p) != 1), [True])))
    heap = [(-(int(y - x) + width - 1), int(p[x]), int(t[x])) for x, y in zip(cut[:-1], cut[1:])]
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_doc: set[int] = set()
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [a + k not in in_item and b + k not in in_doc for k in range(n)]
        if all(free):
            in_item.update(range(a, a + n))
            in_doc.update(range(b, b + n))
            out.append((a, b, n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, a + start, b + start))
                start = None
    return sorted(out)


def _search(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        for ids, data, bounds in tx.blocks(batches):
            a, b, counts = tx.words(data, bounds)
            h = tx.word_hashes(data, a, b, lower=True)
            rows = []
            for d, j, width, p, t in bench.hits(h, counts):
                n = int(bench.counts[j])
                reach = np.zeros(n + 1, np.int64)
                u = np.unique(p)
                np.add.at(reach, u, 1)
                np.add.at(reach, u + width, -1)
                if (np.cumsum(reach)[:n] > 0).sum() < least * n:  # tiles can't cover more than all seeds
                    continue
                found = tiles(p, t, width)
                covered = sum(x[2] for x in found)
                if covered >= least * n:
                    rows.append((int(ids[d]), bench.ids[j], n, covered, covered / n, *([x[k] for x in found] for k in range(3))))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.list_(pa.int32())] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _OUT.split(", ")]
                )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    shortest: int = SHORTEST,
    coverage: float = COVERAGE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_covered, coverage, item_starts, doc_starts, lengths): a row for each
    document and item of which tiles of at least `shortest` words cover the share `coverage`.

    A-Z count as a-z. Texts without words, on either side, match nothing; null texts count as empty. An item
    of fewer than `shortest` words must occur whole. Equal items are reported each; repeated rows of docs give
    repeated rows. Null ids stay null. Matches of one length are taken in the order of the item, then of the
    document. Other columns are ignored; an empty table on either side gives none.

    The benchmark is broadcast if its text has at most broadcast_bytes; else it goes through in so many blocks,
    dealt by a hash of the item.
    """
    found = _found(documents(docs, id_col, text_col), benchmark, item_col, shortest, coverage, broadcast_bytes)
    return found.withColumns({"id": real_id(F.col("id")), "item": real_id(F.col("item"))}).withColumnsRenamed({"id": id_col, "item": item_col})


def _found(own: DataFrame, benchmark: DataFrame, item_col: str = "item_id", shortest: int = SHORTEST, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows _OUT for (id, text)."""
    spark = own.sparkSession
    items = documents(benchmark, item_col, "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // broadcast_bytes) if size > broadcast_bytes else 1)
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows = sorted((r["id"], r["text"]) for r in part.collect())
        shared = spark.sparkContext.broadcast(Benchmark(rows, shortest))
        found = own.mapInArrow(_search(shared, coverage), _OUT)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, whose own text contaminated() doesn't report.

    A row goes for its text alone, known by its 64-bit hash: neither another row of its id nor a null id decides.
    """
    text = docs[text_col].cast("string")
    found = _found(docs.select(F.xxhash64(text).alias("id"), text.alias("text")), benchmark, **options)
    bad = found.select(F.col("id").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64(text) == bad["__bad"], "left_anti")


__all__ = ["NULL_ID", "Benchmark", "contaminated", "decontaminate", "tiles"]
