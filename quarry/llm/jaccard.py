"""Exact Jaccard self-join of documents on word shingles: T-occurrence search over inverted lists, by DivideSkip.

Two sets of n and m shingles reach the threshold only if they share at least T = ceil(threshold * n)
shingles of the first. A document's lists are divided: its L = T - 2 longest are skipped, so that a partner occurs
at least T - L = 2 times in the shorter ones (lists are in one order for all documents, thus in the shorter ones of
both). The short lists are merged with their counts, by sorting in Spark in place of a heap, as no document's lists lie
in one task; partners that occur often enough are probed by binary search for all other shingles.

1. A first pass counts the shingles that many documents have. Those that hold more than a quarter of a partition's
   share of all shingles, at most 4 x partitions of them, are broadcast with their counts.
2. Each task hashes its documents' shingle sets, links documents with equal sets at once and sends the
   sets of the others, dealt by hash. What is broadcast is answered on the spot: no task gets such a list.
3. Each partition holds whole inverted lists of the other shingles. It answers, for every document, which of its
   shingles another document has too and the length of those lists; lists of one document answer nothing. Each
   document that shares fewer than T shingles is done. The others (about a tenth) keep their shared shingles and
   the shortest lists' shingles to be merged.
4. Each short list links its documents to the one with most shared shingles: linear in the list, however long.
   The pairs are confirmed on the whole sets, and connected components formed.
5. Of all other documents those are merged that are still in different components and have enough shared shingles
   for the overlap; pairs that occur often enough are confirmed, so no link between components is missed and no
   group of copies is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._spark import NULL_ID, components, cut, documents, partitions, real_id

SHINGLE, SIMILARITY = 5, Fraction(4, 5)
#: Occurrences that the merge of short lists asks for, T - L; for smaller T all of them.
MERGED = 2
#: Shingles that a task holds before it sends them.
HELD = 1_000_000
#: Places that a task holds while it looks for common shingles.
TALLIED = 500_000
#: Bytes of a batch of answers, unless one document has more.
BATCH_BYTES = 16 << 20
_BASE = 0xE7037ED1A0B428DB
#: A shingle's list is dealt to no partition if it is longer than 1 / COMMON of a partition's share of all shingles.
COMMON = 4
_SENT = "kind int, part int, ids binary, tags binary, counts binary, hashes binary, lengths binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
#: Parities of a document's shared shingles by the last byte of the hash, as four numbers.
_BITS = ("b0", "b1", "b2", "b3")
#: Kinds of rows: sets, answers, (document, set size, first document with the set).
_SETS, _ANSWERS, _META = 0, 1, 2


def _row(kind: int, part: int, *columns: np.ndarray) -> pa.RecordBatch:
    cells = [x.tobytes() for x in columns] + [b""] * (5 - len(columns))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], _NAMES
    )


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (tx.mix(ids.view(np.uint64)) % tx.U(parts)).astype(np.int32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
    return at[:-1], np.diff(at)


def _places(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts): the shingle at each place of each text."""
    a, b, counts = tx.words(data, bounds)
    w = tx.word_hashes(data, a, b, lower=True)
    at, _ = tx.windows(counts, width)
    many = np.maximum(counts - width + 1, 0)
    h, doc = tx.mix(tx.rolling(w, width))[at], np.repeat(np.arange(len(counts)), many)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        head = np.cumsum(counts) - counts
        value = np.zeros(len(short), tx.U)
        for j in range(width - 1):
            has = counts[short] > j
            value[has] += w[head[short[has]] + j] * tx.U(pow(_BASE, j + 1, 2**64))
        h, doc = np.concatenate((h, tx.mix(value + counts[short].astype(tx.U)))), np.concatenate((doc, short))
    return h, doc


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingles of each text, rising within a text."""
    h, doc = _places(data, bounds, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(bounds) - 1)


def _tally(width: int, parts: int):
    """(token, c): the task's shingles that may be common, with their places; without a token the sum of all."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h, counts = (np.concatenate([x[k] for x in held]) for k in range(2))
        tags = tx.mix(tx.sums_by(tx.mix(h), counts) + counts.astype(tx.U))
        own = np.zeros(len(counts), bool)
        own[np.unique(tags, return_index=True)[1]] = True
        h = np.sort(h[np.repeat(own, counts)])
        if not len(h):
            return
        at, many = _runs(h)
        often = (many > 1) & (many * (2 * COMMON * parts) >= len(h))
        token, c = h[at[often]].view(np.int64), many[often].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None, *token.tolist()], pa.int64()), pa.array([len(h), *c.tolist()], pa.int64())], ["token", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, data, bounds in tx.blocks(batches):
            h, doc = _places(data, bounds, width)
            held.append((h[np.argsort(doc, kind="stable")], np.bincount(doc, minlength=len(bounds) - 1)))
            n += len(h) + len(bounds)
            if n >= TALLIED:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def common_shingles(own: DataFrame, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): the shingles at 1 / (COMMON * parts) of all places or more, rising; at most COMMON * parts.

    Places are those of unlike texts of a task, so they are no fewer than the sets with the shingle. A task names a
    shingle that it holds twice and that is half as common there. So a list that is not named is at most 1.5 times as
    long as that share, or has one set of each TALLIED places. One text that repeats a shingle may make it common, too:
    it then counts as shared, which changes no result, as pairs are confirmed on the whole sets.
    """
    sums = cut(own.mapInArrow(_tally(width, parts), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))
    total = sums.where("token is null").agg(F.sum("c")).first()[0] or 0
    rows = sums.where("token is not null").where(F.col("c") >= -(-total // (COMMON * parts))).collect()
    h = np.array([r["token"] for r in rows], np.int64).view(tx.U)
    order = np.argsort(h)
    return h[order], np.array([r["c"] for r in rows], np.int64)[order]


def _answers(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, h: np.ndarray, length: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows that tell a document's partition which shingles it shares, and the order of their lists."""
    for part, (d, hs, n) in tx.dealt(_part(ids, parts)[doc], [doc, h, length]):
        o = np.argsort(d, kind="stable")
        at, c = _runs(d[o])
        who = d[o][at]
        yield _row(_ANSWERS, part, ids[who], tags[who], c.astype(np.int32), hs[o], n[o])


def _send(width: int, parts: int, shared):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        ids, h, counts = (np.concatenate([x[k] for x in held]) for k in range(3))
        tags = tx.mix(tx.sums_by(tx.mix(h), counts) + counts.astype(tx.U)).view(np.int64)
        other = tx.sums_by(tx.mix(h ^ tx.U(_BASE)), counts)
        order = np.lexsort((ids, other, tags, counts))
        c, t, o = counts[order], tags[order], other[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        lead = np.empty(len(ids), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        lead[counts == 0] = np.flatnonzero(counts == 0)
        for part, (i, t, c, to) in tx.dealt(_part(ids, parts), [ids, tags, counts.astype(np.int64), ids[lead]]):
            yield _row(_META, part, i, t, c, to)
        own = (lead == np.arange(len(ids))) & (counts > 0)
        doc = np.repeat(np.arange(len(ids)), counts)
        mine = own[doc]
        h, doc = h[mine], doc[mine]
        if len(common):
            at = np.minimum(np.searchsorted(common, h), len(common) - 1)
            known = common[at] == h
            yield from _answers(ids, tags, doc[known], h[known], _order(often[at[known]]), parts)
            h, doc = h[~known], doc[~known]
        for part, (hs, d) in tx.dealt((tx.mix(h) % tx.U(parts)).astype(np.int32), [h, doc]):
            at, many = _runs(d)
            yield _row(_SETS, part, ids[d[at]], tags[d[at]], many.astype(np.int32), hs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, data, bounds in tx.blocks(batches):
            h, counts = shingle_sets(data, bounds, width)
            held.append((ids, h, counts))
            n += len(h) + len(ids)
            if n >= HELD:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _cells(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in _NAMES}


def _order(length: np.ndarray) -> np.ndarray:
    """Lengths as two bytes that keep their order: exact up to 256, then within a hundredth, without an upper end."""
    return (length.astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def _lists(parts: int):
    """The inverted lists of a partition: what they say about each document with a shingle in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for x in _cells(batch):
                if x["kind"] != _SETS:
                    yield _row(x["kind"], x["part"], *(tx.of(x[c], np.uint8) for c in _NAMES[2:]))
                else:
                    held.setdefault(x["part"], []).append((tx.of(x["ids"], np.int64), tx.of(x["tags"], np.int64), tx.of(x["counts"], np.int32), tx.of(x["hashes"], tx.U)))
        while held:
            _, own = held.popitem()
            ids, tags, counts, h = (np.concatenate([x[k] for x in own]) for k in range(4))
            del own
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            _, many = _runs(h)
            length = np.repeat(many, many)
            shared = length > 1
            h, doc, length = h[shared], doc[shared], _order(length[shared])
            yield from _answers(ids, tags, doc, h, length, parts)

    return run


def needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap with a partner of any size."""
    return -(-n * num // den)


def _sift(num: int, den: int):
    """A row for each document; those that may have a partner with shared shingles and short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas, answers = [], []
        for batch in batches:
            for x in _cells(batch):
                if x["kind"] == _META:
                    metas.append((tx.of(x["ids"], np.int64), tx.of(x["tags"], np.int64), tx.of(x["counts"], np.int64), tx.of(x["hashes"], np.int64)))
                else:
                    answers.append((tx.of(x["ids"], np.int64), tx.of(x["tags"], np.int64), tx.of(x["counts"], np.int32), tx.of(x["hashes"], tx.U), tx.of(x["lengths"], np.uint16)))
        if not metas:
            return
        ids, tags, n, lead = (np.concatenate([x[k] for x in metas]) for k in range(4))
        shared, short, bits = ([None] * len(ids) for _ in range(3))
        if answers:
            a_ids, a_tags, a_n, h, length = (np.concatenate([x[k] for x in answers]) for k in range(5))
            # the first row of each document that was sent, by (id, tag)
            order = np.lexsort((np.arange(len(ids)), lead != ids, tags, ids))
            key = np.rec.fromarrays([ids[order], tags[order]])
            first = np.ones(len(order), bool)
            first[1:] = key[1:] != key[:-1]
            rows, key = order[first], key[first]
            doc = np.repeat(rows[np.searchsorted(key, np.rec.fromarrays([a_ids, a_tags], dtype=key.dtype))], a_n)
            o = np.lexsort((h, length, doc))
            h, doc = h[o], doc[o]
            at, many = _runs(doc)
            for lo, k in zip(at, many):
                d = doc[lo]
                own = h[lo : lo + k]
                if (new := np.unique(own)).size != k:  # the same row sent by two tasks
                    _, keep = np.unique(own, return_index=True)
                    own, k = own[np.sort(keep)], new.size
                least = int(needed(n[d], num, den))
                if k >= least:
                    shared[d], short[d] = new.tobytes(), own[: k - least + min(MERGED, least)].tobytes()
                    odd = np.bincount((new & tx.U(255)).astype(np.int64), minlength=256) & 1
                    bits[d] = np.packbits(odd.astype(np.uint8)).tobytes()
        size, lo = np.cumsum([40 + len(x or b"") + len(y or b"") for x, y in zip(shared, short)]), 0
        while lo < len(ids):  # batches of a bounded number of bytes, a document each at least
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[lo:hi]) for x in (ids, tags, n, lead)), *(pa.array(x[lo:hi], pa.binary()) for x in (shared, short, bits))],
                ["id", "tag", "n", "lead", "shared", "short", "bits"],
            )
            lo = hi

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [tx.of(x, np.int64) for x in batch.column("short").to_pylist()]
        many = [len(x) for x in cells]
        if not cells:
            continue
        odd = np.array([tx.of(x, np.int64) for x in batch.column("bits").to_pylist()]).T
        own = [*(batch.column(c).to_numpy() for c in ("id", "tag", "n", "k")), *odd]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(cells)), *(pa.array(np.repeat(x, many)) for x in own)], ["token", "id", "tag", "n", "k", *_BITS]
        )


def _confirm(num: int, den: int):
    """Pairs that reach the threshold: num * union <= den * overlap, by binary probes of the larger set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_numpy() for c in ("a", "b", "n", "m"))
            keep = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                s, t = tx.of(x.as_py(), tx.U), tx.of(y.as_py(), tx.U)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                overlap = int((t[at] == s).sum())
                keep[k] = den * overlap >= num * (int(n[k]) + int(m[k]) - overlap)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    A-Z count as a-z. A document's set has its distinct runs of `shingle` words; with fewer words the
    whole sequence is its only shingle; without words the set is empty and linked with nothing. Two documents
    are linked if overlap / union >= similarity; component_id is the smallest id reachable by links.

    Null texts count as empty. Rows of one id with unlike texts are not linked by their id, nor are rows without
    one. A null id counts as larger than all others; alone, its component is null. Other columns are ignored; an
    empty table gives none. similarity is an exact fraction.
    """
    own = documents(docs, id_col, text_col)
    if own.groupBy("id").count().where((F.col("count") > 1) | (F.col("id") == NULL_ID)).isEmpty():
        out = _joined(own, shingle, similarity)
    else:  # a node for each id and text
        own = own.withColumn("node", F.xxhash64("id", "text"))
        nodes = cut(_joined(own.selectExpr("node id", "text"), shingle, similarity).dropDuplicates(["id"]))
        rows = cut(own.select("id", "node").join(nodes.withColumnRenamed("id", "node"), "node"))
        least = rows.groupBy("component").agg(F.min("id").alias("least"))
        out = rows.join(least, "component").selectExpr("id", "n", "least component")
    return out.select(real_id(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), real_id(F.col("component")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: the one with the smallest id.

    Rows of one id with unlike texts are documents of their own, so no text is lost for its id. Of equal rows (id and
    text) one stays. Null ids count as larger than all others. Rows without words are linked with nothing and all stay.
    """
    own = documents(docs, id_col, text_col)
    if own.groupBy("id").count().where((F.col("count") > 1) | (F.col("id") == NULL_ID)).isEmpty():
        first = _joined(own, shingle, similarity).where("id = component").select(F.col("id").alias("__first"))
        return docs.join(first, docs[id_col].cast("long") == first["__first"], "left_semi")
    own = own.withColumn("node", F.xxhash64("id", "text"))
    nodes = cut(_joined(own.selectExpr("node id", "text"), shingle, similarity).dropDuplicates(["id"]).withColumnRenamed("id", "node"))
    least = own.select("id", "node").distinct().join(nodes, "node").groupBy("component").agg(F.min(F.struct("id", "node")).alias("least"), F.max("n").alias("n"))
    first = cut(least.selectExpr("least.node __first", "n __n"))
    key = F.xxhash64(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)), docs[text_col].cast("string"))
    kept = docs.withColumn("__node", key).join(first, F.col("__node") == F.col("__first"))
    again = cut(kept.where("__n > 0").groupBy("__node").count().where("count > 1").select(F.col("__node").alias("__again")))
    alone = kept.join(again, F.col("__node") == F.col("__again"), "left_anti").select(*docs.columns)
    row = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.xxhash64(*(F.col(c) for c in docs.columns))).alias("row")
    return alone.union(kept.join(again, F.col("__node") == F.col("__again")).groupBy("__node").agg(row).select("row.*"))


def _joined(own: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """(id, n, component) for (id, text); rows with one id are one node."""
    num, den = Fraction(similarity).limit_denominator(10**6).as_integer_ratio()
    parts = partitions(own.sparkSession)
    shared = own.sparkSession.sparkContext.broadcast(common_shingles(own, shingle, parts))
    sent = own.mapInArrow(_send(shingle, parts, shared), _SENT).repartitionById(parts, F.col("part"))
    told = sent.mapInArrow(_lists(parts), _SENT).repartitionById(parts, F.col("part"))
    all_docs = cut(told.mapInArrow(_sift(num, den), "id long, tag long, n long, lead long, shared binary, short binary, bits binary"))
    sets = all_docs.where("shared is not null").select("id", "tag", "n", "shared")
    entries = cut(
        all_docs.where("shared is not null").selectExpr("id", "tag", "n", "octet_length(shared) div 8 as k", "short", "bits")
        .mapInArrow(_explode, "token long, id long, tag long, n long, k long, " + ", ".join(f"{b} long" for b in _BITS))
    )
    # neither size nor number of shared shingles, k, rules the pair out: the overlap is at most the smaller k, and
    # at most (k + l - bits that differ) / 2, as each shingle in one of the sets flips one bit
    differ = " + ".join(f"bit_count({b} ^ o{b})" for b in _BITS)
    close = F.expr(
        f"""{den} * least(n, m) >= {num} * greatest(n, m) and {num + den} * least(k, l) >= {num} * (n + m)
            and {num + den} * (k + l - ({differ})) >= {2 * num} * (n + m)"""
    )
    mine, other = list(_BITS), [f"{b} o{b}" for b in _BITS]

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs: (a, ta, b, tb), each once."""
        # both sides read sets under the same names, so that Spark deals them out once
        both = (
            pairs.join(sets.alias("s"), F.expr("a = s.id and ta = s.tag"))
            .join(sets.alias("t"), F.expr("b = t.id and tb = t.tag"))
            .selectExpr("a", "b", "s.n n", "t.n m", "s.shared x", "t.shared y")
        )
        return cut(both.mapInArrow(_confirm(num, den), "a long, b long"))

    # the document with most shared shingles leads a list: copies of one text share nearly what they kept of it
    heads = entries.groupBy("token").agg(F.min(F.struct((-F.col("k")).alias("col1"), F.col("n"), F.col("id"), F.col("tag"), *(F.col(b) for b in _BITS))).alias("head"), F.count("*").alias("c")).where("c > 1")
    star = (
        entries.join(heads, "token")
        .selectExpr("head.id a", "head.tag ta", "id b", "tag tb", "n", "head.n m", "k", "-head.col1 l", *mine, *(f"head.{b} o{b}" for b in _BITS))
        .where(close & F.expr("a <> b or ta <> tb"))
        .select("a", "ta", "b", "tb")
        .distinct()
    )
    same = all_docs.where("lead <> id").selectExpr("id a", "lead b")
    part_of = cut(components(confirmed(star).union(same)))

    # lists whose documents are not all in one component yet
    placed = entries.join(part_of, "id", "left").selectExpr("token", "id", "tag", "n", "k", "coalesce(component, id) c", *mine)
    open_lists = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    left_over = cut(placed.join(open_lists, "token"))
    rest = (
        left_over.selectExpr("token", "id a", "tag ta", "n", "k", "c", *mine)
        .join(left_over.selectExpr("token", "id b", "tag tb", "n m", "k l", "c d", *other), "token")
        .where(F.expr("c < d") & close)
        .groupBy("a", "ta", "b", "tb", "n", "m")
        .agg(F.count("*").alias("often"))
        .where(f"often >= least({MERGED}, ({num} * n + {den - 1}) div {den}, ({num} * m + {den - 1}) div {den})")
        .select("a", "ta", "b", "tb")
    )
    more = confirmed(rest)
    ids = part_of.select(F.col("id"), F.col("component").alias("c"))
    between = (
        more.join(ids.withColumnsRenamed({"id": "a", "c": "ca"}), "a", "left")
        .join(ids.withColumnsRenamed({"id": "b", "c": "cb"}), "b", "left")
        .selectExpr("coalesce(ca, a) a", "coalesce(cb, b) b")
    )
    joined = components(between).withColumnsRenamed({"id": "c", "component": "joined"})
    out = all_docs.select("id", "n").join(part_of, "id", "left").withColumn("c", F.coalesce("component", "id")).join(joined, "c", "left")
    return out.select("id", "n", F.coalesce("joined", "c").alias("component"))


__all__ = ["NULL_ID", "ngram_jaccard_join", "one_of_each_group", "shingle_sets"]
