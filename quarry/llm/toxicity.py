"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words' weights, and
the document's is their noisy-or, 1 - product(1 - p): one bad sentence suffices. Only documents have labels;
the gradient of the noisy-or shares a document's label out to the sentences that explain it, so the
weights find the offending words and the scores the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._labels import sample
from quarry.llm._spark import documents, real_id

#: Labelled documents that training uses at most.
TRAIN_DOCS = 4_000
BUCKETS, LEAST_DOCS, LEAST_SURPRISE, EPOCHS, OFFENDING = 1 << 20, 3, 11.0, 200, 0.5
#: Bytes of a labelled text beyond which it trains nothing.
TRAIN_BYTES = 1 << 17
#: A word counts with its beginnings of so many bytes, up to the next letter, so that inflected forms share a weight.
BEGINNINGS = (4, 5, 6)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def sentences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word without its outer punctuation and of its beginnings, the sentence of each bucket, text
    of each sentence, first byte, end); buckets are in the order of the sentences."""
    a, b, counts = tx.words(data, bounds)
    if not len(a):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    doc = np.repeat(np.arange(len(counts)), counts)
    lines = np.cumsum(data == 10)
    first = np.ones(len(a), bool)
    first[1:] = (doc[1:] != doc[:-1]) | _STOP[data[b[:-1] - 1]] | (lines[a[1:]] > lines[b[:-1] - 1])
    s, e = tx.cores(data, a, b)
    sent, at = np.cumsum(first) - 1, np.flatnonzero(first)
    hashes, places = [tx.word_hashes(data, s, e, lower=True)], [sent]
    for k in BEGINNINGS:
        longer = np.flatnonzero(e - s > k)
        cut = s[longer] + k
        for _ in range(3):  # a letter of several bytes is not cut
            cut += (data[np.minimum(cut, len(data) - 1)] & 192 == 128) & (cut < e[longer])
        hashes.append(tx.mix(tx.word_hashes(data, s[longer], cut, lower=True) + tx.U(k)))
        places.append(sent[longer])
    bucket, places = (np.concatenate(hashes) % tx.U(BUCKETS)).astype(np.int64), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return bucket[order], places[order], doc[at], a[at], np.append(b[at[1:] - 1], b[-1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and sentences of training documents as numbers."""
    for batch in batches:
        at = 0
        for ids, data, bounds in tx.blocks([batch]):
            bucket, sent, doc, _, _ = sentences(data, bounds)
            pair = np.unique(sent * BUCKETS + bucket)
            sent, bucket = pair // BUCKETS, pair % BUCKETS
            of_word = doc[sent] if len(sent) else sent
            ends = np.searchsorted(of_word, np.arange(len(ids) + 1))
            y = batch.column("y").to_numpy()[at : at + len(ids)]
            at += len(ids)
            cells = [
                (bucket[x:z].astype(np.int32).tobytes(), (sent[x:z] - (sent[x] if z > x else 0)).astype(np.int32).tobytes()) for x, z in zip(ends[:-1], ends[1:])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y), *(pa.array(c, pa.binary()) for c in zip(*cells))], ["id", "y", "words", "sents"])


def _first_of_copies(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Whether each document is the first of those that agree with it in two of the eight least word hashes of
    a pair of hash functions: near copies would make all their words look telling."""
    keep = np.ones(n, bool)
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    if not len(at):
        return keep
    for band in range(8):
        least = [np.minimum.reduceat(tx.mix(word.astype(tx.U) + tx.U((2 * band + k + 1) << 32)), at) for k in range(2)]
        order = np.lexsort((doc[at], *least))
        same = (least[0][order][1:] == least[0][order][:-1]) & (least[1][order][1:] == least[1][order][:-1])
        keep[doc[at][order[1:][same]]] = False
    return keep


def _surprise(k: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Twice the log likelihood ratio of k bad documents of n against the rate; 0 if k is not above it."""
    share = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(k > 0, k * np.log(share / rate), 0) + np.where(k < n, (n - k) * np.log((1 - share) / (1 - rate)), 0))
    return np.where(share > rate, g, 0)


def train(rows: list[tuple[int, bytes, bytes]], epochs: int = EPOCHS, least_docs: int = LEAST_DOCS, least_surprise: float = LEAST_SURPRISE) -> tuple[np.ndarray, float]:
    """(weights, bias) from (label, words, sentences). Only words that occur in least_docs documents that aren't near
    copies, and in bad ones more often than chance lets expect (least_surprise), get a weight."""
    words, sents, docs, n = [], [], [], 0
    for k, (_, w, s) in enumerate(rows):
        w, s = np.frombuffer(w, np.int32), np.frombuffer(s, np.int32)
        words.append(w)
        sents.append(s + n)
        docs.append(np.full(int(s[-1]) + 1 if len(s) else 0, k))
        n += len(docs[-1])
    y = np.array([r[0] for r in rows], float)
    bias, weights = -6.0, np.zeros(BUCKETS, np.float32)
    if not n or y.min() == y.max():
        return weights, bias
    words, sents, docs = np.concatenate(words), np.concatenate(sents), np.concatenate(docs)
    pair = np.unique(docs[sents].astype(np.int64) * BUCKETS + words)
    pair = pair[_first_of_copies(pair // BUCKETS, pair % BUCKETS, len(y))[pair // BUCKETS]]
    often = np.bincount(pair % BUCKETS, minlength=BUCKETS)
    with_bad = np.bincount(pair % BUCKETS, y[pair // BUCKETS], BUCKETS)
    used = np.flatnonzero(often >= least_docs)
    used = used[_surprise(with_bad[used], often[used], float(y.mean())) >= least_surprise]
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    keep = place[words] >= 0
    words, sents = place[words[keep]], sents[keep]
    w, sq, sq_b = np.zeros(len(used)), np.full(len(used), 1e-6), 1e-6
    for _ in range(epochs):
        z = np.clip(bias + np.bincount(sents, w[words], n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = np.clip(1 - np.exp(np.bincount(docs, np.log1p(-p), len(y))), 1e-9, 1)
        g = p * (1 - y / total)[docs]
        gw = np.bincount(words, g[sents], len(used)) + 1e-3 * w
        sq, sq_b = sq + gw * gw, sq_b + g.sum() ** 2
        w -= 0.5 * gw / np.sqrt(sq)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.01 / np.sqrt(sq), 0)
        bias -= 0.1 * g.sum() / np.sqrt(sq_b)
    weights[used] = w
    return weights, float(bias)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for ids, data, bounds in tx.blocks(batches):
            bucket, sent, doc, a, b = sentences(data, bounds)
            z = np.clip(bias + np.bincount(sent, weights[bucket], len(doc)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            score = 1 - np.exp(np.bincount(doc, np.log1p(-p), len(ids)))
            bad = np.flatnonzero(p >= OFFENDING)
            found: list[list[bytes]] = [[] for _ in ids]
            for k in bad:
                found[doc[k]].append(data[a[k] : b[k]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.clip(score, 0, 1)), pa.array(found, pa.list_(pa.binary()))], ["id", "score", "offending"]
            )

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    folds: int = 3,
    out: int = 1,
    train_docs: int = TRAIN_DOCS,
    train_bytes: int = TRAIN_BYTES,
    least_docs: int = LEAST_DOCS,
    least_surprise: float = LEAST_SURPRISE,
) -> DataFrame:
    """(doc_id, score, offending): probability that label is 1, and the texts of the sentences with p >= OFFENDING.

    Trained on at most train_docs labelled documents of at most train_bytes bytes, outside fold `out` (crc32 of the id
    modulo folds); whole texts of any length are scored. A word gets a weight only if it occurs in least_docs training
    documents, near copies counted once, and in toxic ones so often that twice the log likelihood ratio against
    chance is least_surprise. Null and empty texts have no sentence and score 0. Of several labels of an id the
    largest counts, of several labelled texts of an id one; rows with a null id or label train nothing; without labels of both kinds all weights are 0. Null ids stay null, repeated rows
    give repeated rows, other columns are ignored, an empty table gives none.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    marks = F.broadcast(sample(labels, id_col, label, folds, out, train_docs))  # at most train_docs rows
    fit = own.where(F.octet_length("text") <= train_bytes).join(marks, "id").select("id", "text", "y")
    # one row an id, however often it is there
    rows = fit.mapInArrow(_features, "id long, y int, words binary, sents binary").groupBy("id").agg(F.min(F.struct("words", "sents", "y")).alias("r")).select("id", "r.*").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["words"])))
    model = spark.sparkContext.broadcast(train([(r["y"], bytes(r["words"]), bytes(r["sents"])) for r in rows], EPOCHS, least_docs, least_surprise))
    scored = own.mapInArrow(_score(model), "id long, score double, offending array<binary>")
    return scored.select(real_id(F.col("id")).alias(id_col), "score", F.expr("transform(offending, x -> cast(x as string))").alias("offending"))
