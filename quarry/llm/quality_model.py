"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has two terms: its letters (hashed) and its form (its outer punctuation and capitals, hashed).
Each term has a fixed sparse random index vector. A term's context vector is the sum, over the whole corpus,
of the index vectors of its neighbours; tables of a fixed size are summed in each task and then over
all tasks. A document is the mean of its terms' vectors with three measures of repetition and length. A
network with one hidden layer, trained in numpy on a bounded sample of labelled documents, gives a score
that a temperature, fitted on labelled documents it was not trained on, turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx
from quarry.llm._labels import fold, sample
from quarry.llm._spark import documents, real_id

TRAIN_DOCS, HIDDEN, EPOCHS = 12_000, 32, 400
WORDS, FORMS, DIM, NONZERO = 1 << 14, 1 << 9, 32, 4
TERMS = WORDS + FORMS
SLICES, BLOCK = 16, 1 << 20
_r = tx.mix(np.arange(TERMS * NONZERO, dtype=tx.U) + tx.U(77)).reshape(TERMS, NONZERO)
_PLACE = ((_r >> tx.U(8)) % tx.U(DIM)).astype(np.int32)
_SIGN = np.where(_r & tx.U(1), 1.0, -1.0).astype(np.float32)
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, form, hash) of each word, and the number of words of each text."""
    a, b, counts = tx.words(data, bounds)
    s, e = tx.cores(data, a, b)
    h = tx.word_hashes(data, s, e, lower=True)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    digit = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    n = e - s
    capitals = np.minimum((upper[e] - upper[s]) * 4 // np.maximum(n, 1), 3) + 4 * ((digit[e] - digit[s]) > 0)
    tail = tx.word_hashes(data, e, b) * (b > e) + tx.U(3) * tx.word_hashes(data, a, s) * (s > a)
    form = tx.mix(tail + capitals.astype(tx.U) * tx.U(0x9E37) + np.minimum(n // 8, 3).astype(tx.U))
    return (h % tx.U(WORDS)).astype(np.int64), (form % tx.U(FORMS)).astype(np.int64) + WORDS, h, counts


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sums of neighbours' index vectors, in slices of the table."""
    total = np.zeros(TERMS * DIM, np.float64)

    def add(term: np.ndarray, other: np.ndarray) -> None:
        # pairs of terms once, with how often they occur
        pair, often = np.unique(term * TERMS + other, return_counts=True)
        term, other = pair // TERMS, pair % TERMS
        for k in range(NONZERO):
            total[:] += np.bincount(term * DIM + _PLACE[other, k], _SIGN[other, k] * often, TERMS * DIM)

    for _, data, bounds in tx.blocks(batches):
        word, form, _, counts = terms(data, bounds)
        if not len(word):
            continue
        doc = np.repeat(np.arange(len(counts)), counts)
        near = np.flatnonzero(doc[1:] == doc[:-1])
        x, y = np.concatenate((near, near + 1)), np.concatenate((near + 1, near))
        add(np.concatenate((word[x], form[x], word, form)), np.concatenate((word[y], form[y], form, word)))
    for k, part in enumerate(np.array_split(total.astype(np.float32), SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column("k").to_pylist(), batch.column("sums")):
            part = tx.of(part.as_py(), np.float32).astype(np.float64)
            sums[k] = sums[k] + part if k in sums else part
    for k, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "sums"])


def word_vectors(own: DataFrame) -> np.ndarray:
    """Unit context vectors of all terms over all rows; a table of TERMS x DIM numbers, whatever the corpus."""
    rows = own.mapInArrow(_gather, "k int, sums binary").repartitionById(SLICES, F.col("k")).mapInArrow(_add, "k int, sums binary").collect()
    table = np.zeros(TERMS * DIM)
    for part, view in zip(sorted(rows, key=lambda r: r["k"]), np.array_split(table, SLICES)):
        view += tx.of(bytes(part["sums"]), np.float64)
    table = table.reshape(TERMS, DIM)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    word, form, h, counts = terms(data, bounds)
    n = len(counts)
    out = np.zeros((n, 2 * DIM + 3), np.float32)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    head = (np.cumsum(counts) - counts)[has]
    size = counts[has][:, None]
    out[has, :DIM] = np.add.reduceat(vectors[word], head, axis=0) / size
    out[has, DIM : 2 * DIM] = np.add.reduceat(vectors[form], head, axis=0) / size
    doc = np.repeat(np.arange(n), counts)

    def distinct(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, of))
        x, of = x[order], of[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
        return np.bincount(of[new], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    out[:, -3] = distinct(h, doc)
    at, _ = tx.windows(counts, 3)
    out[:, -2] = distinct(tx.rolling(h, 3)[at], np.repeat(np.arange(n), np.maximum(counts - 2, 0))) if len(at) else 1
    out[:, -2][counts < 3] = 1
    out[:, -1] = np.log1p(counts) / 10
    return out


def _pool(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, bounds in tx.blocks([batch], BLOCK):
                y = batch.column("y").slice(at, len(ids))
                at += len(ids)
                x = pooled(data, bounds, vectors.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids), y, pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    return run


class Network:
    """Inputs -> tanh -> logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = EPOCHS):
        """held: rows kept from the weights and used for the temperature."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        rng = np.random.default_rng(11)
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        fit, keep = np.flatnonzero(~held), np.flatnonzero(held)
        z, t = (x[fit] - self.mean) / self.scale, y[fit].astype(float)
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for step in range(1, epochs + 1):
            own = rng.permutation(len(fit))[:1024]
            zb, tb = z[own], t[own]
            a = np.tanh(zb @ self.w[0] + self.w[1])
            g = (1 / (1 + np.exp(-np.clip(a @ self.w[2] + self.w[3], -30, 30))) - tb) / len(own)
            back = np.outer(g, self.w[2]) * (1 - a * a)
            grads = [zb.T @ back + 1e-4 * self.w[0], back.sum(0), a.T @ g + 1e-4 * self.w[2], np.array([g.sum()])]
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(keep) and 0 < y[keep].mean() < 1:
            logit, t = self.logits(x[keep]), y[keep]
            loss = lambda c: np.logaddexp(0, np.where(t == 1, -logit, logit) / c).mean()
            self.temperature = min((float(c) for c in np.geomspace(0.5, 8, 41)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network, base = model.value
        for ids, data, bounds in tx.blocks(batches, BLOCK):
            score = network.scores(pooled(data, bounds, vectors)) if network else np.full(len(ids), base)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score)], ["id", "score"])

    return run


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, out: int = 0, train_docs: int = TRAIN_DOCS
) -> DataFrame:
    """(doc_id, score): probability that label is 1, for each row of docs.

    Word vectors are of all rows. The network is trained on at most train_docs labelled documents outside fold
    `out` (crc32 of the id modulo folds); a fifth of those serve the temperature alone. Null and empty texts
    are scored as a text without words. Of several labels of an id the largest counts, of several labelled texts of
    an id one; rows with a null id or
    label train nothing; without labels of both kinds every score is the labels' mean (0.5 without any). Null ids
    stay null, repeated rows give repeated rows, other columns are ignored, an empty table gives none.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    vectors = word_vectors(own)
    shared = spark.sparkContext.broadcast(vectors)
    marks = F.broadcast(sample(labels, id_col, label, folds, out, train_docs))  # at most train_docs rows
    rows = own.join(marks, "id").select("id", "text", "y").mapInArrow(_pool(shared), "id long, y int, x binary")
    # one row an id, however often it is there: train_docs rows of a few hundred bytes reach the driver
    rows = rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y")
    rows = rows.withColumn("held", fold(F.col("id"), 7) == 0).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows])
    network = None
    if len(y) and y.min() != y.max():
        network = Network(np.array([tx.of(bytes(r["x"]), np.float32) for r in rows]), y, np.array([r["held"] for r in rows]))
    model = spark.sparkContext.broadcast((vectors, network, float(y.mean()) if len(y) else 0.5))
    return own.mapInArrow(_score(model), "id long, score double").select(real_id(F.col("id")).alias(id_col), "score")
