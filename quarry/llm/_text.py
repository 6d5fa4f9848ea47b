"""Words, word hashes and window hashes of whole batches of texts, without a loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes depend on nothing but the bytes:
they are equal on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at a time, unless one text is longer.
BLOCK = 2 << 20
_CHUNK = 1 << 16
_P = 0x9E3779B97F4A7C15
_B = 0xD1342543DE82EF95
_MASK = 2**64 - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_P))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_POW = np.cumprod(np.append(U(1), np.full(_CHUNK, _P, U)))
_INV = np.cumprod(np.append(U(1), np.full(_CHUNK, pow(_P, -1, 2**64), U)))


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, bounds) of runs of whole texts; text k is bytes[bounds[k]:bounds[k + 1]]; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for lo, hi, data, bounds in text_blocks(batch.column("text"), most):
            yield ids[lo:hi], data, bounds


def text_blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, counts): byte offsets of the words, and the number of words in each text."""
    is_word = _WORD[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    first[edge] = is_word[edge]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edge = bounds[1:][bounds[1:] > 0] - 1
    last[edge] = is_word[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, bounds))


#: ASCII punctuation.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def cores(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words without the punctuation around them, however much; words of nothing else as they are."""
    at = np.flatnonzero(~PUNCT[data])
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    has = hi > lo
    s, e = start.copy(), end.copy()
    s[has], e[has] = at[lo[has]], at[hi[has] - 1] + 1
    return s, e


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; with lower, A-Z count as a-z."""
    table, out, i, n = (_LOWER if lower else _BYTE), np.empty(len(start), U), 0, len(start)
    while i < n:
        a = int(start[i])
        j = int(np.searchsorted(end, a + _CHUNK, "right"))
        if j <= i:
            total = 0
            for at in range(a, int(end[i]), _CHUNK):
                part = data[at : min(at + _CHUNK, int(end[i]))]
                total += int((table[part] * _POW[: len(part)]).sum(dtype=U)) * pow(_P, at - a, 2**64)
            out[i], i = total & _MASK, i + 1
            continue
        part = data[a : int(end[j - 1])]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(table[part] * _POW[: len(part)], out=sums[1:])
        s = start[i:j] - a
        out[i:j] = (sums[end[i:j] - a] - sums[s]) * _INV[s]
        i = j
    return mix(out + (end - start).astype(U) * U(_P))


def rolling(h: np.ndarray, width: int, base: int = _B) -> np.ndarray:
    """Rabin-Karp value of each run of width hashes, from the values of runs of 1, 2, 4 and so on."""
    out, done, now, length = None, 0, h, 1
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U)
    while done < width:
        if width & length:
            out = now[:n] if out is None else out + now[done : done + n] * U(pow(base, done, 2**64))
            done += length
        if done < width:
            now = now[:-length] + now[length:] * U(pow(base, length, 2**64))
            length *= 2
    return out


def windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position among all words, words of its text before it) of each window that lies within one text."""
    many = np.maximum(counts - width + 1, 0)
    inside = ragged(many)
    return np.repeat(np.cumsum(counts) - counts, many) + inside, inside


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of counts values, modulo 2**64 for unsigned ones."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    at = np.concatenate(([0], np.cumsum(counts)))
    return total[at[1:]] - total[at[:-1]]


def of(binary: bytes, kind) -> np.ndarray:
    return np.frombuffer(binary, kind)


def dealt(keys: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows by key, in their order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    arrays = [x[order] for x in arrays]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    for lo, hi in zip(at[:-1], at[1:]):
        yield int(keys[lo]), [x[lo:hi] for x in arrays]
