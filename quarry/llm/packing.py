"""Packing of token sequences into as few fixed-length training sequences as possible.

Texts are tokenized once; what travels afterwards are the lengths. The packing itself works on the
histogram of lengths (at most `capacity` numbers, whatever the input), so it needs no pass over documents:

1. Exact complements: for each length, longest first, a hash of the lengths on hand is asked for one, a pair
   or three lengths whose sum is exactly the gap; the combination is used as often as availability allows.
2. What is left is packed by best fit, longest first.

The result is a short table of patterns and how often each is used (every step uses up a length or a group of
open sequences, so it has a few times `capacity` rows). Pieces find their place in it by their rank among the
pieces of their length; the ranks come from a range partitioning, so a length that a third of all pieces have
is counted by many tasks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import _text as tx
from quarry.llm._spark import cut, documents, partitions, real_id

CAPACITY, END_ID = 4096, 1
#: The rules of vocabularies whose words may skip them, in the tokenizers library's own form.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of Latin letters that are composed and have a lower case of one letter, and of printable ASCII.
_PLAIN = re.compile(r"(?!.*<\|)[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017e]+|[0-9]|[^a-z0-9\u00c0-\u017e]+")
#: Byte-level vocabularies write byte b as a printable character: itself, or the next one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Pieces whose ids a Python worker remembers.
REMEMBERED = 1_000_000
_PIECES = "id long, piece int, start long, length long, crc long"
#: Classes of bytes: 0 white space, 1 letter, 2 digit, 3 mark, 4 what makes its word odd, 5 and 6 the bytes of Latin letters.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[39] = 1, 2, 0, 4
_CLASS[195:198], _CLASS[128:192] = 5, 6
#: Code points below 0x180 that _PLAIN takes as letters.
_LATIN = np.array([k > 127 and _PLAIN.fullmatch(chr(k)) is not None for k in range(384)])
_ODD = tx.U(0xC2B2AE3D27D4EB4F)


class Tokens:
    """Little-endian 32-bit ids of whole texts. White space never enters a token of the vocabulary, so a text's ids
    are those of its words in turn. Under the vocabulary's own rules a Latin word without apostrophes falls into
    runs of letters, single digits and runs of marks; such pieces are cut and hashed for a whole block at a time,
    and each distinct piece is merged only once a worker. All other words are odd: pieces of their own."""

    _own: dict[str, Tokens] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.plain = (rules["normalizer"], rules["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        mark = self._ids("|")
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        """Known pieces: hashes in order, and where their ids lie in `flat`."""
        self.keys, self.at, self.many = np.empty(0, tx.U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    @classmethod
    def at_path(cls, path: str) -> Tokens:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, pieces: list[bytes], odd: list[bool]) -> tuple[array, list[int]]:
        """Ids of the pieces in turn, and how many each has. Even pieces go to the merges as they are, odd but plain
        ones in the pieces that the vocabulary's rules give."""
        merge, ids, many, ends = self.tokenizer.model.tokenize, array("I"), [], []
        whole = [k for k, w in enumerate(pieces) if odd[k] and not (self.plain and _PLAIN.fullmatch(w.decode(errors="replace")))]
        known = dict(zip(whole, self._learn_whole([pieces[k] for k in whole])))
        for k, w in enumerate(pieces):
            if k in known:
                ids.frombytes(known[k].tobytes())
            elif not odd[k] and w.isascii():
                ids.extend([t.id for t in merge(w.lower().decode())])
            else:
                text = w.decode().lower()
                for piece in _PIECE.findall(text) if odd[k] else (text,):
                    if not piece.isascii():
                        piece = piece.encode().decode("latin-1").translate(_BYTES)
                    ids.extend([t.id for t in merge(piece)])
            ends.append(len(ids))
        return ids, np.diff(ends, prepend=0)

    def _learn_whole(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [self._ids(w.decode(errors="replace")) if self.mark is None or b"|" in w else None for w in words]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), 2000):
            group = rest[at : at + 2000]
            ids = self._ids(b" | ".join(words[k] for k in group).decode(errors="replace"))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(group):
                raise ValueError("the vocabulary joins words across white space")
            for k, own in zip(group, np.split(ids, ends[:-1])):
                out[k] = own if k == group[0] else own[1:]
        return out

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash, whether it is an odd word, pieces of each text)"""
        a, b, _ = tx.words(data, bounds)
        kind = _CLASS[data]
        lead = np.flatnonzero(kind == 5)
        lead = lead[lead + 1 < len(data)]
        lead = lead[kind[lead + 1] == 6]
        lead = lead[_LATIN[(data[lead].astype(np.int64) & 31) << 6 | (data[lead + 1] & 63)]]
        kind[lead], kind[lead + 1] = 1, 1
        bad = kind >= 4 if self.plain else kind > 0
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(bad, out=sums[1:])
        odd = sums[b] > sums[a]
        first = kind == 2
        first[1:] |= kind[1:] != kind[:-1]
        for x, y in zip(a[odd].tolist(), b[odd].tolist()):
            first[x:y] = False
        first &= kind > 0
        first[a] = True
        start = np.flatnonzero(first)
        word = np.cumsum(np.bincount(np.searchsorted(start, a), minlength=len(start))) - 1 if len(a) else start
        end = np.minimum(np.append(start[1:], len(data)), b[word])
        odd = odd[word]
        h = tx.word_hashes(data, start, end, lower=True)
        own = np.flatnonzero(odd)
        if len(own):
            h[own] = tx.mix(tx.word_hashes(data, start[own], end[own]) ^ _ODD)
        return start, end, h, odd, np.diff(np.searchsorted(start, bounds))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)"""
        start, end, h, odd, counts = self._pieces(data, bounds)
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        distinct, where = sorted_h[new], np.empty(len(h), np.int64)
        where[order] = np.cumsum(new) - 1
        example = order[new]  # a piece with each hash
        if len(self.keys) + len(distinct) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        unknown = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(unknown):
            at = example[unknown]
            ids, many = self._learn([data[x:y].tobytes() for x, y in zip(start[at].tolist(), end[at].tolist())], odd[at].tolist())
            heads = len(self.flat) + np.cumsum(many) - many
            self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
            self.keys, self.at, self.many = (np.insert(x, place[unknown], y) for x, y in ((self.keys, distinct[unknown]), (self.at, heads), (self.many, many)))
            place = np.searchsorted(self.keys, distinct)
        many = self.many[place][where]
        ids = self.flat[np.repeat(self.at[place][where], many) + tx.ragged(many)]
        return ids.astype("<u4", copy=False), tx.sums_by(many, counts)


def _tokenize(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.at_path(path)
        for ids, data, bounds in tx.blocks(batches):
            flat, many = tokens.encode(data, bounds)
            flat, to = flat.tobytes(), (4 * np.cumsum(many)).tolist()
            rows = [
                (i, p, at, min(capacity, n - at), zlib.crc32(t[4 * at : 4 * (at + capacity)]))
                for i, t, n in ((i, flat[z - 4 * m : z] + end, m + 1) for i, m, z in zip(ids.tolist(), many.tolist(), to))
                for p, at in enumerate(range(0, n, capacity))
            ]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["id", "piece", "start", "length", "crc"]
            )

    return run


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, copies), ...] and how many sequences have each; every counted piece is used once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        have[length] += n
    used: list[tuple[list[tuple[int, int]], int]] = []

    def consume(parts: list[int]) -> bool:
        need = {x: parts.count(x) for x in parts}
        times = min(int(have[x]) // k for x, k in need.items())
        if times <= 0:
            return False
        for x, k in need.items():
            have[x] -= k * times
        used.append(([(x, k) for x, k in need.items()], times))
        return True

    if have[capacity]:
        consume([capacity])
    for length in range(capacity - 1, 0, -1):
        while have[length]:
            found = _complement(have, length, capacity - length)
            if found is None or not consume([length, *found]):
                break
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: list[tuple[int, int]], n: int) -> None:
        if gap == 0:
            used.append((pattern, n))
            return
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((pattern, n))

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, over = divmod(left, each)
                if full:
                    put(capacity - each * length, [(length, each)], full)
                if over:
                    put(capacity - over * length, [(length, over)], 1)
                break
            gap = gaps[at]
            pattern, n = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            each = min(gap // length, left)
            take = min(n, left // each)
            if take < n:
                put(gap, pattern, n - take)
            put(gap - each * length, [*pattern, (length, each)], take)
            left -= each * take
    return used + [x for gap in gaps for x in groups[gap]]


def _complement(have: np.ndarray, length: int, gap: int) -> list[int] | None:
    """One, two or three lengths on hand, none longer than length, that sum to gap; the longest first."""
    left = have.copy()
    left[length] -= 1
    if gap <= length and left[gap] > 0:
        return [gap]
    on_hand = np.flatnonzero(left[: min(gap, length + 1)] > 0)

    def pair(total: int, most: int) -> list[int] | None:
        a = on_hand[(on_hand <= min(total - 1, most)) & (2 * on_hand >= total)]
        if len(a):
            b = total - a
            ok = np.where(a == b, left[a] > 1, (left[a] > 0) & (left[b] > 0))
            if ok.any():
                k = int(np.flatnonzero(ok)[-1])
                return [int(a[k]), int(b[k])]
        return None

    if found := pair(gap, length):
        return found
    for a in on_hand[3 * on_hand >= gap][::-1]:
        left[a] -= 1
        found = pair(int(gap - a), int(a))
        left[a] += 1
        if found:
            return [int(a), *found]
    return None


def best_fit_packing(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of a document.

    tokenizer is a vocabulary file that every executor has. A document's ids are followed by end_id; only a
    document of more than `capacity` ids is cut, into pieces of `capacity` and a last one. sequence_id and
    offset say where the piece lies; the offsets of a sequence have no gaps.

    Null and empty texts have end_id alone. Rows with one id are separate documents of that id. A null
    id stays null. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    pieces = cut(documents(docs, id_col, text_col).mapInArrow(_tokenize(tokenizer, capacity, end_id), _PIECES))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, base, rank = [], 0, dict.fromkeys(counts, 0)
    for pattern, n in pack_lengths(counts, capacity):
        offset = 0
        for length, each in pattern:
            slots.append((length, rank[length], rank[length] + n * each, each, base, offset))
            rank[length] += n * each
            offset += length * each
        base += n
    table = spark.createDataFrame(slots, "length long, lo long, hi long, each long, base long, at long")

    # equal pieces, of copies without an id say, are told apart by their place in the written table
    numbered = pieces.withColumn("u", F.monotonically_increasing_id())
    dealt = cut(numbered.repartitionByRange(parts, "length", "id", "piece", "crc", "u").withColumn("pid", F.spark_partition_id()))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("length", "pid").count().select("length", "pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "pid").orderBy("id", "piece", "crc", "u")
    ranked = dealt.withColumn("r", F.row_number().over(own) - 1).join(ahead, ["length", "pid"]).withColumn("r", F.col("r") + F.col("ahead"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    return placed.select(
        real_id(F.col("id")).alias(id_col),
        "piece",
        "start",
        ranked["length"],
        F.col("crc").alias("ids_crc32"),
        F.expr("base + (r - lo) div each").alias("sequence_id"),
        (F.col("at") + F.expr("(r - lo) % each") * ranked["length"]).alias("offset"),
    )
