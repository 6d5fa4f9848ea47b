"""Plain versions of the operators, over lists of (doc_id, text, lang), for small tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from quarry.llm.quality_rules import CUTOFFS, FOLDS, LEVEL, RISK


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def components(docs: list[tuple]) -> dict:
    """Smallest id reachable by links, of every id."""
    sets = [(i, shingles(t)) for i, t, *_ in docs if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            both = len(s & t)
            if both and 100 * both >= 80 * len(s | t):
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {i: top(i) for i in root}


def dedup(docs: list[tuple], width: int = 20) -> dict:
    """(words, removed words, kept text) of every id; a null id comes last."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in docs}, key=lambda d: (d[0] is None, d[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def base(text: str | None) -> dict:
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
    out = {
        "n_words": len(w),
        "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    return out | {"n_lines": len(lines), "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def ratios(b: dict) -> dict:
    share = lambda x, y: 100.0 * x / y if y else 0.0
    return {
        "symbols": share(b["n_symbols"], b["word_chars"]),
        "dup_lines": share(b["n_dup_lines"], b["n_lines"]),
        "repeats": share(b["n_repeat_words"], b["n_words"]),
        "word_length": share(b["word_chars"], b["n_words"]),
    }


def kept_by_rules(docs: list[tuple], labels: dict) -> list[bool]:
    """The verdict on every row, with the walk over cutoffs ended by the exact binomial sum."""
    found = [(base(t), lang or "") for _, t, lang in docs]
    held = [
        (s, labels[i], ratios(b), int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % FOLDS == 0)
        for (i, *_), (b, s) in zip(docs, found)
        if i is not None and labels.get(i) is not None and not b["base_failed"]
    ]
    strata = {s for s, *_ in held}
    n = Counter(s for s, y, _, choosing in held if y and not choosing)
    pool = {s: s if (1 - RISK) ** n[s] <= LEVEL / len(strata) else None for s in strata}
    cuts: dict = {}
    for p in set(pool.values()):
        own = [(y, r, choosing) for s, y, r, choosing in held if pool[s] == p]
        count = lambda chosen, want, rule, c: sum(1 for y, r, x in own if x == chosen and y == want and r[rule] > c)
        chosen = sum(1 for y, _, x in own if y and x)
        walk = sorted((count(True, 1, rule, c), -k, -count(True, 0, rule, c), rule, c) for rule, cs in CUTOFFS.items() for k, c in enumerate(cs))
        walk = [w for w in walk if w[2] < 0 and w[0] <= RISK * chosen]
        tests = [r for y, r, x in own if y and not x]
        for t in range(len(walk)):
            k = sum(any(r[w[3]] > w[4] for w in walk[: t + 1]) for r in tests)
            if sum(math.comb(len(tests), i) * RISK**i * (1 - RISK) ** (len(tests) - i) for i in range(k + 1)) > LEVEL / len(strata):
                break
            cuts[p, walk[t][3]] = min(cuts.get((p, walk[t][3]), math.inf), walk[t][4])
    return [not b["base_failed"] and all(s not in pool or v <= cuts.get((pool[s], rule), math.inf) for rule, v in ratios(b).items()) for b, s in found]


def covered(item: str | None, text: str | None) -> tuple[int, int]:
    """(words of the item, words of it in tiles): the longest free match is marked, again and again."""
    p, t = words((item or "").lower()), words((text or "").lower())
    least = min(5, len(p))
    in_p, in_t = set(), set()
    if len(p):
        while True:
            longest = (0, 0, 0)
            for a in range(len(p)):
                for b in range(len(t)):
                    n = 0
                    while a + n < len(p) and b + n < len(t) and p[a + n] == t[b + n] and a + n not in in_p and b + n not in in_t:
                        n += 1
                    longest = max(longest, (n, -a, -b))
            n, a, b = longest[0], -longest[1], -longest[2]
            if n < least:
                break
            in_p.update(range(a, a + n))
            in_t.update(range(b, b + n))
    return len(p), len(in_p)


def contaminated(items: list[str | None], text: str | None) -> bool:
    return any(n and c >= n / 2 for n, c in (covered(x, text) for x in items))


def shards(rows: list[tuple], count: int, dims: int) -> dict:
    """The shard of each (id, size, crc, *dimensions): a node is cut where the middle of a row passes its share."""
    ranks = []
    for d in range(dims):
        values = {r[3 + d] for r in rows}
        order = {v: k for k, v in enumerate(sorted(v for v in values if isinstance(v, str)))}
        ranks.append({v: -1.0 if v is None else float(order[v]) if isinstance(v, str) else float(v) for v in values})
    own = [(r[0], r[1], r[2], *(ranks[d][r[3 + d]] for d in range(dims))) for r in rows]
    extent = lambda part, d: max(r[3 + d] for r in part) - min(r[3 + d] for r in part)
    whole = [extent(own, d) or 1.0 for d in range(dims)]
    out: dict = {}

    def split(part: list[tuple], k: int, first: int) -> None:
        if not part:
            return
        if k == 1:
            out.update({r[0]: first for r in part})
            return
        d = max(range(dims), key=lambda d: (extent(part, d) / whole[d], -d))
        goal, run, sides = sum(r[1] for r in part) * (k // 2) / k, 0, ([], [])
        for r in sorted(part, key=lambda r: (r[3 + d], r[2], r[0])):
            run += r[1]
            sides[run - r[1] / 2 > goal].append(r)
        split(sides[0], k // 2, first)
        split(sides[1], k - k // 2, first + k // 2)

    split(own, count, 0)
    return out
