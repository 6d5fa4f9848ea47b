"""Each operator on small tables against brute force, with nulls, empty and repeated rows and extra columns."""

import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm.chat import format_chat
from quarry.llm.decontaminate import contaminated, tiles
from quarry.llm.html_extract import extract_main_text, main_texts
from quarry.llm.jaccard import ngram_jaccard_join
from quarry.llm.packing import Tokens, _complement, best_fit_packing, pack_lengths
from quarry.llm.quality_model import quality
from quarry.llm.quality_rules import quality_rules
from quarry.llm.shard import kd_shards
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tag string"


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(30, 80))) for _ in range(12)]
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "A b c"), (5, "a B c"), (6, "x" * 200_000), (7, "same words again " * 40)]
    for k in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        out.append((10 + k, " ".join(w) + rng.choice(["", " " + rng.choice(base)])))
    return [*out, out[20], (100, out[20][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y") for i, t in rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(docs, empty):
    sets = {}
    for i, t in rows():
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and root[a] > root[b]:
                    root[a], changed = root[b], True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    assert ngram_jaccard_join(empty).count() == 0


def test_jaccard_does_not_link_by_repeated_or_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    data = [(1, a), (1, b), (2, b + " end"), (3, c), (4, d), (None, c + " end"), (None, d + " end"), (None, "alone"), (None, None)]
    got = ngram_jaccard_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 36, 3), (4, 36, 4), (None, 37, 3), (None, 37, 4), (None, 1, None), (None, 0, None)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in sorted(dict(rows()).items()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()} == want
    assert substring_dedup(docs).count() == len(rows()) and substring_dedup(empty).count() == 0


def test_quality_rules_base(spark, docs, empty):
    labels = spark.createDataFrame([(10, 1), (11, 0), (None, 1), (12, None)], "doc_id long, quality int")
    for r in quality_rules(docs, labels).collect():
        w = (dict(rows())[r.doc_id] or "").split()
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(covered))
        assert r.kept == (not r.base_failed)
    assert quality_rules(empty, labels).count() == 0


def test_quality_rules_cutoffs(spark):
    good = [(k, "word " + " ".join(f"w{k}x{j}" for j in range(30)), "en") for k in range(3000)]
    bad = [(k, " ".join(f"w{k}x{j}###" for j in range(30)), "en") for k in range(3000, 3200)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 3000)) for k in range(3200)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules(d, labels).collect()}
    assert all(got[k] == (k < 3000) for k in got)


def test_tiles_find_reordered_passages(spark, docs, empty):
    item = " ".join(f"q{k}" for k in range(20))
    w = item.split()
    d = spark.createDataFrame([(1, "a b " + " ".join(w[10:] + ["zz"] + w[:10]).upper()), (2, "clean text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = contaminated(d, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_covered) for r in got] == [(1, 7, 20)]
    assert [(r.doc_id, r.item_id) for r in contaminated(d, bench, broadcast_bytes=8).collect()] == [(1, 7)]
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert tiles(np.array([0, 1, 0]), np.array([5, 6, 20]), 3) == [(0, 5, 4)]


def test_packing(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = best_fit_packing(docs, path).toPandas()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows()}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    pieces = [(i, k, at, min(4096, len(ids[i]) - at)) for i, _ in rows() for k, at in enumerate(range(0, len(ids[i]), 4096))]
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length)) == Counter(pieces)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert best_fit_packing(empty, path).count() == 0


def test_ids_are_the_tokenizers_own():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(9)
    marks = ["'s", "'", "''s", "<|endoftext|>", "<|", "a|b", "|", "É", "ß", "İ", "ﬁ", "e\u0301", "×", "÷", "日本", "\u00a0", "\u2003", "\x01", "don't", "I'LL", "12", "x9y", "--", "Ångström,", "\ufffd", "🙂", "Ĳ", "ſ", "\x1c"]
    texts = ["".join(rng.choice([*marks, " ", " ", "\n", "The ", "Word.", "naïve "]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += [t for _, t in rows() if t is not None]
    data = [t.encode() for t in texts]
    flat, many = Tokens(path).encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for t, own in zip(texts, np.split(flat, np.cumsum(many)[:-1])):
        assert own.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_packing_uses_complements():
    assert sum(n for _, n in pack_lengths({6: 2, 4: 1, 3: 1, 1: 1, 10: 1}, 10)) == 3


def test_complements_are_on_hand():
    rng = random.Random(4)
    cases = [([8, 5, 4, 3, 2], 20)] + [([rng.randint(1, 12) for _ in range(rng.randint(1, 7))], 24) for _ in range(400)]
    for lengths, capacity in cases:
        top = max(lengths)
        rest = Counter(lengths) - Counter([top])
        sums = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(rest.elements(), k)}
        found = _complement(np.bincount(lengths, minlength=capacity + 1), top, capacity - top)
        assert (found is not None) == (capacity - top in sums)
        assert found is None or (sum(found) == capacity - top and not Counter(found) - rest)


def test_shards(docs, empty):
    got = kd_shards(docs, shards=5).toPandas()
    assert len(got) == len(rows()) and set(got.shard) <= set(range(5))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert dict(zip(got.doc_id, got.text_crc32)) == {i: zlib.crc32((t or "").encode()) for i, t in rows()}
    assert kd_shards(empty, shards=24).count() == 0


@pytest.mark.parametrize("sizes", [[3], [3] * 2, [3] * 7, [3] * 24, [0, 5, 9000] + [3] * 300])
def test_shards_of_few_rows_and_of_one_large_document(spark, sizes):
    t = spark.createDataFrame([(k, "x" * n, "en", "s", n) for k, n in enumerate(sizes)], "doc_id long, text string, lang string, source string, n_chars long")
    got = kd_shards(t, shards=24).toPandas()
    assert sorted(got.doc_id) == list(range(len(sizes))) and set(got.shard) <= set(range(24))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shards_tell_long_sources_apart(spark):
    t = spark.createDataFrame([(k, f"text {k}", "en", f"https://site{k % 4}.org", 6) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    t = t.union(spark.sql("select 40L + id, concat('text ', id), 'en', cast(null as string), 6L from range(10)"))
    got = kd_shards(t, shards=5).toPandas()
    source = np.where(got.doc_id < 40, got.doc_id % 4 + 1, 0)
    assert sorted(set(zip(source, got.shard))) == [(k, k) for k in range(5)]


def test_chat_links_orders_and_validates(spark):
    calls = [{"id": "b", "name": "add", "arguments": {"y": 2, "x": 1}, "after": ["a"]}, {"id": "a", "name": "get", "arguments": {"u": 5}}]
    t = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("add", ["x", "y"], {"x": "number", "y": "integer"}), ("get", ["u"], {"u": "string"})], "name string, required array<string>, types map<string,string>")
    got = [(r.part, r.call_id, r.status, r.valid, r.json) for r in format_chat(t, tools).where("conv_id = 1 and part > 0").orderBy("turn", "level", "part").collect()]
    assert got == [
        (1, "a", "linked", False, '{"arguments":{"u":5},"id":"a","name":"get"}'),
        (2, "a", "linked", None, '{"content":"r","role":"tool","tool_call_id":"a"}'),
        (1, "b", "no_result", True, '{"arguments":{"x":1,"y":2},"id":"b","name":"add"}'),
    ]
    assert format_chat(t.limit(0)).count() == 0


def test_html(spark):
    page = '<nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>T &amp; t</h1><p>some  words<br>here, and more of them</p></article><footer>&copy; x</footer>'
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_main_text(d).collect()} == {1: "T & t\n\nsome words here, and more of them", 2: "", 3: ""}


@pytest.mark.parametrize(
    "icon",
    ['<svg class="i"/>', "<svg/>", '<svg a="/" b=\'>\' />', "<math/>", "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<select-box></select-box>", '<object-view a="b"></object-view>', "<svg><path d='M0'/></svg>"],
)
def test_html_keeps_what_follows_icons(icon):
    page = f"<nav><ul><li><a href=x>{icon}Home</a></li></ul></nav><article><h1>Title</h1><p>the article text, and more of it</p></article>"
    assert main_texts([page]) == ["Title\n\nthe article text, and more of it"]


def test_html_formulas_and_noscript():
    formula = '<math><semantics><mrow><mi>E</mi><mo>=</mo><mspace/><mi>m</mi></mrow><annotation encoding="tex">E=m</annotation></semantics></math>'
    page = (
        "<head><noscript>no head</noscript></head><body><noscript><p>Please enable the scripts of this page to see all of it.</p></noscript>"
        f"<article><h1>Title</h1><p>we know that {formula} holds <noscript><img src=x></noscript> for all of them</p>"
        "<noscript><form><p>sign in</p></form><p>a table in words</p></noscript><p>the last words of the article</p></article></body>"
    )
    assert main_texts([page]) == ["Title\n\nwe know that E=m holds for all of them\n\na table in words\n\nthe last words of the article"]


def test_classifiers(spark, docs, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    data = []
    for k in range(400):
        w = [word() for _ in range(30)]
        if k % 4 == 0:
            w[7] = "rotten"
        data.append((k, " ".join(x + "%%%" * (k % 5 == 0) for x in w) + ".", int(k % 5 != 0), int(k % 4 == 0)))
    d = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")
    bad = {r.doc_id: r for r in toxicity(d.select("doc_id", "text"), d).collect()}
    assert np.mean([(bad[k].score >= 0.7) == (k % 4 == 0) for k in bad]) > 0.97
    fine = {r.doc_id: r.score for r in quality(d.select("doc_id", "text"), d).collect()}
    assert np.mean([(fine[k] >= 0.3) == (k % 5 != 0) for k in fine]) > 0.97
    none = d.limit(0)
    assert all(0 <= r.score <= 1 for r in quality(docs, none).collect()) and quality(empty, none).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity(docs, none).collect()) and toxicity(empty, none).count() == 0


