"""Operators against brute force where ids are null or repeated, texts very long or names clash."""

import json
import random
import time
import zlib

import pytest

from quarry.llm.chat import format_chat, turn_calls
from quarry.llm.decontaminate import contaminated
from quarry.llm.html_extract import extract_main_text, main_texts
from quarry.llm.jaccard import COMMON, common_shingles, ngram_jaccard_join
from quarry.llm.quality_model import quality
from quarry.llm.quality_rules import quality_rules
from quarry.llm.shard import kd_shards
from quarry.llm.toxicity import toxicity
from tests.llm import brute


def random_docs(n: int = 240) -> list[tuple]:
    rng = random.Random(5)
    out = []
    for k in range(n):
        text = "x" * rng.choice([0, 3, 40, 41, 400, rng.randint(1, 3000)])
        out.append((k, text or None, rng.choice(["en", "de", None]), rng.choice(["https://a.org", "https://b.org", "c", None]), rng.choice([None, len(text), 7])))
    return out


@pytest.mark.parametrize("count", [5, 24])
def test_shards_are_those_of_brute_force(spark, count):
    docs = random_docs()
    got = kd_shards(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), shards=count).collect()
    size = lambda t: len((t or "").encode()) + 8
    want = brute.shards([(i, size(t), zlib.crc32((t or "").encode()), n, lang, source) for i, t, lang, source, n in docs], count, 3)
    assert {r.doc_id: r.shard for r in got} == want
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (size(t), zlib.crc32((t or "").encode())) for i, t, *_ in docs}


def test_shards_of_target_bytes_and_of_rows_without_ids(spark):
    t = spark.createDataFrame([(None, "same", 1, 2)] * 400 + [(3, "z" * 92, 1, 2)] * 20, "doc_id long, text string, node int, u int")
    got = kd_shards(t, target_bytes=1000).toPandas()
    assert len(got) == 420 and got.shard.nunique() == 7 and got.groupby("shard")["size"].sum().max() <= 1200 and got.doc_id.isna().sum() == 400
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for options in ({}, {"shards": 2, "target_bytes": 9}):
        with pytest.raises(ValueError):
            kd_shards(t, **options)


def test_classifiers_take_null_and_repeated_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    docs = [(k, " ".join([word() for _ in range(20)] + ["((rotten!!!!!!))"] * (k % 3 == 0)) + ".") for k in range(150)]
    docs += [docs[0]] * 30 + [(None, "rotten words."), (None, None), (7, ""), (8, "é" * 300_000), (9, "!" * 5000 + " ü-ß. " * 10)]
    labels = [(k, int(k % 3 > 0), int(k % 3 == 0)) for k in range(150)] + [(None, 1, 1), (3, None, None), (5, 0, 0), (5, 0, 0), (999, 1, 1)]
    d = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, y int, score int, words string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for scored in (quality(d, marks), toxicity(d, marks)):
        got = scored.collect()
        assert len(got) == len(docs) and sum(r.doc_id is None for r in got) == 2 and all(0 <= r.score <= 1 for r in got)
    bad = {r.doc_id: (r.score >= 0.7, r.offending) for r in got if r.doc_id is not None and r.doc_id not in (7, 8, 9)}
    assert sum(bad[k][0] == (k % 3 == 0) for k in bad) >= 0.97 * len(bad) and any("rotten" in s for s in bad[3][1])


def test_pages_with_null_ids_repeated_rows_and_clashing_names(spark):
    page = "<nav><a href=x>menu</a></nav><article><p>the text of the article, as long as that</p></article>"
    d = spark.createDataFrame([(None, "u", page, "t", 1), (1, None, page, "t", 2), (1, None, page, "t", 2)], "page_id long, url string, html string, text string, n_chars long")
    want = "the text of the article, as long as that"
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(d).orderBy("page_id").collect()] == [(None, "u", want, len(want)), (1, None, want, len(want)), (1, None, want, len(want))]


def test_pages_keep_drawings_objects_and_formulas():
    body = 'we see <svg viewBox="0"><title>icon</title><g><text x="1">forty <tspan>two</tspan></text><path d="M0"/></g></svg> and <object data="m.mp4">a film of it</object> in <math><mi>x</mi></math>, as said'
    assert main_texts([f"<article><h1>Title</h1><p>{body}</p></article>"]) == ["Title\n\nwe see forty two and a film of it in x, as said"]


def test_broken_pages_take_linear_time():
    article = "<article><p>" + "word " * 40 + "</p></article>"
    for junk in ("</i>" * 60_000, "<b>" * 20_000 + "<p>x" * 20_000, "<div>" * 3_000 + "</span>" * 30_000, "<li>x" * 30_000):
        began = time.process_time()
        assert main_texts([junk + article])[0] is not None
        assert time.process_time() - began < 20


def conversation() -> list[tuple]:
    call = lambda i, after=(), name="add", args=None: {"id": i, "name": name, "arguments": {"x": 1} if args is None else args, "after": list(after)}
    chain = [call(f"c{k}", [f"c{k - 1}"] if k else []) for k in range(100)]
    random.Random(1).shuffle(chain)
    ladder = [call("l0")] + [call(f"l{k}", [f"l{j}" for j in (k - 1, k - 2) if j >= 0]) for k in range(1, 6)]
    odd = [call("p", ["q"]), call("q", ["p"]), call("r", ["p"]), call("s", ["nobody"]), call("c5"), call(None), {"id": "t", "name": None, "arguments": [1]}]
    said = lambda calls: json.dumps({"tool_calls": calls})
    answer = lambda i, text="ok": json.dumps({"tool_call_id": i, "content": text})
    return [
        (1, 0, "tool", answer("c7", "early")), (1, 1, "assistant", said(chain)), (1, 2, "assistant", said(ladder + odd)), (1, 3, "tool", answer("c7", "late")), (1, 4, "tool", answer("nobody")),
        (1, 5, "tool", answer(None)), (1, 6, "user", "{broken"), (1, 6, "user", "{broken"), (2, 0, "assistant", said([call("c0")])), (None, 0, "user", None), (2, 1, None, "x" * 300_000),
    ]


def test_chat_levels_cycles_duplicates_and_broken_json(spark):
    t = spark.createDataFrame([(*r, "x", 1) for r in conversation()], "conv_id long, turn long, role string, text string, status string, level int")
    got = format_chat(t).collect()
    calls = {(r.conv_id, r.call_id, r.status): r for r in got if r.part == 1 and r.call_id}
    level = {c: r.level for (conv, c, status), r in calls.items() if conv == 1 and status not in ("duplicate", "cycle")}
    assert all(level[f"c{k}"] == k for k in range(100)) and all(level[f"l{k}"] == k for k in range(6)) and level["s"] == 0
    assert {c for (_, c, status) in calls if status == "cycle"} == {"p", "q", "r"} and (1, "c5", "duplicate") in calls and (2, "c0", "no_result") in calls
    assert calls[1, "t", "no_result"].problems == ["arguments: not an object"] and not calls[1, "t", "no_result"].valid
    results = [(r.call_id, r.status, r.turn, r.level) for r in got if r.part == 2]
    assert sorted(results, key=str) == sorted([("c7", "linked", 1, 7), ("c7", "duplicate", 1, 7), ("nobody", "no_call", 4, 0)], key=str)
    assert sum(r.part == 0 and r.json == '{"content":"{broken","role":"user"}' for r in got) == 2
    assert sum(r.part == 1 for r in got) == 100 + 6 + 7 + 1


def test_turns_become_calls(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 400), (1, 2, "user", "go on"), (1, 3, "assistant", "b"), (1, None, "assistant", "c"), (1, 4, "user", None)], "conv_id long, turn long, role string, text string")
    got = {(r.turn, r.part): (r.call_id, r.level, r.status) for r in format_chat(turn_calls(t)).where("part > 0").collect()}
    assert got == {(1, 1): ("turn-1", 0, "linked"), (1, 2): ("turn-1", 0, "linked"), (3, 1): ("turn-3", 1, "no_result")}


def test_verdicts_of_quality_rules_are_those_of_brute_force(spark):
    rng = random.Random(6)
    text = lambda n, mark="": " ".join("".join(rng.choice("abcdef") for _ in range(4)) + (mark if rng.random() < 0.5 else "") for _ in range(n))
    docs = [(k, text(25), "en") for k in range(700)] + [(700 + k, text(25, "#" * rng.randint(1, 3)), "en") for k in range(120)]
    docs += [(900 + k, text(22) + "\n" + "\n".join([text(3)] * (k % 4)), rng.choice(["de", "fr", None])) for k in range(160)] + [(2000, None, None), (None, text(30, "##"), "en"), docs[3], docs[3]]
    labels = {i: int(i < 700 if i < 900 else i % 4 < 2) for i, *_ in docs[:-4]} | {None: 1, 5000: 1, 4: None}
    want = brute.kept_by_rules(docs, labels)
    d = spark.createDataFrame([(i, t, lang, True, 0) for i, t, lang in docs], "doc_id long, text string, lang string, kept boolean, n_words int")
    got = quality_rules(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in got) == sorted((i is None, i or 0, k) for (i, *_), k in zip(docs, want))
    assert any(not k for (i, *_), k in zip(docs, want) if i is not None and 700 <= i < 820) and sum(want[:700]) > 0.97 * 700


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefg") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 8, 14])))) for k in range(12)] + [(12, None), (13, " "), (None, "a null item of six words")]
    docs = []
    for k in range(60):
        parts = rng.choice(items[:12])[1].split()
        at = rng.randint(0, len(parts))
        docs.append((k, " ".join([*parts[at:], *(word() for _ in range(rng.randint(0, 6))), *parts[:at]])))
    docs += [(60, None), (61, "tail " * 60_000 + items[2][1].upper()), (None, "so A null ITEM of six words"), docs[0], (62, "")]
    got = contaminated(spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t in docs:
        if i == 61:
            t = "tail " * 20 + items[2][1].upper()
        for j, x in items:
            n, c = brute.covered(x, t)
            if n and c >= n / 2:
                want.append((i, j, n, c))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.item_id, r.n_item_words, r.n_covered) for r in got), key=key) == sorted(want, key=key)


def with_partitions(spark, parts: str, function, table) -> list:
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return function(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_join_with_one_shingle_in_every_third_document(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    docs, common = [], "one two three four five"
    for k in range(300):
        base = docs[rng.randrange(len(docs))][1] if docs and rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(4, 40)))
        w = base.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        docs.append((k, " ".join(w) + (f" {common}" if k % 3 == 0 and common not in base else "")))
    want = brute.components(docs)
    for parts in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = {r.doc_id: r.component_id for r in ngram_jaccard_join(table).collect()}
        assert got == want
        # the lists that no task gets: few, each as long as a part of a task's share at least
        hashes, places = common_shingles(table.selectExpr("doc_id id", "text"), 5, 100)
        assert 0 < len(hashes) <= 100 * COMMON and (hashes[1:] > hashes[:-1]).all() and 100 <= places.max() <= sum(common in text for _, text in docs)
        many = {r.doc_id: r.component_id for r in with_partitions(spark, "100", ngram_jaccard_join, table)}
        assert many == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert 20 < len(set(want.values())) < 280
