"""The pipeline on a small folder against the plain versions of its stages in turn."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm.decontaminate import decontaminate
from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rest string, kept boolean, starts int"
ITEMS = [(1, " ".join(f"q{k}" for k in range(24))), (2, "the only Seed words"), (3, None), (4, "")]


def rows() -> tuple[list[tuple], dict]:
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n))
    docs = [(k, text(24), "en") for k in range(1100)]
    labels = {k: 1 for k in range(1100)}
    for k in range(1100, 1160):  # symbols: a cutoff is admitted in en, and in no other stratum
        docs.append((k, " ".join(x + "##" for x in text(25).split()), ["en", "de", None][k % 3]))
        labels[k] = 0
    long, passage, q = text(6000), text(45), ITEMS[0][1].split()
    docs += [(2000, long, "en"), (2001, long + " end", "de"), (2002, text(60), "en")]
    docs += [(2003, docs[-1][1].replace(" ", "  ", 3).upper(), "en"), (2004, docs[-1][1] + " tail", None)]
    docs += [(2010 + k, f"{text(70)} {passage}\n{text(60)}", "de") for k in range(8)]
    docs += [(2030, f"{text(30)} {' '.join(q[14:])} {text(9)} {' '.join(q[2:12])} {text(20)}", "en"), (2031, f"{text(40)} {' '.join(q[:9])}", "en")]
    docs += [(2032, f"{text(30)} THE only seed WORDS {text(5)}", "en"), (2033, f"{text(30)} the only other words", "de")]
    docs += [(2040, None, "en"), (2041, "", "en"), (2042, "too short", None), (2043, "\n".join([text(12)] * 6), "en"), (2044, "é" * 50_000 + " " + text(30), "en")]
    docs += [(None, text(40), "en"), docs[5], docs[5]]
    return docs, labels | {None: 1, 9_999: 0, 2002: None}


def expected(docs: list[tuple], labels: dict) -> dict:
    docs = [d for d, kept in zip(docs, brute.kept_by_rules(docs, labels)) if kept]
    root = brute.components(docs)
    docs = list(dict.fromkeys(d for d in docs if d[0] is None or root[d[0]] == d[0]))
    texts = {i: t for i, (_, _, t) in brute.dedup(docs).items()}
    return {i: t for i, t in texts.items() if i is None or not brute.contaminated([x for _, x in ITEMS], t)}


def folder(spark, at, docs, labels, items) -> str:
    spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y", True, 0) for i, t, lang in docs], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_against_brute_force(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs, labels = rows()
    want = expected(docs, labels)
    assert {0, 2000, 2002, 2010, 2031, 2033, None} <= set(want) and not {1101, 2001, 2003, 2030, 2032, 2040, 2041, 2042, 2043} & set(want)
    assert all(len(brute.words(want[2010 + k])) == (175 if k == 0 else 130) for k in range(8))
    got = corpus_pipeline.run(spark, folder(spark, tmp_path / "t", docs, labels, ITEMS)).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = set()
    for i, t in want.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces |= {(-1 if i is None else i, k, at, zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    found = list(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.ids_crc32))
    assert len(found) == len(pieces) and set(found) == pieces
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 4096)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs, labels = rows()
    at = folder(spark, tmp_path / "t", docs[-12:], {}, [])
    none = folder(spark, tmp_path / "none", [], {}, [])
    for where, many in ((at, True), (none, False)):
        table = spark.read.parquet(f"{where}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, where)
            assert out.columns == table.columns, name
            assert (out.count() > 0) == many, name
    assert corpus_pipeline.run(spark, none).count() == 0


def test_unlike_texts_of_one_id_all_stay(spark):
    data = [(1, "b c d e f", "en", "s", 1, "x", "y", True, 0), (1, "a c d e f", "en", "s", 1, "x", "y", True, 0), (1, None, "en", "s", 1, "x", "y", True, 0)]
    for order in (data, data[::-1]):
        got = corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame([*order, order[0]], SCHEMA).repartition(1), "").collect()
        assert sorted(str(r.text) for r in got if r.text) == ["a c d e f", "b c d e f"]
        assert sum(r.text is None for r in got) == 1 + (order[0][1] is None)


def test_one_document_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    data = [(1, a), (1, b), (2, b + " end"), (3, c), (4, d), (None, c + " end"), (None, d + " end"), (5, d), (None, "alone in the world of texts")]
    t = spark.createDataFrame([(i, x, "en", "s", 1, "x", "y", True, 0) for i, x in data], SCHEMA)
    got = corpus_pipeline.keep_one_of_group(spark, t, "").collect()
    assert sorted((r.doc_id or 99, r.text) for r in got) == sorted([(1, a), (1, b), (3, c), (4, d), (99, data[-1][1])])


def test_a_row_goes_for_its_own_text(spark):
    q = ITEMS[0][1]
    data = [(1, "clean words " * 3), (1, q), (None, "x " + q), (None, "clean too"), (2, None)]
    t = spark.createDataFrame([(i, x, "en", "s", 1, "x", "y", True, 0) for i, x in data], SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.text) for r in decontaminate(t, bench).collect()}
    assert got == {data[0], data[3], data[4]}
