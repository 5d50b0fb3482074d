from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest

from clausemill.llm import toxicity as T
from clausemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, y int, Score string, doc string"
LABELS = "doc_id long, toxic int, quality int, text string"


def corpus(n=400):
    rng, rows, labels = random.Random(2), [], []
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "sel", "kun", "é"]) for _ in range(rng.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 90))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Grumblex", "zotfink", "zotfinks"])
        rows.append((i, " ".join(words), 1, "x", "x"))
        labels.append((i, int(bad), 0, "zotfink"))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_grams_see_the_whole_text_and_each_once(monkeypatch):
    text = "Ab\tcd É " * 50
    want = set(T.present(text))
    assert want == set(T.present(text.lower().replace("\t", "\n")))
    n = len(" " + text + " ")
    assert sum(len(g) for g in T.grams(text)) == sum(n - k + 1 for k in T.GRAMS)
    monkeypatch.setattr(T, "_BLOCK", 16)
    assert set(T.present(text)) == want
    assert len(T.present(None)) == len(T.present("")) == 0 and len(T.present("a")) == 1


def test_learns_rare_words_and_leaves_clean_texts_alone(spark):
    rows, labels = corpus()
    edge = [(900, None, 1, "x", "x"), (901, "", 1, "x", "x"), (None, "zotfink", 1, "x", "x"), (0, "again", 1, "x", "x"),
            (902, rows[1][1] * 3000, 1, "x", "x"), (903, rows[1][1] * 3000 + " zotfink", 1, "x", "x")]
    odd = [(None, 1, 0, ""), (901, None, 0, ""), (902, 7, 0, ""), (77777, 1, 0, "")]
    docs, given = frames(spark, rows + edge, labels + odd)
    model = T.train(docs, given)
    got = T.toxicity(docs, model).collect()
    assert len(got) == len(rows) + len(edge)
    truth = {i: y for i, y, *_ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    byid = {r.doc_id: r.predicted for r in got if r.doc_id != 0}
    held = [i for i in range(1, len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([byid[i] == truth[i] for i in held]) > 0.95
    assert (byid[900], byid[901], byid[902], byid[903], byid[None]) == (0, 0, 0, 1, 1)
    assert abs(model.score_of("x zotfink y") - next(iter(spark.createDataFrame([("x zotfink y",)], "t string").select(model.score("t")).first()))) < 1e-12
    left = T.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(repr(d) for d, s in zip(docs.collect(), docs.select(model.score("text")).collect(), strict=True) if s[0] < 0.5)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    rows, labels = corpus(80)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, q, t) for i, y, q, t in labels]
    a, b = (T.train(*frames(spark, rows, given)) for given in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_one_class_and_empty_tables(spark):
    rows, labels = corpus(20)
    docs, none = frames(spark, rows, [])
    assert {r.score for r in T.toxicity(docs, T.train(docs, none)).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 0, 0, "") for i in range(20)], LABELS)
    assert {r.predicted for r in T.toxicity(docs, T.train(docs, clean)).collect()} == {0}
    empty, given = frames(spark, [], labels)
    assert T.toxicity(empty, T.train(empty, given)).isEmpty()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_accuracy(spark):
    got = QUERIES["op2_toxicity"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.03
