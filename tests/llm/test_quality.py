from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest

from clausemill.llm import quality as Q
from clausemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, y int, Stats string"
LABELS = "doc_id long, quality int, toxic int, stats int"


def corpus(n=300):
    rng, rows, labels = random.Random(4), [], []
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "sel", "kun"]) for _ in range(rng.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        good = i % 3 != 0
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else words[:5] * 30
        rows.append((i, " ".join(words) + ".", 1, "x"))
        labels.append((i, int(good), 0, 1))
    return rows, labels


def test_statistics():
    names = Q.NAMES
    got = dict(zip(names, Q.statistics_of("Ab 12 cd!\nAb 12 cd!\n\nx é%"), strict=True))
    assert got["log_lines"] == pytest.approx(np.log1p(3)) and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["log_words"] == pytest.approx(np.log1p(8)) and got["log_chars"] == pytest.approx(np.log1p(25))
    assert got["capitals"] == pytest.approx(2 / 25) and got["shouts"] == pytest.approx(2 / 8) and got["symbols"] == pytest.approx(1 / 8)
    assert got["repeated_triples"] == pytest.approx(1 / 6) and got["letterless_words"] == 0
    assert got["capital_words"] == pytest.approx(2 / 8) and got["stopped_words"] == pytest.approx(2 / 8)
    assert Q.statistics_of(None) == Q.statistics_of(" \n") == [0.0] * len(names)
    long = Q.statistics_of("word and word. " * 200_000)
    assert np.isfinite(long).all() and len(long) == len(names)


def test_isotonic_is_the_nearest_rising_curve():
    rng = np.random.default_rng(1)
    x, y, w = np.arange(40.0), rng.random(40), rng.integers(1, 9, 40).astype(float)
    at, level = Q.isotonic(x, y, w)
    got = np.interp(x, at, level)
    # The value of the nearest rising curve: the largest over starts of the smallest weighted mean over ends.
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert got == pytest.approx(want)


def test_learns_and_handles_odd_rows(spark):
    rows, labels = corpus()
    edge = [(900, None, 1, "x"), (901, "", 1, "x"), (None, rows[1][1], 1, "x"), (1, rows[1][1], 1, "x"), (902, rows[1][1] * 2000, 1, "x")]
    odd = [(None, 1, 0, 0), (901, None, 0, 0), (902, 5, 0, 0), (88888, 0, 0, 0)]
    docs, given = spark.createDataFrame(rows + edge, DOCS), spark.createDataFrame(labels + odd, LABELS)
    got = Q.quality(docs, given).collect()
    assert len(got) == len(rows) + len(edge)
    truth = {i: y for i, y, *_ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == y for i, y in truth.items() if by[i].held_out]) > 0.95
    assert by[900].score == by[901].score and by[None].score == by[1].score


def test_one_class_and_empty_tables(spark):
    rows, _ = corpus(12)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    assert {r.score for r in Q.quality(docs, none).collect()} == {0.5}
    assert Q.quality(spark.createDataFrame([], DOCS), none).isEmpty()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_accuracy(spark):
    got = QUERIES["op4_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
