"""The pipeline on the small tables, stage by stage, against plain Python."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm.common import read
from clausemill.llm.toxicity import train
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import targets
from tests.llm.test_minhash import want as similar_want

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage, and what the last one gives, as the pipeline writes them."""
    docs, out = read(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_stages_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_shards"]
    columns = stages[0].columns
    assert all(s.columns == columns for s in stages[:5])


def test_toxic_documents_go(spark, stages):
    model = train(stages[0], read(spark, FOLDER, "labels"))
    assert pairs(stages[1]) == [p for p in pairs(stages[0]) if model.score_of(p[1]) < 0.5]


def test_one_near_duplicate_stays(stages):
    """Of each component of texts whose five-word shingles are alike by 0.8, by comparing all pairs, the smallest id stays."""
    rows = [(int(i), t) for i, t in pairs(stages[1])]
    assert [i for i, _ in pairs(stages[2])] == similar_want(rows)
    assert len(similar_want(rows)) < len(rows)


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in read(spark, FOLDER, "benchmark").collect()]
    held = {(i, t) for i, t, got in contaminated([p for p in pairs(stages[2]) if len(p[1] or "") < 1500], items) if got}
    left = set(pairs(stages[3]))
    assert left <= set(pairs(stages[2])) and not held & left
    gone = set(pairs(stages[2])) - left
    assert {p for p in gone if len(p[1] or "") < 1500} == held


def test_mix_comes_near_the_targets(stages):
    sizes, got = {}, {}
    texts = {}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
        texts[r.doc_id] = r.text
    for r in stages[4].collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    for source, target in targets(sizes).items():
        assert got.get(source, 0) == pytest.approx(target, rel=0.1, abs=2 * 256)


def test_shards_hold_every_row(spark, stages):
    index = stages[5]
    spans = index.select(F.explode(F.arrays_zip("doc_ids", "sizes")).alias("s")).select("s.doc_ids", "s.sizes")
    assert {r.doc_ids for r in spans.select("doc_ids").distinct().collect()} == {r.doc_id for r in stages[4].select("doc_id").distinct().collect()}
    assert sorted(r.slot for r in index.select("slot").collect()) == list(range(index.count()))


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.isEmpty()


def test_odd_rows_pass_through(spark, stages):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Doc string, _row int, key string"
    rows = [(None, None, None, None, None, None, None, None), (1, "", None, "s", 0, "x", 1, "k"), (1, "", None, "s", 0, "x", 1, "k"),
            (None, "some words here", "en", None, 15, "x", 1, "k"), (2, "long words " * 90_000, "en", "s", 0, "x", 1, "k")]
    docs = spark.createDataFrame(rows, schema)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        if n < 3:
            assert len(docs.columns) == 8
    assert docs.count() > 0
