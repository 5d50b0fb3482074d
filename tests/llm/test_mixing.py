from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from clausemill.llm.mixing import mix, mixed_documents, source_targets, taken

SCHEMA = "doc_id long, text string, source string, Size string, _row int, n_chars long"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0) for r in rows], SCHEMA)


ROWS = [(i, " ".join(f"w{i}_{j}" for j in range(7 + 31 * (i % 13))), f"s{i % 4}") for i in range(120)] + [
    (200, None, "s0"), (201, "", "s1"), (202, "\n \t", None), (203, "a  b\nc", None), (None, "one two", "s2"),
    (204, "x " * 30_000, "s3"), (None, "one two", "s2"), (3, "again", "s2"), (205, None, "empty"),
]


def targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """By rounds: share out, stop those above their limit, share their excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1e-9, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {**fixed, **{s: level * w[s] for s in free}}
        fixed.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 30, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {"a": 0, None: 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(targets(sizes))


def test_taken_words_come_near_the_targets(spark):
    docs = table(spark, ROWS)
    run = lambda: taken(mix(docs, block_words=16, shard_slots=500)).select("doc.doc_id", "size", "source_size", "target", "taken")
    rows = run().collect()
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in rows) == sorted((i is None, i, words(t)) for i, t, _ in ROWS)
    source_of = {}
    for i, _, s in ROWS:
        source_of.setdefault(i, s)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    sums = {}
    for r in rows:
        if r.doc_id not in (3, None):
            sums.setdefault((source_of[r.doc_id], r.target, r.source_size), []).append(r.taken)
    for (_, target, _), got in sums.items():
        assert sum(got) == pytest.approx(target, rel=0.06, abs=48)
    assert sorted(map(repr, run().collect())) == sorted(map(repr, rows))


def test_mixed_text_is_what_was_taken(spark):
    docs = table(spark, ROWS)
    options = {"block_words": 64, "shard_slots": 1000}
    out = mixed_documents(docs, **options)
    assert out.columns == docs.columns
    assert out.where("n_chars <> length(text)").isEmpty()
    pieces, by_doc = {}, {}
    for r in out.collect():
        pieces.setdefault((r.doc_id, r.source), []).append(r.text)
    for r in taken(mix(docs, **options)).select("doc.doc_id", "taken").collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.taken
    for i, t, s in ROWS:
        for piece in pieces.get((i, s), []):
            assert piece in t or i in (3, None)
    got = {}
    for (i, _), p in pieces.items():
        got[i] = got.get(i, 0) + sum(map(words, p))
    assert {i: n for i, n in by_doc.items() if n} == got


def test_every_block_once_per_turn(spark):
    plan = mix(table(spark, ROWS), block_words=16, shard_slots=300)
    full = plan.slots.groupBy("source_no", "turn").agg(
        F.count("*").alias("n"), F.countDistinct("block").alias("d"), F.min("block").alias("lo"),
        F.max("block").alias("hi"), F.first("blocks").alias("blocks"),
    )
    rows = full.collect()
    assert all(r.n == r.d and r.lo >= 0 and r.hi < r.blocks and r.turn in (0, 1) for r in rows)
    assert any(r.n == r.blocks for r in rows)


def test_empty_table(spark):
    assert taken(mix(table(spark, []))).isEmpty()
    assert mixed_documents(table(spark, [])).isEmpty()
    assert [r.taken for r in taken(mix(table(spark, [(1, None, None)]))).collect()] == [0]


def test_texts_are_not_written_beside_the_plan(spark, monkeypatch):
    """The plan of a mix carries no texts; they join it once, copies of a row each at its own place."""
    from clausemill.llm import mixing

    written, saved = [], mixing.saved
    monkeypatch.setattr(mixing, "saved", lambda frame, purpose: written.append(frame) or saved(frame, purpose))
    rows = [(1, "a b c " * 50, None, "x", 1, 0)] * 3 + [(1, "a b c " * 50, "", "x", 1, 0), (None, "d " * 90, "s", "x", 1, 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed_documents(docs, block_words=16, shard_slots=50)
    assert not any("text:string" in f.schema.simpleString() for f in written)
    got = {(r.doc_id, r.source): r.n for r in out.groupBy("doc_id", "source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    plan = taken(mix(docs, keep=("doc_id", "source"), block_words=16, shard_slots=50))
    want = {(r.doc_id, r.source): r.n for r in plan.groupBy("doc.doc_id", "doc.source").agg(F.sum("taken").alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n} and len(got) == 3
