from __future__ import annotations

import os

import numpy as np
import pytest

from clausemill.llm import token_shards as S

SCHEMA = "doc_id long, text string, slot int, Tokens string, part int"


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.public()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    got = S.permuted(np.arange(n), n, 7)
    assert sorted(got) == list(range(n))
    assert n < 64 or (got != np.arange(n)).mean() > 0.9 and (S.permuted(np.arange(n), n, 8) != got).any()
    assert [int(S.permuted(np.array([i]), n, 7)[0]) for i in range(min(n, 50))] == got[:50].tolist()


def test_long_texts_are_tokenised_as_a_whole(vocabulary, monkeypatch):
    text = "Ab  cd\n\n ef, gh's 12 é😀\tzz " * 30 + "x" * 100
    want = [*vocabulary.encoding().encode_ordinary(text), vocabulary.end]
    for block in (1 << 20, 1, 40):
        monkeypatch.setattr(S, "_BLOCK", block)
        assert np.concatenate(list(S.encoded(text, vocabulary))).tolist() == want
    assert [x.tolist() for x in S.encoded(None, vocabulary)] == [[vocabulary.end]]


ROWS = [(i, f"Document {i} says é, and 'more' " * (i % 17 if i != 5 else 0)) for i in range(150)] + [
    (200, None), (201, ""), (None, "no id"), (5, "again"), (5, "again"), (202, "long text 1 2 3\n" * 5000), (203, "\x00\n\r\x1a 😀"),
]


def test_round_trip(spark, vocabulary):
    docs = spark.createDataFrame([(*r, 1, "x", 1) for r in ROWS], SCHEMA).repartition(3)
    shards = S.write_shards(docs, vocabulary, length=64, shard_sequences=100, block_sequences=8)
    index = {r.slot: r for r in shards.index.collect()}
    read = {r.slot: np.frombuffer(r.tokens, "<u2") for r in S.read_shards(spark, shards).collect()}
    assert sorted(index) == sorted(read) == list(range(shards.total))
    sizes = sorted(os.path.getsize(f"{shards.path}/{f}") for f in os.listdir(shards.path) if f.startswith("part-"))
    assert len(sizes) == shards.count and sizes[1:] == [100 * shards.stride] * (shards.count - 1)
    found, pieces = {}, []
    for slot, r in index.items():
        assert (r.shard, r.byte_offset) == (slot // 100, slot % 100 * shards.stride) and len(read[slot]) == 64
        assert r.n_tokens == sum(r.sizes) and (read[slot][r.n_tokens :] == vocabulary.end).all()
        for d, at, n, origin in zip(r.doc_ids, r.starts, r.sizes, r.origins, strict=True):
            pieces.append((d, origin, read[slot][at : at + n].tolist()))
    for d, origin, tokens in pieces:
        found.setdefault(d, {}).setdefault(origin, []).append(tokens)
    decode = vocabulary.encoding().decode
    for d, text in ROWS:
        if d == 5:
            continue
        tokens = [t for origin in sorted(found[d]) for t in found[d][origin][0]]
        assert tokens[-1] == vocabulary.end and decode(tokens[:-1]) == (text or "")
    assert sorted(found[5]) == [0] and sorted(decode(x[:-1]) for x in found[5][0]) == sorted(t for d, t in ROWS if d == 5)
    resumed = {r.slot: r.tokens for r in S.read_shards(spark, shards, first_slot=130).collect()}
    assert sorted(resumed) == list(range(130, shards.total)) and all(resumed[s] == read[s].tobytes() for s in resumed)
    order = [index[s].doc_ids[0] or -1 for s in range(shards.total)]
    assert order != sorted(order)


def test_spark_reads_records_of_the_stride(spark, vocabulary):
    docs = spark.createDataFrame([(*r, 1, "x", 1) for r in ROWS[:40]], SCHEMA)
    shards = S.write_shards(docs, vocabulary, length=32, shard_sequences=7, block_sequences=3)
    records = spark.sparkContext.binaryRecords(shards.path, shards.stride)
    assert records.count() == shards.total


def test_empty_table(spark, vocabulary):
    shards = S.write_shards(spark.createDataFrame([], SCHEMA), vocabulary)
    assert shards.count == shards.total == 0 and shards.index.isEmpty()
