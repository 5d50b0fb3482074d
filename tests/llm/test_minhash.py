from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd

import corpus_pipeline
from clausemill.llm import minhash
from clausemill.llm.minhash import alike, drop_similar, entries_of, grid_links, near_prints, star_links
from clausemill.llm.simhash import FLIPS, RADIUS, SEGMENT_BITS, SEGMENTS, set_fingerprint
from tests.llm.test_simhash import roots

SCHEMA = "doc_id long, text string, fp string, root int, _k_id int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(n)]


def rows():
    """Copies with 0 to 8 of 300 words changed (similarity 1 to 0.76) and with the tail cut."""
    rng, out = random.Random(11), []
    for i in range(12):
        w = words(rng, 300)
        out += [(100 * i, " ".join(w)), (100 * i + 1, "\n".join(w).upper()), (100 * i + 1, "\n".join(w).upper())]
        for j in range(1, 9):
            v = list(w)
            for at in rng.sample(range(300), j):
                v[at] = "zz" + str(rng.random())
            out.append((100 * i + 1 + j, " ".join(v)))
        out += [(100 * i + 20, " ".join(w[:245])), (100 * i + 21, " ".join(w[:200]))]
    return out + [(9000, None), (9001, ""), (None, None), (None, "alone"), (None, "alone"), (9002, "few words"), (9003, "q " * 200_000)]


def want(data):
    sets = sorted({shingles(t) for _, t in data}, key=sorted)
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    root = roots(range(len(sets)), edges)
    at = {s: root[n] for n, s in enumerate(sets)}
    ids = {}
    for i, t in data:
        ids.setdefault(at[shingles(t)], []).append(i)
    return sorted((min((i for i in v if i is not None), default=None) for v in ids.values()), key=repr)


def test_one_of_each_group_of_similar_texts_stays(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA)
    for block_rows in (256, 3):
        left = drop_similar(docs, block_rows=block_rows)
        assert left.columns == docs.columns
        assert sorted((r.doc_id for r in left.collect()), key=repr) == want(data)


def test_the_stage_uses_five_words_and_similarity(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA)
    assert sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr) == want(data)


def chained():
    """Texts on a circle: neighbours are alike, most that share a band are not; and a crowd of near copies."""
    rng = random.Random(23)
    ring, crowd = words(rng, 1500), words(rng, 120)
    out = [(i, " ".join((ring + ring)[25 * i : 25 * i + 400])) for i in range(60)]
    for i in range(400):
        v = list(crowd)
        v[rng.randrange(120)] = f"x{i}"
        out.append((1000 + i, " ".join(v)))
    return out


def test_no_link_is_lost_where_the_smallest_node_settles_little(spark):
    data = chained()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(4)
    for block_rows in (256, 7):
        assert sorted(r.doc_id for r in drop_similar(docs, block_rows=block_rows).collect()) == want(data) == [0, 1000]


def test_only_pairs_of_a_band_are_compared(spark):
    sets = [np.arange(i, i + 50).astype(np.uint64) for i in range(0, 40, 4)]
    rows = [(n, s.tobytes(), len(s) * 8) for n, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, shingles binary, bytes long")
    pairs = [(0, n) for n in range(1, 10)]
    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8
    got = star_links(spark.createDataFrame(pairs, "head long, node long"), frame, block_rows=2).collect()
    assert sorted(tuple(r) for r in got) == [p for p in pairs if near(*p)]
    asked, members = [(1, 3), (1, 5), (2, 9)], [(1, n) for n in range(1, 7)] + [(2, 8)]
    entry = "entry long, node long"
    got = grid_links(spark.createDataFrame(asked, entry), spark.createDataFrame(members, entry), frame, block_rows=2).collect()
    assert {frozenset(r) for r in got} == {frozenset((a, b)) for e, a in asked for f, b in members if e == f and a != b and near(a, b)}


def test_alike_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(1, 200, 60)]
    near = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    assert alike(sets, None) == [(a, b) for a in range(60) for b in range(a + 1, 60) if near(sets[a], sets[b])]
    assert alike(sets[:20], sets[20:]) == [(a, b) for a in range(20) for b in range(40) if near(sets[a], sets[20 + b])]


def test_empty_table(spark):
    assert drop_similar(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_the_index_is_of_fingerprints_in_segments(spark):
    """A node stands under its segments and those with one uncertain bit turned; all bits are verified."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [base, np.r_[base[:270], rng.integers(0, 1 << 64, 30, dtype=np.uint64)], rng.integers(0, 1 << 64, 300, dtype=np.uint64)]
    prints = [set_fingerprint(s) for s in sets]
    plain = [[sum((int(p) >> b & 1) << b for b in range(SEGMENT_BITS)) for p in value] for value, _ in prints]
    rows = [(n, p.tolist(), w.tolist(), [7]) for n, (p, w) in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, print array<int>, weak array<tinyint>, short array<long>")
    got = {}
    for r in entries_of(nodes).collect():
        got.setdefault(r.node, []).append(r.entry)
    for n, (_, weak) in enumerate(prints):
        turns = [[0, *[1 << int(b) for b in weak[i * FLIPS : (i + 1) * FLIPS]]] for i in range(SEGMENTS)]
        assert sorted(got[n]) == sorted([7, *[i << SEGMENT_BITS | v ^ t for i, v in enumerate(plain[n]) for t in turns[i]]])
    assert len((set(got[0]) & set(got[1])) - {7}) > 0 and set(got[0]) & set(got[2]) == {7}
    differ = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(plain[a], plain[b], strict=True))
    assert differ(0, 1) <= RADIUS < differ(0, 2)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "head long, node long")
    assert [tuple(r) for r in near_prints(pairs, nodes).collect()] == [(0, 1)]
    assert [tuple(r) for r in near_prints(pairs, nodes, radius=differ(0, 1) - 1).collect()] == []


def test_fingerprints_follow_the_majority():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 64, 701, dtype=np.uint64)
    one = [set_fingerprint(hashes[i : i + 1])[0] for i in range(701)]
    bits = (np.array(one)[:, :, None] >> np.arange(SEGMENT_BITS)) & 1
    value, weak = set_fingerprint(hashes)
    assert ((2 * bits.sum(axis=0) > 701) @ (1 << np.arange(SEGMENT_BITS))).tolist() == value.tolist()
    lead = np.abs(2 * bits.sum(axis=0) - 701)
    assert all(sorted(lead[i])[:FLIPS] == lead[i][weak[i * FLIPS : (i + 1) * FLIPS]].tolist() for i in range(SEGMENTS))
    assert abs(bits.mean() - 0.5) < 0.01


def test_crowded_entries_and_short_texts(spark):
    rng = random.Random(31)
    short = [words(rng, n) for n in (5, 6, 7, 8, 9, 10, 12) for _ in range(6)]
    data = chained()[:60] + [(5000 + 2 * i, " ".join(w)) for i, w in enumerate(short)] + [(5001 + 2 * i, " ".join(w[:-1])) for i, w in enumerate(short)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(4)
    for crowded in (64, 1):
        assert sorted(r.doc_id for r in drop_similar(docs, crowded=crowded, block_rows=7).collect()) == want(data)


def test_pairs_of_many_entries_are_looked_up_once(spark, monkeypatch):
    """Near copies share most of their entries; which roots a pair has is asked per pair, not per entry."""
    from clausemill.llm import minhash

    written, saved = {}, minhash.saved
    monkeypatch.setattr(minhash, "saved", lambda frame, purpose: written.setdefault(purpose, saved(frame, purpose)) if purpose in ("entries",) else _kept(written, frame, purpose, saved))
    docs = spark.createDataFrame([(a, b) for a, b in rows()], "doc_id long, text string")
    drop_similar(docs).collect()
    pairs = written["entries"].select("head", "node").distinct().count()
    assert pairs * 3 < written["entries"].count()
    joins = [line for line in written["apart plan"].split("\n") if "Join LeftOuter" in line]
    below = written["apart plan"].split("Join LeftOuter")[-1]
    assert len(joins) == 2 and "Aggregate [head" in below


def _kept(written, frame, purpose, saved):
    written[f"{purpose} plan"] = frame._jdf.queryExecution().optimizedPlan().toString()
    return saved(frame, purpose)


def test_batches_are_taken_apart_in_pieces():
    frame = pd.DataFrame({"text": [f"t{i}" for i in range(2 * minhash._TEXTS_AT_ONCE + 1)]})
    pieces = list(minhash._pieces(iter([frame, frame.iloc[:0], frame.iloc[:1]])))
    assert [len(p) for p in pieces] == [minhash._TEXTS_AT_ONCE] * 2 + [1, 1]
    assert pd.concat(pieces)["text"].tolist() == [*frame["text"], "t0"]
