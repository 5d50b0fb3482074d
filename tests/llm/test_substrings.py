from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from clausemill.llm import substrings
from clausemill.llm.substrings import Text, longest_repeats, remove_repeats, window_hashes

SCHEMA = "doc_id long, text string, doc string, Own int, one_50 int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    order = lambda i: (i is None, i or 0)
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order(i):
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(window):
    rng = random.Random(window)
    new = lambda n: [rng.choice("abcdéfgh") * rng.randint(1, 3) for _ in range(n)]
    passage, edge = new(3 * window), new(window)
    out = []
    for i in range(30):
        w = new(rng.randint(0, 4 * window))
        if i % 3 == 0:
            a = rng.randrange(window)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(window - 1, 2 * window)]
        if i % 4 == 0:
            w = edge + w
        if i % 5 == 0:
            w = w + edge[:-1]
        out.append((100 - i, rng.choice([" ", "\n", " \t "]).join(w)))
    out += [(7, out[0][1]), (7, out[0][1]), (7, " ".join(passage)), (None, " ".join(passage)), (None, " ".join(edge)), (None, None)]
    return out + [(200, None), (201, ""), (202, "same " * 40 * window), (203, "same " * 3 * window), (204, " ".join(passage) * 3)]


@pytest.mark.parametrize("window", [2, 6, 50])
def test_equal_to_brute_force(spark, window):
    data = rows(window)
    docs = spark.createDataFrame([(*r, "x", 1, 1) for r in data], SCHEMA).repartition(7)
    got = remove_repeats(docs, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(data, window)


def test_hashes_depend_on_words_alone(monkeypatch):
    text = ("the  cat\nsat é on the cat sat é on " + "w" * 8 + " " + "w" * 9 + " " + "w" * 300 + "\t") * 40
    want = Text(text).words.tolist()
    assert len(set(want[:5])) == 5 and want[:5] == want[5:10]
    assert Text("x " + text).words.tolist()[1:] == want and len(set(want)) == 8
    run = [substrings._picked(np.array(want, np.uint64), 7).tolist()]
    monkeypatch.setattr(substrings, "_PLACE_BITS", 10)
    assert [substrings._picked(np.array(want, np.uint64), 7).tolist()] == run
    assert run[0] == [min(range(i, i + 7), key=lambda k: (want[k] >> 24, k)) for i in range(len(want) - 6)]
    words = np.array(want, np.uint64)
    for size in (1, 2, 3, 25, 50):
        got = window_hashes(words, size)
        assert len(got) == len(words) - size + 1
        assert all(got[i] == window_hashes(words[i : i + size], size)[0] for i in range(0, len(got), 17))
    assert len(window_hashes(words[:3], 4)) == 0


def test_longest_repeats(spark):
    rng = random.Random(1)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common = new(100)
    data = [(1, new(9) + common), (2, common[:45] + new(30)), (3, new(5) + common[50:71]), (4, new(300)), (5, common[:5]), (6, None)]
    docs = spark.createDataFrame([(i, " ".join(w) if w else None, "x", 1, 1) for i, w in data], SCHEMA)
    got = {r.doc_id: r.longest for r in longest_repeats(docs, window=10).collect()}
    assert got == {1: 40, 2: 40, 3: 20, 4: 0, 5: 0, 6: 0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(docs).isEmpty() and longest_repeats(docs).isEmpty()
    with pytest.raises(ValueError):
        remove_repeats(docs, window=7)
