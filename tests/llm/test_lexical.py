from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from clausemill.llm import lexical
from clausemill.llm.lexical import Postings, best_of, ranked, terms_of

DOCS = "doc_id long, text string, rank int, _doc string, Score double"
ITEMS = "item_id long, text string, doc_id int, n int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df, out = Counter(t for _, c, _ in held for t in c), []
    for item, text in set(items):
        asked, scores = plain_terms(text), []
        for i, c, n in held:
            m, score = 100 - 75 + (75 * n * n_docs) // total, 0
            for t in asked:
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(150)] + ["É", "é", "ß9", "日本", "A1", "the"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ",", "\n", "_", "–", "\x00"]) for _ in range(n)) + "the"
    docs = [(i, text(rng.choice([1, 3, 30, 200]))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(7, "the w1"), (7, "the w1"), (None, docs[2][1]), (None, None), (900, ""), (901, "!? ,")]
    docs += [(902, "w5 " * 60_000)]
    items = [(i, text(rng.choice([2, 20, 90]))) for i in range(14)] + [(20, "zzz"), (21, None), (22, ""), (23, "the"), (23, "the"), (23, "w1 w1 W1"), (None, "w2")]
    return docs, items


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    said = "Ärger_x2 ÉA\x7fb–c\x80d\n"
    assert [t.decode() for t in terms_of(said)] == plain_terms(said) == ["Ärger", "x2", "Éa", "b–c\x80d"]
    assert terms_of(None) == terms_of("") == terms_of("., ;") == []


def test_equal_to_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, 1, "x", 0.5) for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)
    want = brute(docs, items)
    assert rows(ranked(frame, asked)) == want
    assert rows(ranked(frame, asked, block_chars=200)) == want
    assert rows(ranked(frame, asked, k=3)) == brute(docs, items, 3)


def test_masks_are_left_out_only_when_safe(monkeypatch):
    """Blocks of many masks: the same best documents as scoring all, with fewer documents scored."""
    monkeypatch.setattr(lexical, "FIRST_MASKS", 4)
    rng = np.random.default_rng(8)
    n_terms, scored, n = 80, 0, 0
    for _ in range(20):
        sizes = rng.integers(1, 30, 400)
        terms = np.concatenate([np.sort(rng.choice(n_terms, s, replace=False)) for s in sizes]).astype(np.int32)
        part = Postings(rng.permutation(400), sizes * 3, terms, rng.integers(1, 4, len(terms)).astype(np.int32), sizes, n_terms, (400, int(sizes.sum() * 3)))
        ids = rng.choice(n_terms, rng.integers(1, 75), replace=False)
        worth = rng.integers(1, 9, len(ids)) ** 4
        value = np.zeros(n_terms, np.int64)
        value[ids] = worth
        top, seen = best_of(part, ids, worth, value, 10, (np.empty(0, np.int64), np.empty(0, np.int64)))
        every = part.scores(np.arange(400), value)
        order = np.lexsort((part.docs, -every))[:10]
        order = order[every[order] > 0]
        assert top[0].tolist() == every[order].tolist() and top[1].tolist() == part.docs[order].tolist()
        scored, n = scored + seen, n + 400
    assert scored < n / 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x", 0.5)], DOCS)
    items = spark.createDataFrame([(1, "a", 1, 2)], ITEMS)
    assert rows(ranked(docs, items)) == brute([(1, "a b")], [(1, "a")])
    assert ranked(docs.limit(0), items).isEmpty() and ranked(docs, items.limit(0)).isEmpty()
    assert ranked(docs, spark.createDataFrame([(1, None, 1, 2), (2, "?", 1, 2)], ITEMS)).isEmpty()
