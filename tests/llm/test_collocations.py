from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from clausemill.llm.collocations import collocations, dictionary, grams, parse, phrase_counts

DOCS = "doc_id long, text string, lang string, phrase string, F int, chunk string, _w int"


def pieces(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_counts(docs, longest=4):
    f = Counter()
    for _, text, lang in docs:
        for w in pieces(text):
            for n in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + n]) for i in range(len(w) - n + 1))
    return f


def brute(docs, least=30, longest=4, top=2000):
    f, rows, out = brute_counts(docs, longest), {}, []
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in often.items():
        lang, *w = p
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        over = [b for q, b in often.items() if q[0] == lang and len(q) > len(p) and any(list(q[i : i + len(w)]) == w for i in range(1, len(q)))]
        if not any(100 * b >= 80 * a for b in over):
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    for lang, got in rows.items():
        n = sum(a for p, a in f.items() if p[0] == lang and len(p) == 2)
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(got)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(17)
    words = ["of", "The", "é", "É", "日本", "x\x00y", "a_b", "\x85", "b\x1cc", *[f"w{i}" for i in range(9)]]
    ends = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", " \x0b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    shared = text(40) + "New York City is big and New York City"
    docs = [(i, text(rng.choice([0, 1, 2, 3, 50, 300])) + (shared if i % 3 else ""), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    docs += [(7, docs[4][1], "en"), (7, docs[4][1], "en"), (None, "The of the OF", "en"), (1, None, None), (2, "", "fr"), (3, " .,\n", "fr")]
    return docs + [(9, "ab cd " * 4000, "es"), (10, "one " * 3000, "es")]


def table(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], DOCS)


def counted(chunks, n, overlap=3):
    blob, full = b"".join(c + b"\xff" for c, _, _ in chunks), np.full(1 << 23, 255, np.uint8)
    found, counts = grams("en", blob, np.array([z for _, z, _ in chunks]), np.array([f for _, _, f in chunks]), n, overlap, full)
    return Counter(dict(zip(found, counts.tolist(), strict=True)))


def test_each_ngram_counts_once_however_a_text_is_parsed():
    rng = random.Random(2)
    for _ in range(120):
        texts = ["".join(rng.choice(["a", "b", "cc", "d e"]) + rng.choice([" ", "  ", ".", "\n", " \t"]) for _ in range(rng.randrange(90))) for _ in range(rng.randint(1, 4))]
        options = {"trigger": rng.choice([1, 2, 5, 10**9]), "most": rng.choice([1, 3, 7, 256]), "block": rng.choice([1, 20, 1 << 20])}
        parsed = Counter((c, z) for _, c, z in parse([t.encode() for t in texts], **options))
        if not parsed:
            assert not any(w for t in texts for w in pieces(t))
            continue
        f = brute_counts([(0, t, "en") for t in texts])
        for n in range(1, 5):
            want = {" ".join(p[1:]).encode(): a for p, a in f.items() if len(p) == n + 1}
            assert counted([(c, z, m) for (c, z), m in parsed.items()], n) == want, (texts, options, n)


def test_equal_passages_share_chunks(spark):
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))
    docs = [(i, f"own{i} begin{i} " + passage + f" end{i}", "en") for i in range(30)]
    rows = dictionary(table(spark, docs)).collect()
    assert sum(r.f for r in rows) > 20 * len(rows) and max(r.f for r in rows) == 30
    assert max(len(bytes(r.chunk).split()) for r in rows) <= 259


def test_equal_to_brute_force(spark):
    docs = corpus()
    frame = table(spark, docs).repartition(5)
    for least, longest, top in ((30, 4, 2000), (5, 4, 7), (2, 3, 2000)):
        got = collocations(frame, min_count=least, max_words=longest, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(docs, least, longest, top)


def test_counts_of_all_frequent_phrases(spark):
    docs = corpus()
    frequent, totals = phrase_counts(table(spark, docs), min_count=3)
    f = brute_counts(docs)
    assert {(r.lang, *r.phrase.split(" ")): r.f for r in frequent.collect()} == {p: a for p, a in f.items() if a >= 3}
    assert {r.lang: r.n for r in totals.collect()} == {lang: sum(a for p, a in f.items() if p[0] == lang and len(p) == 2) for lang in ("en", "de", "und", "es")}


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    got = spark.sql(f"select cast(2000000 * cast({big}L as decimal(19, 0)) div (cast({big}L as decimal(19, 0)) + {big + 1}L) as long) s").first().s
    assert got == 2000000 * big // (2 * big + 1)


def test_empty_tables(spark):
    assert collocations(table(spark, []).limit(0)).isEmpty()
    for text in (None, "", " ,", "one two"):
        assert collocations(table(spark, [(1, text, None)])).isEmpty()
    assert sorted(tuple(r) for r in collocations(table(spark, [(1, "a b. " * 40, None)])).collect()) == brute([(1, "a b. " * 40, None)])
