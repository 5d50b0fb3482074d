from __future__ import annotations

import random

from clausemill.llm.decontaminate import Searcher, contamination, drop_contaminated, masks_of, nearest, normalised, pieces

DOCS = "doc_id long, text string, Matches string, doc string, item_id int"
ITEMS = "item_id long, text string, matches int"


def distance(item, text):
    """The smallest edit distance from ``item`` to a part of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcde")]
    return "".join(out)


def test_myers_equals_the_table():
    rng = random.Random(9)
    for _ in range(300):
        item = "".join(rng.choice("abc d") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc d") for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.5:
            text = text[:40] + edited(rng, item, rng.randint(0, 6)) + text[40:]
        assert nearest(masks_of(item), len(item), text)[0] == distance(item, text)


def test_pieces_make_up_the_item():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij"
    assert [len(p) for _, p in pieces("abcdefghij", 3)] == [2, 3, 2, 3]


def corpus():
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(n))
    items = [(i, text(rng.randint(4, 30))) for i in range(12)]
    docs = [(i, text(60)) for i in range(20)]
    for i, (_, item) in enumerate(items * 4):
        docs.append((100 + i, text(20) + " " + edited(rng, item, rng.randint(0, len(item) // 6)) + "\n" + text(9)))
    docs += [(500, items[0][1].upper().replace(" ", " \n\t")), (501, None), (502, ""), (None, items[1][1]), (500, "clean"), (503, (items[2][1] + " ") * 900)]
    return docs, items + [(90, None), (91, " "), (None, "q" * 48), (3, "w" * 33), (3, items[3][1])]


def brute(docs, items):
    out = []
    for i, t in docs:
        low, got = normalised(t)[:4000], []
        for k, item in {(k, normalised(x)) for k, x in items if normalised(x)}:
            d = distance(item, low)
            if d <= len(item) // 16:
                got.append((k, d))
        out.append((i, t, sorted(got, key=repr)))
    return sorted(out, key=repr)


def test_equal_to_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    frame, bench = spark.createDataFrame([(*d, "x", "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    for options in ({}, {"block_chars": 60}):
        got = contamination(frame, bench, **options).collect()
        assert sorted((r.doc_id, sorted(zip(r.item_ids, r.distances, strict=True), key=repr)) for r in got if r.doc_id is not None) == sorted(
            (i, g) for i, _, g in want if i is not None
        )
        assert all(r.contaminated == bool(r.item_ids) for r in got) and len(got) == len(docs)
        left = drop_contaminated(frame, bench, **options)
        assert left.columns == frame.columns
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(((i, t) for i, t, g in want if not g), key=repr)


def test_a_very_long_text_is_searched_to_its_end():
    item = normalised("The quick brown fox jumps over the lazy dog and runs away from it")
    long = "lorem ipsum dolor " * 200_000
    search = Searcher({7: item}).search
    assert search(long) == [] and [m[:2] for m in search(long + item.replace("lazy", "lacy"))] == [(7, 1)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", "x", "x", 1)], DOCS), spark.createDataFrame([], ITEMS)
    assert [tuple(r) for r in contamination(docs, items).collect()] == [(1, False, [], [])]
    some = spark.createDataFrame([(1, "some words", 1)], ITEMS)
    assert contamination(docs.limit(0), some).isEmpty() and drop_contaminated(docs.limit(0), some).isEmpty()
