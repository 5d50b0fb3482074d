from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from clausemill.llm.chunk_dedup import chunks, exact_dedup

SCHEMA = "doc_id long, text string, KEEP_ID string, recipe int"
LONG = "the quick brown fox, jumps over it. " * 900


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        order = sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for i, r in enumerate(order):
            out.append((r[0], order[0][0], len(order), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = exact_dedup(docs, **more).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


ROWS = [
    (1, LONG), (2, LONG.replace(" ", "\n\t")), (3, LONG + " "), (4, LONG[:-9] + "x"), (5, "a b"), (6, "ab"), (7, "a\x0bb "),
    (8, None), (9, ""), (10, " \t"), (None, "ab"), (None, None), (5, "a b"), (11, "a b"), (12, "é😀" * 3000), (13, "é😀 " * 3000),
]


def test_equal_to_brute_force(spark):
    check(spark, ROWS)


def test_clashing_hashes_are_told_apart(spark):
    check(spark, ROWS, chunk_hash=lambda c: F.length(c).cast("long") % 3, min_chars=8, max_chars=64)
    check(spark, ROWS, chunk_hash=lambda c: F.length(c).cast("long") * 0, min_chars=2, max_chars=500)


def test_chunks_join_to_the_text_and_follow_content(spark):
    texts = [LONG, "prefix that shifts all. " + LONG, "z" * 9000, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(chunks(F.col("text")).alias("c"))
    parts = [r.c for r in frame.collect()]
    assert ["".join(p) for p in parts] == texts
    assert max(len(p) for c in parts for p in c) <= 4096
    assert len(set(parts[0]) & set(parts[1])) > 0


def test_empty_table(spark):
    check(spark, [])
