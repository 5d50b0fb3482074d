from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from clausemill.llm import simhash
from clausemill.llm.components import components
from clausemill.llm.simhash import drop_near_duplicates, fingerprint_of, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string, Component_id int, _k_id int"


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, " \n", "One", "one two", "a b c", "É ß 😀 ÀB cd", "x\xa0y z\x0bw"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n)) for n in (3, 7, 50, 400)]
    want = [brute_print(t) for t in texts]
    assert [fingerprint_of(t) for t in texts] == want
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert [fingerprint_of(t) for t in texts] == want


def test_links_connect_just_what_is_near(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))))
        for i in range(30):
            prints.add(b ^ 1 << i)
    prints = sorted(signed(p) for p in prints)
    edges = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = roots(prints, edges)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for crowded in (10_000, 20, 0):
        got = [(r.a, r.b) for r in links(frame, crowded=crowded).collect()]
        assert set(got) <= set(edges)
        assert roots(prints, got) == want


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(50)]
    rest = [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    edges = chain + star + [(b, a) for a, b in rest]
    rng.shuffle(edges)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(n)]


def rows():
    rng, out = random.Random(11), []
    for i in range(12):
        w = words(rng, 300)
        out += [(100 * i, " ".join(w)), (100 * i + 1, "\n".join(w).upper()), (100 * i + 1, "\n".join(w).upper())]
        for j in range(4):
            v = list(w)
            v[rng.randrange(300)] = "zz"
            out.append((100 * i + 2 + j, " ".join(v)))
    return out + [(9000, None), (9001, ""), (None, None), (None, "alone"), (None, "alone"), (9002, "few words"), (9003, "q " * 200_000)]


def test_components_of_documents_and_what_stays(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA)
    prints = {t: brute_print(t) for _, t in data}
    names = sorted(set(prints.values()))
    root = roots(names, [(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 2])
    ids = {}
    for i, t in data:
        ids.setdefault(root[prints[t]], []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    want = sorted(((i, f"{prints[t]:016x}", least[root[prints[t]]]) for i, t in data), key=repr)
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=repr) == want
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        ((least[r], next(t for i, t in data if i == least[r] and root[prints[t]] == r)) for r in ids), key=repr
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).isEmpty() and drop_near_duplicates(docs).isEmpty()
    assert near_duplicates(spark.createDataFrame([(1, None, "x", 1, 1)], SCHEMA)).select(F.max("component_id")).first()[0] == 1


def test_exploded_entries_are_not_broadcast(spark):
    """A few fingerprints' entries look small to Spark, however many rows they explode to."""
    plan = links(spark.createDataFrame([(0,), (1,), (6,)], "fp long"))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "entry" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
