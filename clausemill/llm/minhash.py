"""Near-duplicates by the Jaccard similarity of word shingles: SimHash with multi-index hashing finds who may be alike,
all bits and then the shingles themselves decide. (The module keeps the name of an earlier method.)"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.llm.common import row_key, saved
from clausemill.llm.components import components
from clausemill.llm.simhash import FLIPS, RADIUS, SEGMENT_BITS, SEGMENTS, _blocks, set_fingerprint

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Sets of so few shingles are also named without any one of theirs: alike by 0.8, two of them share such a name.
FEW = 9
#: A block of a cell holds about so many texts and bytes.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 23
_COLUMNS = 4096
_NONE = np.zeros(0, np.int8)
#: A node has some 170 entries; they are made in tasks of about so many nodes.
_NODES_A_TASK = 4096
#: Of a batch of rows, so many texts at a time are taken apart.
_TEXTS_AT_ONCE = 256
#: An entry with more open nodes is compared in a grid, not in pairs.
CROWDED = 16


def shingles_of(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles in order, A-Z lowered; a text of fewer words is one shingle."""
    parts, carry, digest = [], [], xxhash.xxh64_intdigest
    for block in _blocks((text or "").encode().lower()):
        run = carry + block.split()
        if len(run) < words:
            carry = run
            continue
        joined = b" ".join(run)
        ends = np.cumsum([len(w) + 1 for w in run]).tolist()
        starts = [0, *ends[: len(run) - words]]
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]
        parts.append(np.array(hashes, dtype=np.uint64))
        carry = run[len(run) - words + 1 :]
    if not parts and carry:
        parts.append(np.array([digest(b" ".join(carry), 42)], dtype=np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def short_names(shingles: np.ndarray) -> np.ndarray:
    """The hashes of a set of at most ``FEW`` shingles and of all that lack one of them; none for other sets."""
    if not 0 < len(shingles) <= FEW:
        return np.zeros(0, np.int64)
    sets = [shingles, *[np.delete(shingles, i) for i in range(len(shingles)) if len(shingles) > 1]]
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 9) for s in sets], dtype=np.uint64).view(np.int64)


def alike(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Positions in ``left`` and ``right`` (``left`` itself if None) whose sets' Jaccard similarity is at least
    ``similarity``; counted on all shingles, by products of bounded pieces."""
    sets = left if right is None else left + right
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, split = len(left), 0 if right is None else len(left)
    common = np.zeros((n, len(sets) - split), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        piece = np.zeros((len(sets), _COLUMNS), np.float32)
        piece[owner[a:b], column[a:b] - first] = 1
        common += piece[:n] @ piece[split:].T
    union = sizes[:n, None] + sizes[None, split:] - common
    near = common >= similarity * union - 1e-9
    if right is None:
        near = np.triu(near, 1)
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]


def _forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """As many of ``pairs`` as connect what all of them connect."""
    parent, out = list(range(n)), []
    for a, b in pairs:
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            out.append((a, b))
    return out


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``frames`` in pieces of bounded rows: the shingles of a whole batch are never held at once."""
    for frame in frames:
        for at in range(0, len(frame), _TEXTS_AT_ONCE):
            yield frame.iloc[at : at + _TEXTS_AT_ONCE].copy()


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column]


def _cut(frame: DataFrame, key: str, block_rows: int) -> DataFrame:
    """``key, n``: how many blocks of bounded rows and bytes the sets (``bytes``) of each key make."""
    by_rows, by_bytes = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))
    return frame.groupBy(key).agg(F.greatest(by_rows, by_bytes, F.lit(1)).cast("int").alias("n"))


def _block(n: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def star_links(pairs: DataFrame, sets: DataFrame, *, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``pairs`` (``head, node``, distinct) whose ``sets`` (``node, shingles, bytes``) are alike.

    The nodes of a head are cut into blocks, each of which the head's own set
    joins once; so a head of any number of nodes is many bounded cells.
    """
    size = _cut(pairs.join(sets.select("node", "bytes"), "node"), "head", block_rows)
    own = size.join(sets.withColumnRenamed("node", "head"), "head").select("head", _each("n").alias("block"), F.lit(True).alias("first"), F.col("head").alias("node"), "shingles")
    rest = pairs.join(size, "head").select("head", _block("n").alias("block"), F.lit(False).alias("first"), "node")
    cells = own.unionByName(rest.join(sets.select("node", "shingles"), "node").select(own.columns))

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(frame.loc[frame["first"], "shingles"].iloc[0], np.uint64)
        others = frame[~frame["first"]]
        common = np.array([np.intersect1d(head, s, assume_unique=True).size for s in _sets(others["shingles"])])
        union = len(head) + others["shingles"].map(len).to_numpy() // 8 - common
        return others.loc[common >= similarity * union - 1e-9, ["head", "node"]]

    return cells.groupBy("head", "block").applyInPandas(cell, "head long, node long")


def grid_links(asked: DataFrame, members: DataFrame, sets: DataFrame, *, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect what is alike between ``asked`` and ``members`` (``entry, node``) of the same entry.

    All are compared with all, in a grid of blocks; a cell is bounded by rows
    and bytes, and emits what connects its texts, never its pairs.
    """
    weights = sets.select("node", "bytes")
    left_n, right_n = (_cut(side.join(weights, "node"), "entry", block_rows) for side in (asked, members))
    sizes = left_n.withColumnRenamed("n", "n_left").join(right_n.withColumnRenamed("n", "n_right"), "entry")
    left = asked.join(sizes, "entry").select("entry", _block("n_left").alias("i"), _each("n_right").alias("j"), F.lit(True).alias("asks"), "node")
    right = members.join(sizes, "entry").select("entry", _each("n_left").alias("i"), _block("n_right").alias("j"), F.lit(False).alias("asks"), "node")
    cells = left.unionByName(right).join(sets.select("node", "shingles"), "node")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["asks"]], frame[~frame["asks"]]
        pairs = alike(_sets(a["shingles"]), _sets(b["shingles"]), similarity) if len(a) and len(b) else []
        nodes = np.r_[a["node"].to_numpy(), b["node"].to_numpy()]
        kept = _forest([(x, y + len(a)) for x, y in pairs], len(nodes))
        return pd.DataFrame({"a": nodes[[x for x, _ in kept]], "b": nodes[[y for _, y in kept]]}, dtype="int64")

    return cells.groupBy("entry", "i", "j").applyInPandas(cell, "a long, b long").where("a <> b")


def entries_of(nodes: DataFrame) -> DataFrame:
    """``node, entry``: where each node stands in the tables of the index, one table per segment of its fingerprint.

    It stands under the segment's value and under the values with one of its
    ``FLIPS`` least certain bits turned; few shingles bring names of their own.
    """
    places = F.transform(
        "print",
        lambda value, i: F.transform(
            F.concat(F.array(F.lit(0)), F.transform(F.slice("weak", i * FLIPS + 1, F.lit(FLIPS)), lambda at: F.call_function("shiftleft", F.lit(1), at.cast("int")))),
            lambda turned: F.shiftleft(i.cast("long"), SEGMENT_BITS).bitwiseOR(value.bitwiseXOR(turned).cast("long")),
        ),
    )
    return nodes.select("node", F.explode(F.concat(F.flatten(places), "short")).alias("entry"))


def near_prints(pairs: DataFrame, nodes: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """The rows of ``pairs`` (``head, node``) whose fingerprints differ in at most ``radius`` of all bits."""
    own = nodes.select("node", "print")
    both = pairs.join(own, "node").join(own.select(F.col("node").alias("head"), F.col("print").alias("other")), "head")
    differ = [F.bit_count(F.get("print", F.lit(i)).bitwiseXOR(F.get("other", F.lit(i)))) for i in range(SEGMENTS)]
    return both.where(sum(differ[1:], differ[0]) <= radius).select("head", "node")


def similar_links(
    rows: DataFrame, texts: DataFrame, *, similarity: float, words: int, block_rows: int, crowded: int = CROWDED
) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes of ``rows`` (row key, ``node, print, weak, short``) that share an entry
    of the index and are alike.

    Every node is first compared with the smallest it shares an entry with,
    which ties a crowd of near copies together by one edge each. What shares an
    entry and is not yet tied is then compared: with the smallest node of the
    entry, and what is not alike to it with every other one, so that no pair
    that shares an entry is lost - in pairs, or where an entry holds more than
    ``crowded`` others in a grid of blocks. Pairs are verified on all bits of
    their fingerprints, then on all shingles; later edges run between the roots
    of what is tied.
    """
    names = ["_k_id", "_k_null", "_k_text"]
    held = [F.first(c).alias(c) for c in ("print", "weak", "short")]
    parts = rows.count() // _NODES_A_TASK + 1
    nodes = saved(rows.groupBy("node").agg(F.min(F.struct(*names)).alias("row"), *held).repartition(parts), "nodes")
    # Readers put many files into one task; dealt anew, no task combines the entries of more than its share of nodes.
    entries = entries_of(nodes.select("node", "print", "weak", "short").repartition(parts, "node"))
    shared = entries.groupBy("entry").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    others = saved(entries.join(shared.select("entry", "head"), "entry").where("node <> head"), "entries")

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            held = [shingles_of(t, words).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"node": frame["node"], "shingles": held, "bytes": [len(h) for h in held]})

    def sets_for(asked: DataFrame) -> DataFrame:
        one = nodes.join(asked.distinct(), "node").select("node", "row.*")
        found = texts.join(one, names).select("node", "text").dropDuplicates(["node"])
        return saved(found.mapInPandas(sets_of, "node long, shingles binary, bytes long"), "sets")

    options = {"similarity": similarity, "block_rows": block_rows}
    ends = lambda pairs: pairs.select("node").unionByName(pairs.select(F.col("head").alias("node")))
    first = saved(near_prints(others.groupBy("node").agg(F.min("head").alias("head")), nodes), "near")
    tied = saved(star_links(first, sets_for(ends(first)), **options), "tied")
    reached = saved(components(tied.select(F.col("node").alias("a"), F.col("head").alias("b"))), "roots")

    def rooted(frame: DataFrame, name: str, root: str) -> DataFrame:
        found = reached.select(F.col("node").alias(name), F.col("root").alias("_root"))
        return frame.join(found, name, "left").withColumn(root, F.coalesce("_root", name)).drop("_root")

    # Near copies share most of their entries: a pair is looked up once, not in every entry that it shares.
    met = rooted(rooted(others.select("head", "node").distinct(), "node", "root"), "head", "head_root")
    met = met.where("root <> head_root").select("head", "node", "root")
    apart = saved(others.join(met, ["head", "node"]).select("entry", "node", "head", "root"), "apart")
    near = saved(near_prints(apart.select("head", "node").distinct(), nodes), "near")
    stars = saved(star_links(near, sets_for(ends(near)), **options), "stars")

    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    left = apart.join(stars, ["head", "node"], "left_anti").select("entry", "node", "root")
    asked = left.select("entry").distinct()
    sizes = others.join(asked, "entry").groupBy("entry").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    # Entries with the same nodes count once.
    once = saved(sizes.groupBy("n", "mark1", "mark2").agg(F.min("entry").alias("entry")).select("entry", "n"), "loose")
    loose, members = left.join(once, "entry"), rooted(others.select("entry", "node").join(once, "entry"), "node", "root")
    few = f"n <= {crowded}"
    one = loose.where(few).select("entry", F.col("node").alias("a"), F.col("root").alias("a_root"))
    met = one.join(members.where(few).select("entry", F.col("node").alias("b"), F.col("root").alias("b_root")), "entry")
    pairs = met.where("a_root <> b_root").select(F.least("a", "b").alias("head"), F.greatest("a", "b").alias("node")).distinct()
    near = saved(near_prints(pairs, nodes), "near")
    crowds = saved(members.where(f"NOT ({few})").select("entry", "node"), "crowds")
    sets = sets_for(ends(near).unionByName(crowds.select("node")))
    grid = grid_links(loose.where(f"NOT ({few})").select("entry", "node"), crowds, sets, **options)
    as_edges = lambda links: links.select(F.col("node").alias("a"), F.col("head").alias("b"))
    later = as_edges(stars).unionByName(as_edges(star_links(near, sets, **options))).unionByName(grid)
    between = rooted(rooted(later, "a", "x"), "b", "y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return saved(as_edges(tied).unionByName(between.distinct()), "links")


def drop_similar(
    docs: DataFrame, *, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, block_rows: int = BLOCK_ROWS, crowded: int = CROWDED
) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that with the smallest id, rows without an id last.

    Two texts are similar if the Jaccard similarity of their sets of shingles
    is at least ``similarity``. Texts of equal sets (64 bits of a hash over the
    set) are one node, so copies cost one entry. Nodes have the SimHash of their
    set; those that share an entry of the multi-index are compared on all bits,
    then on all shingles, and those alike linked. Of rows that agree in id and
    text, one stays. Null texts and those without words are alike.
    """
    names = ["_k_id", "_k_null", "_k_text"]

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            sets = [shingles_of(t, words) for t in frame.pop("text")]
            frame["node"] = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], dtype=np.uint64).view(np.int64)
            prints = [set_fingerprint(s) if len(s) else (_NONE, _NONE) for s in sets]
            frame["print"], frame["weak"] = [p for p, _ in prints], [w for _, w in prints]
            frame["short"] = [short_names(s) for s in sets]
            yield frame

    keyed = docs.select(*row_key(), "text")
    schema = "_k_id long, _k_null boolean, _k_text long, node long, print array<int>, weak array<tinyint>, short array<long>"
    rows = saved(keyed.mapInPandas(sketch, schema), "simhash")
    options = {"similarity": similarity, "words": words, "block_rows": block_rows, "crowded": crowded}
    found = similar_links(rows, docs.select(*row_key(), "text"), **options)
    reached = components(found)
    first = F.min(F.struct("_k_null", "_k_id", "_k_text")).alias("first")
    root = F.coalesce(F.col("root"), F.col("node")).alias("root")
    stay = rows.join(reached, "node", "left").select(root, *names).groupBy("root").agg(first).select("first.*")
    keyed = docs.select(F.struct("*").alias("doc"), *row_key()).join(stay, names, "left_semi")
    order = Window.partitionBy(*names).orderBy("_k_text")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc.*")
