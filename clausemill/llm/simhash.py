"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from clausemill.llm.common import row_key, saved
from clausemill.llm.components import components

SHINGLE_WORDS = 3
#: A text's bytes are hashed so many at a time; a word is never cut.
_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: A table entry of more fingerprints than this is not paired but linked through points between fingerprints.
CROWDED = 64
#: Fingerprints of sets, which reach a similarity instead of a few bits: so many segments, a table each, of so many bits.
SEGMENTS, SEGMENT_BITS = 24, 28
#: A fingerprint also stands under the values of a segment with one of so many least certain bits turned. Sets of Jaccard
#: similarity 0.8 differ in 0.15 of the bits and share an entry in 0.985 of the cases, at 0.85 in 0.995 (simulated).
FLIPS = 6
#: A quarter of the bits; sets of similarity 0.8 that differ in more are five standard deviations off.
RADIUS = SEGMENTS * SEGMENT_BITS // 4
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, -(-SEGMENTS * SEGMENT_BITS // 64), dtype=np.uint64)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None, None]
_LANES = np.uint64(0x0101010101010101)


def _blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + _BLOCK) if at + _BLOCK < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, A-Z lowered; 0 without words.

    Every shingle counts as often as it occurs, weighted by nothing; a text of
    fewer words than a shingle is one shingle. Memory is bounded by the block.
    """
    counts, n, carry = np.zeros((8, 256), np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in _blocks((text or "").encode().lower()):
        run = carry + block.split()
        if len(run) < words:
            carry = run
            continue
        joined = b" ".join(run)
        ends = np.cumsum([len(w) + 1 for w in run]).tolist()
        starts = [0, *ends[: len(run) - words]]
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]
        columns = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(columns[:, i], minlength=256)
        n += len(hashes)
        carry = run[len(run) - words + 1 :]
    if not n and carry:
        return digest(b" ".join(carry), 42)
    ones = (counts @ _BITS).reshape(64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of a set of 64-bit hashes, each spread over all bits, as the values of its segments; and the positions
    of the ``FLIPS`` bits of each segment that fewest hashes would have to turn."""
    counts = np.zeros((8, len(_SEEDS), 8), np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[None, at : at + 255] + _SEEDS[:, None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += ((x[None] >> _SHIFTS) & _LANES).sum(axis=2).view(np.uint8).reshape(counts.shape)
    lead = (2 * counts.reshape(-1)[: SEGMENTS * SEGMENT_BITS] - len(hashes)).reshape(SEGMENTS, SEGMENT_BITS)
    weak = np.argsort(np.abs(lead), axis=1, kind="stable")[:, :FLIPS]
    return ((lead > 0) @ (1 << np.arange(SEGMENT_BITS))).astype(np.int32), weak.astype(np.int8).reshape(-1)


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """SimHash of a text column as a signed long; null texts have the fingerprint 0."""

    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64)
            yield pd.Series(prints.view(np.int64))

    return run(text)


def links(prints: DataFrame, *, crowded: int = CROWDED) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints (column ``fp``, distinct) of at most 2 differing bits.

    The fingerprint is cut into two halves. If two differ in at most two bits,
    either their high halves differ in at most one, or their low halves are
    equal. So each probes the table of high halves with the 33 halves in the
    ball of radius 1, and the table of low halves with its own; what it meets
    is verified on all 64 bits.

    An entry holding more than ``crowded`` fingerprints would be met by too
    many pairs. Whoever is in such an entry or probes it is linked in another
    exact way: it names the 65 points at distance 0 or 1 from itself, and those
    who name the same point are tied to the smallest of them. Two fingerprints
    name a common point just if they differ in at most two bits, and at most 65
    name the same one, so this stays linear in the number of fingerprints.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    entry = lambda segment, value: F.struct(F.lit(segment).alias("segment"), value.alias("value"))
    table = prints.select("fp", F.explode(F.array(entry(0, high), entry(1, low))).alias("entry"))
    ball = [high, *[high.bitwiseXOR(F.lit(1 << i)) for i in range(32)]]
    probes = prints.select("fp", F.explode(F.array(*[entry(0, v) for v in ball], entry(1, low))).alias("entry"))
    full = saved(table.groupBy("entry").count().where(F.col("count") > crowded).select("entry"), "crowded")
    tied = None
    if not full.isEmpty():
        there = table.join(full, "entry", "left_semi").select("fp").unionByName(probes.join(full, "entry", "left_semi").select("fp"))
        table, probes = table.join(full, "entry", "left_anti"), probes.join(full, "entry", "left_anti")
        flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]]
        points = there.distinct().select("fp", F.explode(F.array(*flips)).alias("point"))
        least = F.min("fp").over(Window.partitionBy("point"))
        tied = points.select("fp", least.alias("a")).where("a < fp").select("a", F.col("fp").alias("b"))
    # The tables are exploded, and Spark takes an exploded table to be as small as the rows it comes from.
    met = table.withColumnRenamed("fp", "b").hint("merge").join(probes.withColumnRenamed("fp", "a").hint("merge"), "entry")
    near = met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (pairs if tied is None else pairs.unionByName(tied)).distinct()


def classes(rows: DataFrame, *, crowded: int = CROWDED) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of ``rows`` (``doc_id, fp``).

    The component is named by its smallest id; a component without ids has none.
    """
    prints = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    reached = saved(components(links(prints.select("fp"), crowded=crowded)), "components")
    named = prints.join(reached.withColumnRenamed("node", "fp"), "fp")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = named.select("fp", "root").join(smallest, "root")
    alone = prints.join(reached.select(F.col("node").alias("fp")), "fp", "left_anti")
    return saved(
        linked.select("fp", "root", "component_id").unionByName(
            alone.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
        ),
        "classes",
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, crowded: int = CROWDED
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    The fingerprint is 16 hexadecimal digits. Null and empty texts have the
    fingerprint zero and link like any other; repeated rows share a class.
    Rows without an id belong to the component of their text but never name it.
    Copies are one fingerprint, so a group of any size costs one entry. Other
    columns are not read; an empty table gives no rows.
    """
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "simhash")
    return rows.join(classes(rows, crowded=crowded), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, *, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, rows without an id last.

    Of rows that agree in id and text, one stays.
    """
    names = ["_k_id", "_k_null", "_k_text"]
    rows = saved(docs.select(*row_key(), "doc_id", fingerprint(F.col("text"), words).alias("fp")), "simhash")
    first = F.min(F.struct("_k_null", "_k_id", "_k_text")).alias("first")
    stay = rows.join(classes(rows), "fp").groupBy("root").agg(first).select("first.*")
    keyed = docs.select(F.struct("*").alias("doc"), *row_key()).join(stay, names, "left_semi")
    one = Window.partitionBy(*names).orderBy("_k_text")
    return keyed.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("doc.*")
