"""Ranked lexical search: the best documents for each of a set of items, by weights of the terms they share.

Documents become rows of term numbers and frequencies, for the terms that some
item asks for. A task then takes a bounded block of such rows. For each item,
bitmap operations mark in every document's mask which of the item's terms it
holds; documents of one mask share one upper bound. Masks are evaluated from
the highest bound down, until no mask left can reach the k-th best score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import NO_ID, order_id, saved

#: The items of a block hold about so many characters; a block is sent to every task.
BLOCK_CHARS = 4_000_000
#: So many masks are evaluated at first, then twice as many each time.
FIRST_MASKS = 64
#: Bytes of terms, A-Z lowered: digits, letters, and all of characters beyond ASCII; the others part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_POSTINGS = "_doc long, n long, terms binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """A block of documents: what each of its terms adds to a score, by document and by term."""

    def __init__(self, docs: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n_terms: int, stats: tuple[int, int]):
        n_docs, total = stats
        m = 100 - 75 + (75 * lengths * n_docs) // max(total, 1)
        owner = np.repeat(np.arange(len(docs)), sizes)
        self.docs, self.terms, self.sizes = docs, terms, sizes
        self.first = np.cumsum(sizes) - sizes
        tfs = tfs.astype(np.int64)
        self.gain = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.holders = owner[order]
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        if len(terms):
            np.maximum.at(self.most, terms, self.gain)

    def masks(self, ids: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every document, which of the terms ``ids`` it holds, as bits, and the most that such a document can score."""
        bits, bound = np.zeros((len(self.docs), -(-len(ids) // 64)), np.uint64), np.zeros(len(self.docs), np.int64)
        for j, term in enumerate(ids.tolist()):
            holders = self.holders[self.at[term] : self.at[term + 1]]
            bits[holders, j >> 6] |= np.uint64(1 << (j & 63))
            bound[holders] += worth[j] * self.most[term]
        return bits, bound

    def scores(self, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The exact scores of some documents that hold a term each; ``value`` has the item's weight of every term."""
        sizes = self.sizes[rows]
        start = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.first[rows] - start, sizes)
        return np.add.reduceat(value[self.terms[at]] * self.gain[at], start)


def best_of(block: Postings, ids: np.ndarray, worth: np.ndarray, value: np.ndarray, k: int, top: tuple[np.ndarray, np.ndarray]):
    """``top`` (scores, documents) of earlier blocks, with what this one adds, and how many documents were scored."""
    bits, bound = block.masks(ids, worth)
    some = np.flatnonzero(bound > 0)
    if not len(some):
        return top, 0
    columns = [bits[some, c] for c in range(bits.shape[1])]
    order = np.lexsort(columns)
    fresh = np.zeros(len(some), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    starts = np.flatnonzero(fresh)
    members, ends = some[order], np.r_[starts[1:], len(some)]
    limit = bound[members[starts]]
    by_bound = np.argsort(-limit, kind="stable")
    at, step, scored = 0, FIRST_MASKS, 0
    while at < len(by_bound):
        if len(top[0]) == k and limit[by_bound[at]] < top[0][-1]:
            break
        groups = by_bound[at : at + step]
        sizes = ends[groups] - starts[groups]
        offset = np.repeat(starts[groups] - (np.cumsum(sizes) - sizes), sizes)
        rows = members[np.arange(int(sizes.sum())) + offset]
        scored += len(rows)
        scores = np.r_[top[0], block.scores(rows, value)]
        docs = np.r_[top[1], block.docs[rows]]
        kept = np.flatnonzero(scores > 0)
        kept = kept[np.lexsort((docs[kept], -scores[kept]))[:k]]
        top = scores[kept], docs[kept]
        at, step = at + step, step * 2
    return top, scored


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items with their terms, a bounded number of characters at a time."""
    block, held = [], 0
    for row in items.toLocalIterator():
        terms = Counter(terms_of(row.text))
        if terms:
            block.append((row.item_id, terms))
            held += len(row.text)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``_doc, n, terms, tfs`` per document that has a term: its size in terms, and those of ``vocabulary`` it holds."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text in zip(frame["_doc"], frame["text"], strict=True):
                found = terms_of(text)
                if found:
                    ids = [i for i in map(vocabulary.get, found) if i is not None]
                    terms, tfs = np.unique(np.array(ids, np.int32), return_counts=True)
                    out.append((doc, len(found), terms.tobytes(), tfs.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["_doc", "n", "terms", "tfs"])

    return docs.select(order_id().alias("_doc"), "text").mapInPandas(count, _POSTINGS)


def _frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term of the block: counted per task, then summed."""

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(n_terms, np.int64)
        for frame in frames:
            if len(frame):
                held += np.bincount(np.frombuffer(b"".join(frame["terms"]), np.int32), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"term": at.astype(np.int32), "df": held[at]})

    out = np.zeros(n_terms, np.int64)
    for row in rows.select("terms").mapInPandas(per_task, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


def _search(docs: DataFrame, block: list[tuple[object, Counter]], k: int, item_type: str) -> DataFrame:
    """``ranked`` for one block of items."""
    vocabulary: dict[bytes, int] = {}
    for _, terms in block:
        for term in terms:
            vocabulary.setdefault(term, len(vocabulary))
    rows = saved(postings(docs, vocabulary), "postings")
    n_docs, total = rows.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(rows, len(vocabulary))
    asked = []
    for _, terms in block:
        held = [(vocabulary[t], c * weight(n_docs, int(df[vocabulary[t]]))) for t, c in terms.items() if df[vocabulary[t]]]
        held = [(i, w) for i, w in held if w > 0]
        asked.append((np.array([i for i, _ in held], np.int64), np.array([w for _, w in held], np.int64)))
    n_terms, stats = len(vocabulary), (n_docs, total)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked)
        value = np.zeros(n_terms, np.int64)
        for frame in frames:
            if not len(frame):
                continue
            terms = np.frombuffer(b"".join(frame["terms"]), np.int32)
            tfs = np.frombuffer(b"".join(frame["tfs"]), np.int32)
            sizes = frame["terms"].map(len).to_numpy(np.int64) // 4
            part = Postings(frame["_doc"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), terms, tfs, sizes, n_terms, stats)
            for no, (ids, worth) in enumerate(asked):
                value[ids] = worth
                tops[no], _ = best_of(part, ids, worth, value, k, tops[no])
                value[ids] = 0
        sizes = [len(scores) for scores, _ in tops]
        yield pd.DataFrame(
            {
                "_item": np.repeat(np.arange(len(tops), dtype=np.int32), sizes),
                "_doc": np.concatenate([d for _, d in tops]),
                "score": np.concatenate([s for s, _ in tops]),
            }
        )

    found = rows.mapInPandas(search, "_item int, _doc long, score long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), "_doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"_item int, item_id {item_type}")
    return best.join(names, "_item").select("item_id", "rank", F.expr(f"nullif(_doc, {NO_ID}L)").alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` (``item_id, text``) its ``k`` best of ``docs`` (``doc_id, text``).

    Terms are runs of digits, ASCII letters and characters beyond ASCII; only
    A-Z are lowered. A term that df of the N documents with a term hold weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))). Each occurrence of a term in the
    item adds its weight x (10^9 tf div (1000 tf + 8 m)), where m is 25 + 75 n N
    div L for a document of n terms, and L counts all terms of all documents.
    Only scores above 0 count; equal ones go by the document's id, those
    without an id (null in the result) last.

    Null and empty texts hold no term and are neither found nor counted; items
    without a term that some document holds have no rows. Documents that share
    an id are ranked each. Items are told apart by id and text; equal rows of
    ``items`` count once. Other columns are not read.

    Memory is bounded by a block of items (``block_chars``), on the driver and
    in the tasks, and by an Arrow batch of documents; a task emits k rows an
    item. A larger set of items is asked block by block, each with its own pass.
    """
    items = items.select("item_id", "text").where("text is not null").distinct()
    item_type = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in _blocks(items, block_chars):
        part = _search(docs, block, k, item_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return found
