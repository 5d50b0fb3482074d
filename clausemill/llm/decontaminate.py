"""Benchmark decontamination: approximate occurrences of test items, by pieces that must occur exactly.

If a text holds an item with at most k edits, and the item is cut into k + 1
pieces, one piece at least stands there unchanged. So one pass over each text
looks for all pieces at once, and only the surroundings of a hit are compared,
with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import row_key, saved


#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Items are searched for in blocks of so many characters; one block is sent to every task.
BLOCK_CHARS = 500_000
_SPACE = re.compile(r"\s+")


def normalised(text: str | None) -> str:
    """Small letters, and one blank for each run of white space, none at the ends."""
    return _SPACE.sub(" ", (text or "").lower()).strip()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into ``edits`` + 1 pieces as equal as can be, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    """For each character of an item, the bits of its places."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The smallest edit distance from an item of ``m`` characters to any part of ``text``, and where that part ends.

    Myers' algorithm: a column of the distance table is two bit vectors, rises
    and falls, and one step per character moves on to the next column.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, best, end = every, 0, m, m, 0
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        across = eq | fall
        eq |= ((eq & rise) + rise) ^ rise
        up = fall | (~(eq | rise) & every)
        down = rise & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        rise = (down | ~(across | up)) & every
        fall = up & across & every
        if score < best:
            best, end = score, at + 1
    return best, end


@dataclass
class Searcher:
    """Finds a block of items in texts."""

    items: dict[int, str]
    chars_per_edit: int = CHARS_PER_EDIT
    _masks: dict[int, dict[str, int]] = field(default_factory=dict)
    _machine: object = None

    def __post_init__(self) -> None:
        found: dict[str, list[tuple[int, int]]] = {}
        self._edits = {k: len(t) // self.chars_per_edit for k, t in self.items.items()}
        for key, item in self.items.items():
            for at, piece in pieces(item, self._edits[key]):
                found.setdefault(piece, []).append((key, at))
        self._machine = ahocorasick.Automaton()
        for piece, whose in found.items():
            self._machine.add_word(piece, (len(piece), whose))
        if found:
            self._machine.make_automaton()
        self._any = bool(found)

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item, distance, end)`` for each item the text holds, with its nearest occurrence in the normalised text."""
        if not self._any:
            return []
        low = normalised(text)
        spans: dict[int, list[list[int]]] = {}
        for last, (size, whose) in self._machine.iter(low):
            for key, at in whose:
                edits, start = self._edits[key], last - size + 1 - at
                lo, hi = max(0, start - edits), start + len(self.items[key]) + edits
                mine = spans.setdefault(key, [])
                if mine and mine[-1][0] <= lo <= mine[-1][1]:
                    mine[-1][1] = max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        found = []
        for key, mine in spans.items():
            if key not in self._masks:
                self._masks[key] = masks_of(self.items[key])
            best = (self._edits[key] + 1, 0)
            for lo, hi in sorted(mine):
                distance, end = nearest(self._masks[key], len(self.items[key]), low[lo:hi])
                best = min(best, (distance, lo + end))
            if best[0] <= self._edits[key]:
                found.append((key, *best))
        return sorted(found)


def _blocks(benchmark: DataFrame, min_chars: int, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items as they are compared, a bounded number of characters at a time."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    block, held = [], 0
    for row in items.toLocalIterator():
        item = normalised(row.text)
        if len(item) >= max(1, min_chars):
            block.append((row.item_id, item))
            held += len(item)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


_KIND = "array<struct<item_id:long,distance:int,length:int>>"


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    chars_per_edit: int = CHARS_PER_EDIT,
    min_chars: int = 1,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with a column ``matches``: an array of ``(item_id, distance, length)`` of the items each text holds.

    Texts and items are compared in small letters with single blanks. An item of
    n characters is held by a text that has a part within n // ``chars_per_edit``
    edits of it. Empty items, those shorter than ``min_chars``, and null ones
    are not looked for; null texts hold nothing. Items that share an id each
    count; repeated ones count once. An empty benchmark leaves all arrays empty.

    The items of a block (``block_chars`` characters) go to every task. A larger
    benchmark is searched for block by block: each pass writes only the rows
    that hold something, and all of them meet ``docs`` in one join at the end.
    So memory is bounded by a block, on the driver and in the tasks.
    """
    blocks = _blocks(benchmark, min_chars, block_chars)
    first, more = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.withColumn("matches", F.array().cast(_KIND))
    if more is None:
        return docs.withColumn("matches", _search(first, chars_per_edit)(F.col("text")))
    names = ["_k_id", "_k_null", "_k_text"]
    has_id = "doc_id" in docs.columns
    keys = row_key() if has_id else [F.lit(0).alias("_k_id"), F.lit(False).alias("_k_null"), F.xxhash64("text").alias("_k_text")]
    texts, found = docs.select(*keys, "text"), None
    for block in chain((first, more), blocks):
        part = texts.select(*names, _search(block, chars_per_edit)(F.col("text")).alias("matches")).where(F.size("matches") > 0)
        part = saved(part.distinct(), "matches")
        found = part if found is None else found.unionByName(part)
    joined = found.groupBy(*names).agg(F.flatten(F.collect_list("matches")).alias("matches"))
    whole = docs.select(F.struct("*").alias("doc"), *keys).join(joined, names, "left")
    return whole.select("doc.*", F.coalesce("matches", F.array().cast(_KIND)).alias("matches"))


def _search(block: list[tuple[int | None, str]], chars_per_edit: int):
    @F.pandas_udf(_KIND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher({n: item for n, (_, item) in enumerate(block)}, chars_per_edit)
        for texts in batches:
            yield pd.Series(
                [[{"item_id": block[n][0], "distance": d, "length": len(block[n][1])} for n, d, _ in searcher.search(t)] for t in texts]
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, contaminated, item_ids, distances`` for every row of ``docs``; lists run in step, by item."""
    found = matches(docs.select("doc_id", "text"), benchmark, **options)
    held = F.array_sort("matches")
    return found.select("doc_id", held.alias("matches")).select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.col("matches.item_id").alias("item_ids"),
        F.col("matches.distance").alias("distances"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text")
    return matches(whole, benchmark, **options).where(F.size("matches") == 0).select("doc.*")
