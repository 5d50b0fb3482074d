"""Removal of repeated passages: windows that repeat at one length alone are extended to twice that length.

A level works with windows of one length. Each names its hash and the document
it starts in; an aggregate that combines before the shuffle keeps, per hash, the
smallest and the largest document. Only the *first* document of a hash gets it
back, so a document learns which of its windows start nowhere earlier, and which
of those nowhere else; all its other windows repeat. No occurrence is joined
with another, so a passage in a third of all documents costs one row per task.

The first level does not hash all windows of its length but those picked by
winnowing: of every run of them that lies within one window of twice the
length, the one with the smallest hash. A window of twice the length that
repeats therefore repeats the window picked in it, and is looked at only if
that one does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import NO_ID, order_id, saved

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _TURN, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
#: Keeps the first 0 to 8 bytes of eight.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's UTF-8 bytes begin and end."""
    word = np.concatenate(([False], ~_SPACES[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes of all words that are as long at a time."""
    length = ends - starts
    out = length.astype(np.uint64) * _TURN
    if not len(out):
        return out
    # Eight bytes from every place on, as one number.
    eights = np.ndarray((len(data),), "<u8", data.tobytes() + bytes(8), strides=(1,))
    left, at = np.flatnonzero(length <= _LONG_WORD), 0
    while len(left):
        part = eights[starts[left] + at] & _HEAD[np.minimum(length[left] - at, 8)]
        out[left] = _mix((out[left] ^ part) * _BASE)
        at += 8
        left = left[length[left] > at]
    for i in np.flatnonzero(length > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


#: Odd factors for joining runs, three for each doubling.
_FACTORS = np.random.default_rng(20240601).integers(1, 1 << 63, (64, 3), dtype=np.uint64) * _U(2) + _U(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words: runs of 1, 2, 4, ... words by doubling, joined as ``size`` in binary says.

    Before the last step this is a sum of word hashes, each times the factors of its place.
    """
    if len(words) < size:
        return np.empty(0, np.uint64)
    n, done, out, part, width = len(words) - size + 1, 0, None, words, 1
    for left, right, joint in _FACTORS:
        if size & width:
            piece = part[done : done + n]
            out = piece * joint if out is None else out + piece * joint
            done += width
        if 2 * width > size:
            break
        part, width = part[:-width] * left + part[width:] * right, 2 * width
    return _mix(out)


_PLACE_BITS = 24


def _picked(hashes: np.ndarray, run: int) -> np.ndarray:
    """Of every ``run`` consecutive hashes, the place of the smallest by its leading bits (the first of equals)."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    step = (1 << _PLACE_BITS) - run  # places within a stretch fit in the bits that hashes give up
    found = []
    for at in range(0, n, step):
        part = hashes[at : min(at + step, n) + run - 1]
        least = part >> _U(_PLACE_BITS) << _U(_PLACE_BITS) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= run:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < run:
            least = np.minimum(least[: len(part) - run + 1], least[run - width :])
        found.append((least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64) + at)
    return np.concatenate(found)


class Text:
    """The words of one text, hashed once."""

    def __init__(self, text: str | None) -> None:
        self.data = np.frombuffer((text or "").encode(), np.uint8)
        self.starts, self.ends = word_spans(self.data)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self._windows: dict[int, np.ndarray] = {}

    def _hashes(self, size: int) -> np.ndarray:
        if size not in self._windows:
            self._windows[size] = window_hashes(self.words, size)
        return self._windows[size]

    def picks(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``size`` words, and the pick inside each window of twice the size."""
        if len(self.words) < 2 * size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes = self._hashes(size)
        return hashes, _picked(hashes, size + 1)

    def names(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that stand for the windows of ``size`` words at the places ``at``, from the hashes of their halves."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        halves = self._hashes(size // 2)
        one, two = halves[at], halves[at + size // 2] * _TURN
        return _mix(one * _BASE + two).view(np.int64), (_mix(one * _BASE2 + two) >> _U(33)).astype(np.int32)

    def kept(self, gone: np.ndarray) -> str:
        """The digest of the words that stay, joined by one space."""
        digest, first = hashlib.sha256(), True
        raw = self.data.tobytes()
        for a, b in _runs(np.flatnonzero(~gone)):
            for at in range(a, b, 1 << 16):
                to = min(b, at + (1 << 16))
                part = b" ".join(raw[self.starts[at] : self.ends[to - 1]].split())
                digest.update(part if first else b" " + part)
                first = False
        return digest.hexdigest()


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Ascending places as half-open runs."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    bounds = [0, *cuts.tolist(), len(at)]
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in pairwise(bounds)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(order_id(id_col).alias("doc"), F.col(text_col).alias("text"))


def _id() -> Column:
    return F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")


def _first_level(texts: DataFrame, size: int) -> DataFrame:
    """``doc, own``: the hashes picked at ``size`` that start in no other document."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        for frame in frames:
            for doc, text in zip(frame["doc"], frame["text"], strict=True):
                hashes, picks = Text(text).picks(size)
                if len(picks):
                    names = np.unique(hashes[np.unique(picks)]).view(np.int64)
                    yield {"doc": np.full(len(names), doc), "name": names}

    found = texts.select("doc", "text").mapInPandas(_batched(emit), "doc long, name long")
    span = found.groupBy("name").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    return span.where("doc = last").groupBy("doc").agg(F.collect_list("name").alias("own"))


def _batched(emit, rows: int = 200_000):
    """The columns that ``emit`` gives per document, as frames of about ``rows`` rows."""

    def frame(held: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame({name: np.concatenate([h[name] for h in held]) for name in held[0]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for columns in emit(frames):
            held.append(columns)
            n += len(columns["doc"])
            if n >= rows:
                yield frame(held)
                held, n = [], 0
        if held:
            yield frame(held)

    return run


def _alone(mine: tuple[np.ndarray, ...], names: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which entries of ``mine`` are among ``names``; both are columns of equal rows."""
    if not len(names[0]) or not len(mine[0]):
        return np.zeros(len(mine[0]), bool)
    order = np.argsort(names[0], kind="stable")
    names = tuple(c[order] for c in names)
    if (names[0][1:] == names[0][:-1]).any():
        among = set(zip(*(c.tolist() for c in names), strict=True))
        return np.array([row in among for row in zip(*(c.tolist() for c in mine), strict=True)], bool)
    at = np.minimum(np.searchsorted(names[0], mine[0]), len(order) - 1)
    return np.logical_and.reduce([n[at] == m for n, m in zip(names, mine, strict=True)])


def _column(row, name: str, kind) -> np.ndarray:
    """An array column's value, empty where the document got nothing back."""
    value = getattr(row, name)
    return np.empty(0, kind) if value is None or np.ndim(value) == 0 else np.asarray(value, kind)


def _repeating(row, text: Text, half: int, sizes: list[int]) -> np.ndarray:
    """Starts of the windows to look at after the levels ``sizes``: both halves repeat (at the first level, the pick does)."""
    hashes, picks = text.picks(half)
    if not len(picks):
        return picks
    own = _column(row, "own", np.int64)
    at = np.flatnonzero(~_alone((hashes.view(np.int64)[picks],), (own,)))
    for size in sizes:
        alone = _column(row, f"alone_{size}", bool)
        names = tuple(_column(row, f"{part}_{size}", kind)[alone] for part, kind in (("one", np.int64), ("two", np.int32)))
        at = at[~_alone(text.names(size, at), names)]
        at = at[np.isin(at + size, at, assume_unique=True)]
    return at


def _level(known: DataFrame, half: int, sizes: list[int], size: int) -> DataFrame:
    """Per name of a window of ``size`` words that is looked at, the first and the last document it starts in."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                text = Text(row.text)
                at = _repeating(row, text, half, sizes)
                if len(at):
                    one, two = text.names(size, at)
                    yield {"doc": np.full(len(at), row.doc), "one": one, "two": two}

    found = known.mapInPandas(_batched(emit), "doc long, one long, two int")
    return found.groupBy("one", "two").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))


def _given_back(names: DataFrame, size: int) -> DataFrame:
    """Per document the names that it is the first to hold, and whether no other holds them; the lists run in step."""
    lists = {"one": F.col("one"), "two": F.col("two"), "alone": F.col("doc") == F.col("last")}
    return names.groupBy("doc").agg(*[F.collect_list(c).alias(f"{n}_{size}") for n, c in lists.items()])


def remove_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: which words lie in a window of ``window`` words that also starts in an earlier document.

    Gives ``doc_id, n_words, n_removed, kept_sha256, removed`` with ``removed``
    the flat half-open runs of word places that go. Earlier means a smaller id;
    rows without an id (or with the largest long) come after all others, and
    rows with the same id are one document that does not repeat itself. Texts
    shorter than the window, empty and null ones keep all their words. Two
    levels are enough, half the window and the window: what repeats at greater
    length removes no further word (`longest_repeats` goes on). Windows count
    as equal by 96 bits of hash. Texts are shuffled once, as both uses of the
    joined table read the same exchange. Other columns are not read; an empty
    table gives no rows.
    """
    half = _half(window)
    texts = _keyed(docs, id_col, text_col)
    known = texts.join(_first_level(texts, half), "doc", "left")
    told = known.join(_given_back(_level(known, half, [], window), window), "doc", "left")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                text = Text(row.text)
                at = _repeating(row, text, half, [])
                names = _column(row, f"one_{window}", np.int64), _column(row, f"two_{window}", np.int32)
                later = at[~_alone(text.names(window, at), names)]
                edges = np.zeros(len(text.words) + 1, np.int64)
                np.add.at(edges, later, 1)
                np.add.at(edges, later + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                rows.append((row.doc, len(gone), int(gone.sum()), text.kept(gone), [x for r in _runs(np.flatnonzero(gone)) for x in r]))
            yield pd.DataFrame(rows, columns=["doc", "n_words", "n_removed", "kept_sha256", "removed"])

    out = told.mapInPandas(judge, "doc long, n_words long, n_removed long, kept_sha256 string, removed array<long>")
    return out.select(_id(), "n_words", "n_removed", "kept_sha256", "removed")


def longest_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, longest``: the longest level, ``window`` words doubled again and again, at which a document repeats another.

    A window of twice the length is looked at only where both its halves
    repeat; levels go on until no window repeats. 0 where nothing of
    ``window`` words does. The cases of `remove_repeats` hold here too.
    """
    half, sizes, size = _half(window), [], window
    texts = _keyed(docs, id_col, text_col)
    known = texts.join(_first_level(texts, half), "doc", "left")
    while True:
        names = saved(_level(known, half, sizes, size), "windows")
        if names.where("doc < last").isEmpty():
            break
        known = known.join(_given_back(names, size), "doc", "left")
        sizes, size = [*sizes, size], 2 * size

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                text, longest = Text(row.text), 0
                for n, reached in enumerate(sizes):
                    at = _repeating(row, text, half, sizes[:n])
                    alone = _column(row, f"alone_{reached}", bool)
                    parts = (("one", np.int64), ("two", np.int32))
                    names = tuple(_column(row, f"{part}_{reached}", kind)[alone] for part, kind in parts)
                    if len(at) and not _alone(text.names(reached, at), names).all():
                        longest = reached
                rows.append((row.doc, longest))
            yield pd.DataFrame(rows, columns=["doc", "longest"])

    return known.mapInPandas(judge, "doc long, longest long").select(_id(), "longest")


def _half(window: int) -> int:
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    return window // 2
