"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is whether a text holds an n-gram at all. Its value is the logarithm
of how much more often toxic training texts hold it than others do, so grams
that say nothing weigh next to nothing before the weights are learnt; the
weights are a logistic regression over these values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from clausemill.llm.common import saved

GRAMS = (3, 4, 5, 6, 8)
TABLE_BITS = 20
#: The classifier is fitted on so many labelled rows at most, chosen by a hash of their ids.
SAMPLE_ROWS = 16_384
#: Of all n-grams, so many that tell the classes apart best are kept.
FEATURES = 8192
_TASKS, _CHUNKS = 16, 64
_U = np.uint64
#: Features of rows that are unfolded together.
_PIECE = 1 << 20
#: Characters that are looked at together.
_BLOCK = 1 << 20


def held_out(name: str = "doc_id") -> Column:
    """Whether no label of this row may be learnt: the CRC-32 of its id as text is divisible by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 5 == 0, F.lit(False))


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Table places of the n-grams of a text in small letters, with white space as blanks, one at each end."""
    low = " " + (text or "").lower() + " "
    overlap = max(GRAMS) - 1
    for at in range(0, max(1, len(low) - overlap), _BLOCK):
        codes = np.frombuffer(low[at : at + _BLOCK + overlap].encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes[(codes >= 9) & (codes <= 13)] = 32
        run = codes
        for n in range(2, max(GRAMS) + 1):
            if len(run) < 2:
                break
            run = run[:-1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n in GRAMS:
                mixed = (run ^ (run >> _U(29))) * _U(0xBF58476D1CE4E5B9 + 2 * n)
                yield (mixed >> _U(64 - TABLE_BITS)).astype(np.int64)


def present(text: str | None, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct places a text holds, of those that ``among`` marks."""
    found = [np.unique(g if among is None else g[among[g]]) for g in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """``weights``: what the presence of the n-gram at each place of the table adds to the log-odds."""

    weights: np.ndarray
    bias: float

    def score_of(self, text: str | None) -> float:
        odds = self.bias + float(self.weights[present(text, self.weights != 0)].sum())
        return float(1 / (1 + np.exp(-np.clip(odds, -35, 35))))

    def score(self, text: Column) -> Column:
        """The chance that a text is toxic, from 0 to 1; null counts as empty."""
        at = np.flatnonzero(self.weights)
        held, bias = (at.astype(np.int32), self.weights[at].astype(np.float64)), self.bias

        @pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = np.zeros(1 << TABLE_BITS)
            table[held[0]] = held[1]
            marks = table != 0
            for texts in batches:
                odds = np.array([bias + table[present(t, marks)].sum() for t in texts], np.float64)
                yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -35, 35))))

        return run(text)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, y, text`` of at most ``rows`` labelled documents that are not held out, chosen by a hash of their ids.

    The chosen ids are broadcast; their number is bounded by ``rows``. A
    repeated id counts once, with the smallest of its texts.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = usable.where(~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and other texts hold the n-gram of each place, summed per task and then per part of the table."""

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, any_rows = np.zeros((2, 1 << TABLE_BITS), np.int32), False
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"], strict=True):
                counts[y, present(text)] += 1
                any_rows = True
        if any_rows:
            parts = np.split(counts, _CHUNKS, axis=1)
            yield pd.DataFrame({"part": range(_CHUNKS), "counts": [p.tobytes() for p in parts]})

    def per_part(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in frame["counts"])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [total.astype(np.int32).tobytes()]})

    schema = "part int, counts binary"
    sums = rows.mapInPandas(per_task, schema).groupBy("part").applyInPandas(per_part, schema)
    parts = {r.part: np.frombuffer(r.counts, np.int32).reshape(2, -1) for r in sums.toLocalIterator()}
    if not parts:
        empty = np.zeros(1 << TABLE_BITS, np.int32)
        return empty, empty
    table = np.concatenate([parts[i] for i in range(_CHUNKS)], axis=1)
    return table[1], table[0]


def _telling(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, most: int) -> np.ndarray:
    """The places whose presence tells most about the class (log-likelihood ratio), at most ``most``."""
    total, seen = n_pos + n_neg, pos + neg

    def part(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k * total / n), 0.0)

    cells = part(pos, seen * n_pos) + part(neg, seen * n_neg)
    cells = cells + part(n_pos - pos, (total - seen) * n_pos) + part(n_neg - neg, (total - seen) * n_neg)
    best = np.argsort(-cells, kind="stable")[:most]
    return np.sort(best[(seen[best] > 1) & (cells[best] > 1)])


def _logistic(place: np.ndarray, sizes: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 80):
    """Weights and bias (last) of a regularised logistic regression over sparse rows, by limited-memory BFGS.

    ``place`` holds the features of all rows, ``sizes`` how many each row has.
    A piece of the rows is unfolded at a time, so that memory stays near that
    of ``place`` itself.
    """
    n, width, ridge = len(y), len(value), 1e-4
    ends = np.cumsum(sizes)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(_PIECE, int(ends[-1]) + _PIECE, _PIECE)).clip(max=n), n])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        odds, scaled, total = np.full(n, w[-1]), w[:-1] * value, np.zeros(width)
        off = np.empty(n)
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = place[ends[a] - sizes[a] : ends[b - 1]]
            row = np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])
            odds[a:b] += np.bincount(row, weights=scaled[at], minlength=b - a)
            off[a:b] = (1 / (1 + np.exp(-np.clip(odds[a:b], -35, 35))) - y[a:b]) / n
            total += np.bincount(at, weights=off[a:b][row], minlength=width)
        slope = np.append(total * value + ridge * w[:-1], off.sum())
        return float(np.mean(np.logaddexp(0, odds) - y * odds) + ridge / 2 * w[:-1] @ w[:-1]), slope

    w, past = np.zeros(width + 1), []
    now, slope = loss(w)
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, d in reversed(past):
            kept.append((s @ way) / (s @ d))
            way -= kept[-1] * d
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, d), a in zip(past, reversed(kept), strict=True):
            way += s * (a - (d @ way) / (s @ d))
        step = 1.0
        while step > 1e-10:
            then, slope_then = loss(w - step * way)
            if then <= now - 1e-4 * step * (slope @ way):
                break
            step /= 2
        if step <= 1e-10 or now - then < 1e-9:
            break
        if -step * way @ (slope_then - slope) > 1e-14:
            past = [*past, (-step * way, slope_then - slope)][-10:]
        w, now, slope = w - step * way, then, slope_then
    return w[:-1], w[-1]


def train(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES
) -> Model:
    """A classifier from the labelled documents that are not held out.

    Only ``text`` is a feature. N-grams are counted by Spark over the sample;
    the driver sees the counts (a table of fixed size) and, of each row, which
    of the ``features`` chosen n-grams it holds. Labels other than 0 and 1 are
    not used. With labels of one class alone, or none, every text scores the
    smoothed share of toxic rows.
    """
    rows = saved(sample(docs, labels, label, sample_rows).repartition(_TASKS, "doc_id"), "toxicity-sample")
    n_pos, n_all = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("y")).first()
    n_neg = n_all - n_pos
    prior = float(np.log((n_pos + 1) / (n_neg + 1)))
    if not n_pos or not n_neg:
        return Model(np.zeros(1 << TABLE_BITS), prior)
    pos, neg = (c.astype(np.float64) for c in _counts(rows))
    chosen = _telling(pos, neg, n_pos, n_neg, features)
    ratio = np.log((pos[chosen] + 1) / (n_pos + 2)) - np.log((neg[chosen] + 1) / (n_neg + 2))
    index = np.full(1 << TABLE_BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = index >= 0
        for frame in frames:
            at = [index[present(t, marks)].astype(np.uint16).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"at": at, "y": frame["y"]})

    got = rows.mapInPandas(held, "at binary, y int").collect()  # at most sample_rows rows of 2 x features bytes
    y = np.array([r["y"] for r in got], np.float64)
    sizes = np.array([len(r["at"]) // 2 for r in got], np.int64)
    place = np.frombuffer(b"".join(r["at"] for r in got), np.uint16)
    del got
    weights, bias = _logistic(place, sizes, ratio, y)
    table = np.zeros(1 << TABLE_BITS)
    table[chosen] = weights * ratio
    return Model(table, bias)


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; repeated rows are scored alike, other columns are not read."""
    scored = docs.select(F.col(id_col).alias("doc_id"), model.score(F.col(text_col)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    whole = docs.select(F.struct("*").alias("doc"), model.score(F.col("text")).alias("score"))
    return whole.where(F.col("score") < threshold).select("doc.*")
