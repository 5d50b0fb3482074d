"""Quality: ridge regression over random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from clausemill.llm.common import saved
from clausemill.llm.substrings import Text, window_hashes
from clausemill.llm.toxicity import held_out

FEATURES = 384
BINS = 2048
_TASKS, _CHUNKS = 16, 32
NAMES = (
    "log_chars", "log_words", "word_length", "word_spread", "letters", "capitals", "digits", "spaces", "stops",
    "shouts", "symbols", "other_bytes", "log_lines", "log_line_words", "repeated_lines", "distinct_words",
    "repeated_triples", "repeated_tens", "letterless_words", "capital_words", "stopped_words", "entropy",
)

_CLASS = np.full(256, 7, np.int64)  # symbols
_CLASS[[*range(65, 91)]] = 0
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[128:192] = 6  # later bytes of a character
_CLASS[192:] = 1  # the first byte of a character outside ASCII counts as a letter
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def _repeated(hashes: np.ndarray) -> float:
    return 1 - len(np.unique(hashes)) / len(hashes) if len(hashes) else 0.0


def statistics_of(text: str | None) -> list[float]:
    """The statistics named in ``NAMES``, of the whole text; all zero for an empty one."""
    whole = Text(text)
    data, words = whole.data, whole.words
    if not len(words):
        return [0.0] * len(NAMES)
    bytes_of = np.bincount(data, minlength=256)
    kind = np.bincount(_CLASS, weights=bytes_of, minlength=8)
    chars = len(data) - kind[6]
    length = (whole.ends - whole.starts).astype(np.float64)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, whole.starts)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    with np.errstate(over="ignore"):
        lines = np.add.reduceat(words * (np.arange(len(words), dtype=np.uint64) - first.astype(np.uint64).repeat(np.diff(np.append(first, len(words)))) + np.uint64(1)), first)
    letter = np.isin(_CLASS[data], (0, 1, 2)).astype(np.int64)
    letters_upto = np.concatenate(([0], np.cumsum(letter)))
    share = bytes_of[bytes_of > 0] / len(data)
    n = len(words)
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        float(length.mean()),
        float(length.std()),
        kind[1] / chars,
        kind[0] / chars,
        kind[2] / chars,
        kind[3] / chars,
        kind[4] / chars,
        kind[5] / n,
        kind[7] / n,
        kind[6] / chars,
        float(np.log1p(len(lines))),
        float(np.log1p(n / len(lines))),
        _repeated(lines),
        float(np.log1p(len(np.unique(words))) / np.log1p(n)),
        _repeated(window_hashes(words, 3)),
        _repeated(window_hashes(words, 10)),
        float((letters_upto[whole.ends] == letters_upto[whole.starts]).mean()),
        float((_CLASS[data[whole.starts]] == 0).mean()),
        float(_STOP[data[whole.ends - 1]].mean()),
        float(-(share * np.log(share)).sum()),
    ]


def statistics(text: Column) -> Column:
    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics_of(t) for t in texts])

    return run(text)


@dataclass(frozen=True)
class Model:
    """Standardised statistics, turned by ``turn`` and ``shift`` into cosines, weighed, and read off the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    levels: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score_of(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.levels)

    def score(self, stats: Column) -> Column:
        """The chance that a document with these statistics is good, from 0 to 1."""
        model = self

        @pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in batches:
                yield pd.Series(model.score_of(np.stack(part.to_numpy())) if len(part) else np.empty(0))

        return run(stats)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to ``y`` (weighted squares) over ascending ``x``: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for at, value, w in zip(x, y, weight, strict=True):
        blocks.append([value, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, hi = blocks.pop()
            u, m, lo, _ = blocks.pop()
            blocks.append([(u * m + v * n) / (m + n), m + n, lo, hi])
    ends = [(at, v) for v, _, lo, hi in blocks for at in ((lo, hi) if hi > lo else (lo,))]
    return np.array([a for a, _ in ends]), np.array([v for _, v in ends])


def train(rows: DataFrame, *, features: int = FEATURES, ridge: float = 1e-3, bins: int = BINS, seed: int = 20_240_601) -> Model:
    """A model from ``rows`` (``stats``, ``y`` 0 or 1), all of them.

    The feature map is fixed by ``seed`` and the mean and spread of each
    statistic. Each task sums its rows' normal equations, Spark adds the sums
    part by part, and the driver solves one system of ``features`` + 1 unknowns.
    The calibration curve comes from counts in ``bins`` bins of the ridge
    scores. With rows of one class alone, or none, every document scores their
    smoothed share of good rows.
    """
    d, count = len(NAMES), features + 1
    each = [a for i in range(d) for a in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i]))]
    n, good, *moments = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0)), *each).first()
    moments = np.array([0.0 if m is None else m for m in moments]).reshape(d, 2)
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(d, features)) / np.sqrt(d) * 1.5, rng.uniform(0, 2 * np.pi, features)
    scale = np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0)
    flat = (np.array([0.0, 1.0]), np.full(2, (good + 1) / (n + 2)))
    start = Model(moments[:, 0], scale, turn, shift, np.zeros(count), flat)
    if not good or good == n:
        return start

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((count, count + 1))
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                phi = start.features(np.stack(part["stats"].to_numpy()))
                total += phi.T @ np.hstack([phi, part["y"].to_numpy(np.float64)[:, None]])
        pieces = np.array_split(total, _CHUNKS)
        yield pd.DataFrame({"part": range(_CHUNKS), "sums": [p.tobytes() for p in pieces]})

    def per_part(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "sums": [total.tobytes()]})

    schema = "part int, sums binary"
    sums = rows.repartition(_TASKS).mapInPandas(per_task, schema).groupBy("part").applyInPandas(per_part, schema)
    parts = {r.part: np.frombuffer(r.sums).reshape(-1, count + 1) for r in sums.toLocalIterator()}
    system = np.concatenate([parts[i] for i in range(_CHUNKS)])
    penalty = np.eye(count) * ridge * n / features
    penalty[-1, -1] = 1e-9 * n
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    ready = Model(start.mean, scale, turn, shift, weights, flat)

    @pandas_udf("double")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series(ready.raw(np.stack(part.to_numpy())) if len(part) else np.empty(0))

    place = F.floor((F.least(F.greatest(F.col("r"), F.lit(-1.0)), F.lit(2.0)) + 1) / 3 * (bins - 1))
    binned = rows.select(raw("stats").alias("r"), "y").groupBy(place.alias("bin"))
    found = sorted((r.x, r.good, r.n) for r in binned.agg(F.avg("r").alias("x"), F.avg("y").alias("good"), F.count("y").alias("n")).collect())
    x, y, w = (np.array(c, np.float64) for c in zip(*found, strict=True))
    return Model(start.mean, scale, turn, shift, weights, isotonic(x, y, w))


def quality(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, learnt from its labelled rows that are not held out.

    Texts are read once: their statistics are written, labels are joined with
    these (not with texts), and scores are computed from them. Null texts count
    as empty; repeated rows score alike; labels other than 0 and 1 and rows
    without an id are not learnt from; other columns are not read.
    """
    stats = saved(docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("stats")), "statistics")
    given = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    rows = saved(stats.where(~held_out()).join(given, "doc_id").select("stats", "y"), "quality-rows")
    model = train(rows)
    scored = stats.select("doc_id", model.score(F.col("stats")).alias("score"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
