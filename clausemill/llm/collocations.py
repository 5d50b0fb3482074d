"""Phrase collocations by prefix-free parsing: n-grams are counted in a dictionary of chunks, not in the texts.

A text is parsed into chunks wherever a window of its words hashes to a trigger,
so equal passages fall into equal chunks wherever they stand. Chunks overlap by
that window: the words before it begin n-grams of this chunk, those of the
window itself n-grams of the next one, so each n-gram is counted once. The
dictionary holds every distinct chunk with its frequency, which weighs the
n-grams in it. Longer n-grams are counted only where both shorter ones in them
are frequent enough.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import saved

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: One window of words in so many is a trigger; a chunk without one is cut after so many words.
TRIGGER, CHUNK_WORDS = 16, 256
#: What is known of frequent n-grams goes to every task as so many bits, whatever their number.
FILTER_BITS = 26
#: Texts are parsed, and chunks counted, so many bytes at a time.
_BLOCK = 1 << 21
#: Small letters for A-Z, a blank for tabs (and 255, no UTF-8), and a line feed for all that ends a piece.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 255) else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_BLANK, _BREAK, _TEXT = 32, 10, 255
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)


class Words:
    """The words of some texts (joined by 255, which UTF-8 has not), one separator each: a blank, or a break of pieces or texts."""

    def __init__(self, blob: bytes):
        raw = np.frombuffer(blob, np.uint8)
        inside = (raw != _BLANK) & (raw != _BREAK) & (raw != _TEXT)
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        begins, ends = edges[::2], edges[1::2]
        sizes = ends - begins
        text = np.cumsum(raw == _TEXT)
        lines = np.cumsum(raw == _BREAK)
        self.text, line = text[begins], lines[begins]
        data, self.n = raw.copy(), len(begins)
        if self.n:
            apart = np.where(np.diff(self.text) > 0, _TEXT, np.where(np.diff(line) > 0, _BREAK, _BLANK))
            data[begins[1:] - 1] = apart
            inside[begins[1:] - 1] = True
        self.data = data[inside].tobytes()
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes

    def hashes(self) -> np.ndarray:
        return _hashes(self.data, self.starts, self.ends)


def _hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word from its length, first and last eight bytes; equal words have equal ones, some others too."""
    padded = b"".join((bytes(8), data, bytes(8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    spare = _U(8) * (8 - np.minimum(sizes, 8)).astype(np.uint64)
    head, tail = eight[starts + 8] << spare, eight[ends] >> spare
    return _mixed(head + _mixed(tail + sizes.astype(np.uint64)))


def _chunks(words: Words, overlap: int, trigger: int, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """``(text, chunk, whether it ends the text)``; a chunk that does not end its text ends with the window that opens the next."""
    n = words.n
    if not n:
        return
    h, window = words.hashes(), np.zeros(n, np.uint64)
    for i in range(overlap):
        window[: n - i] = _mixed(window[: n - i] + h[i:])
    fresh = np.r_[True, words.text[1:] != words.text[:-1]]
    firsts = np.flatnonzero(fresh)
    stop = np.repeat(np.r_[firsts[1:], n], np.diff(np.r_[firsts, n]))
    room = np.arange(n) + overlap <= stop
    begins = np.flatnonzero(fresh | (room & (window % _U(trigger) == 0)))
    gaps = np.diff(np.r_[begins, n])
    if (gaps > most).any():
        long = gaps > most
        extra = np.concatenate([np.arange(b + most, b + g, most) for b, g in zip(begins[long], gaps[long], strict=True)])
        begins = np.sort(np.r_[begins, extra[room[extra]]])
    after = np.r_[begins[1:], n]
    last = np.r_[fresh[begins[1:]], True]
    ends = words.ends[np.where(last, after, after + overlap) - 1]
    data = words.data
    for text, a, b, z in zip(words.text[begins].tolist(), words.starts[begins].tolist(), ends.tolist(), last.tolist(), strict=True):
        yield text, data[a:b], z


def parse(texts: list[bytes], *, overlap: int = MAX_WORDS - 1, trigger: int = TRIGGER, most: int = CHUNK_WORDS, block: int = _BLOCK):
    """``(position of the text, chunk, whether it ends its text)`` of all chunks.

    Short texts are parsed together, a long one piecemeal: its last chunk so far
    is parsed again with the next piece, which begins at a separator.
    """
    held, size = [], 0

    def together():
        for text, chunk, last in _chunks(Words(bytes([_TEXT]).join(t for _, t in held)), overlap, trigger, most):
            yield held[text][0], chunk, last

    for at, text in enumerate(texts):
        folded = text.translate(_FOLD)
        if len(folded) >= block:
            rest, done = b"", 0
            while done < len(folded):
                stop = min(done + block, len(folded))
                if stop < len(folded):
                    ends = [i for i in (folded.find(b" ", stop), folded.find(b"\n", stop)) if i >= 0]
                    stop = min(ends) if ends else len(folded)
                part = list(_chunks(Words(rest + folded[done:stop]), overlap, trigger, most))
                done, rest = stop, b""
                if done < len(folded) and part:
                    rest = part.pop()[1]
                for _, chunk, last in part:
                    yield at, chunk, last
            continue
        held.append((at, folded))
        size += len(folded)
        if size >= block:
            yield from together()
            held, size = [], 0
    if held:
        yield from together()


def dictionary(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, chunk, tail, f``: the distinct chunks of all texts per language (255 behind each) and how often the parse holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            found, size = ([], [], []), 0
            for at, chunk, last in parse(texts, overlap=max_words - 1):
                for column, value in zip(found, (langs[at], chunk, last), strict=True):
                    column.append(value)
                size += len(chunk)
                if size >= 4 * _BLOCK:
                    yield _batch(*found)
                    found, size = ([], [], []), 0
            yield _batch(*found)

    def _batch(langs, chunks, tails):
        chunks = [c + b"\xff" for c in chunks]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()), pa.array(tails, pa.bool_())], ["lang", "chunk", "tail"])

    texts = docs.select(_lang().alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    chunks = texts.mapInArrow(run, "lang string, chunk binary, tail boolean")
    return chunks.groupBy("lang", "chunk", "tail").agg(F.count(F.lit(1)).alias("f"))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def _slots(lang: str, hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bit of the filter for the n words from each place on (all but the last n - 1 places)."""
    m = len(hashes) - n + 1
    state = np.full(m, xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for i in range(n):
        state = _mixed(state * _U(0x9E3779B97F4A7C15) + hashes[i : i + m])
    return (state >> _U(64 - bits)).astype(np.int64)


def _edges(blob: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in parsed texts each followed by one separator, and those separators."""
    raw = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero((raw == _BLANK) | (raw == _BREAK) | (raw == _TEXT))
    return np.r_[0, ends[:-1] + 1], ends, raw[ends]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    for lang in pc.unique(batch["lang"]).to_pylist():
        yield lang, batch.filter(pc.equal(batch["lang"], lang))


def _filter(grams: DataFrame, n: int, bits: int) -> np.ndarray:
    """A bitmap of fixed size in which the bit of every n-gram of ``grams`` (``lang, phrase``) is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_lang(batch):
                blob = b" ".join(part["phrase"].to_pylist()) + b" "
                starts, ends, _ = _edges(blob)
                slots = _slots(lang, _hashes(blob, starts, ends), n, bits)[::n] + 1
                yield pa.RecordBatch.from_arrays([pa.array(slots)], ["slot"])

    slots = grams.select("lang", "phrase").mapInArrow(run, "slot long")
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        held = np.frombuffer(row.bits, np.uint8)
        at = (row.part - 1) * len(held)
        out[at : at + len(held)] = held[: len(out) - at]
    return out


def _set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def grams(
    lang: str, blob: bytes, tails: np.ndarray, weights: np.ndarray, n: int, overlap: int, bitmap: np.ndarray | None
) -> tuple[list[bytes], np.ndarray]:
    """The distinct n-grams of some chunks (``blob``, each with 255 behind it) and their weighted counts; without those
    whose parts the filter of (n - 1)-grams shows to be rare. Words are compared themselves, not by hashes."""
    starts, ends, after = _edges(blob)
    size = len(starts)
    if size < n:
        return [], np.empty(0, np.int64)
    closing = np.flatnonzero(after == _TEXT)
    chunk = np.repeat(np.arange(len(closing)), np.diff(np.r_[-1, closing]))
    fits = tails[chunk] | (closing[chunk] - np.arange(size) >= overlap)
    if n > 1:
        held = fits[: size - n + 1]
        for i in range(n - 1):
            held &= after[i : size - n + 1 + i] == _BLANK
        known = np.append(_set(bitmap, _slots(lang, _hashes(blob, starts, ends), n - 1, FILTER_BITS)), False)
        held &= known[: len(held)] & known[1 : len(held) + 1]
        at = np.flatnonzero(held)
    else:
        at = np.flatnonzero(fits)
    if not len(at):
        return [], np.empty(0, np.int64)
    if n > 2:  # few are left
        phrases = np.empty(len(at), object)
        phrases[:] = [blob[a:b] for a, b in zip(starts[at].tolist(), ends[at + n - 1].tolist(), strict=True)]
        key, distinct = pd.factorize(phrases)
        return distinct.tolist(), _summed(key, weights[chunk[at]], len(distinct))
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    words = blob[:-1].replace(b"\n", b" ").replace(b"\xff", b" ").split(b" ")
    key = np.fromiter(map(vocabulary.__getitem__, words), np.int64, size)
    if n == 1:
        counts = _summed(key[at], weights[chunk[at]], len(vocabulary))
        return [w for w, c in zip(vocabulary, counts.tolist(), strict=True) if c], counts[counts > 0]
    key, distinct = pd.factorize(key[at] << 32 | key[at + 1])
    counts, some = _summed(key, weights[chunk[at]], len(distinct)), np.empty(len(distinct), np.int64)
    some[key] = at
    return [blob[a:b] for a, b in zip(starts[some].tolist(), ends[some + 1].tolist(), strict=True)], counts


def _summed(key: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers; doubles hold them up to 2^53, far beyond what a block can reach."""
    return np.bincount(key, weights, n).astype(np.int64)


def counted(chunks: DataFrame, n: int, shorter: DataFrame | None, overlap: int) -> DataFrame:
    """``lang, phrase, f``: the n-grams in a dictionary whose (n - 1)-grams are among ``shorter``, and perhaps some others."""
    bitmap = _filter(shorter, n - 1, FILTER_BITS) if shorter is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                rows = pa.Table.from_batches(parts)
                blob = b"".join(rows["chunk"].to_pylist())
                phrases, counts = grams(lang, blob, rows["tail"].to_numpy(), rows["f"].to_numpy(), n, overlap, bitmap)
                for i in range(0, len(phrases), 1 << 16):
                    part = phrases[i : i + (1 << 16)]
                    columns = [pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array(counts[i : i + (1 << 16)])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

        for batch in batches:
            for lang, part in _by_lang(batch):
                held.setdefault(lang, []).append(part)
            size += batch["chunk"].nbytes
            if size >= 4 * _BLOCK:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    found = chunks.mapInArrow(run, "lang string, phrase binary, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of the phrases of up to ``max_words`` words with f >= ``min_count``, and ``lang, n``."""
    overlap = max_words - 1
    chunks = saved(dictionary(docs, max_words), "chunks")
    every = saved(counted(chunks, 1, None, overlap), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    level = every.where(F.col("f") >= min_count)
    frequent = level.withColumn("words", F.lit(1))
    for n in range(2, max_words + 1):
        level = saved(counted(chunks, n, level, overlap).where(F.col("f") >= min_count), "phrases")
        frequent = frequent.unionByName(level.withColumn("words", F.lit(n)))
    return frequent.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f"), totals


def collocations(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language whose words keep together best.

    Texts (A-Z lowered) fall into pieces at ``. , ; : ! ?`` and line ends, and
    those into words at blanks and tabs. A phrase is 2 to ``max_words`` words in
    a row within a piece that occur ``min_count`` times or more in the language
    (null is ``und``), overlaps included. Cutting it in two gives a score of
    2000000 a div (l + r), with a, l and r the counts of the phrase and its
    parts; the lowest cut counts, the first of equal ones. A phrase inside a
    longer one that occurs at least 0.8 times as often is left out. The ``top``
    phrases of a language stand, by score, then a, then the phrase's bytes; n
    counts the language's words. Null, empty and wordless texts add nothing; an
    empty table gives no rows; repeated rows count each; other columns are not
    read, nor is the id.
    """
    frequent, totals = phrase_counts(docs, min_count=min_count, max_words=max_words)
    parts = F.split("phrase", " ")

    def joined(first: Column | int, size: Column) -> Column:
        return F.array_join(F.slice(F.col("_w"), first, size), " ")

    phrases = frequent.where("words > 1").withColumn("_w", parts)
    cuts = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined(1, F.col("k")).alias("_l"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("_r")
    )
    counts = frequent.select("lang", F.col("phrase").alias("_p"), "f")
    left = counts.select("lang", F.col("_p").alias("_l"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("_p").alias("_r"), F.col("f").alias("r"))
    score = F.expr("cast(2000000 * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r) as long)")
    scored = cuts.join(left, ["lang", "_l"]).join(right, ["lang", "_r"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: joined(i, m)),
        )
    )
    inside = phrases.where("words > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    held = F.expr("_f is not null and 100 * cast(_f as decimal(19, 0)) >= 80 * cast(a as decimal(19, 0))")
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(~held)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
