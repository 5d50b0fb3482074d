"""Token ids in training order: packed sequences, a keyed permutation of them, and shards of fixed stride.

Documents are tokenised once and packed, with an end mark after each, into
sequences of one length. All sequences have an index; a keyed Feistel
permutation maps it to the slot at which training reads the sequence. A shard
is a range of slots: one task gathers it, sorts it and writes one file in which
every sequence takes the same number of bytes, so the file and place of a slot
follow by division and a reader can resume at any of them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.llm.common import NO_ID, order_id, saved
from clausemill.session import work_dir

#: Tokens of a sequence, sequences of a shard file, sequences that one task holds before it writes them.
LENGTH, SHARD_SEQUENCES, BLOCK_SEQUENCES = 4096, 8192, 256
#: Input partitions whose counts, 16 bytes each, are broadcast; more are joined by a shuffle.
MAX_BROADCAST_PARTS = 1_000_000
#: Characters that are tokenised together; a text is cut where no token can cross.
_BLOCK = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ROUNDS = 6
_U = np.uint64


@dataclass(frozen=True)
class Vocabulary:
    """Byte-level BPE ranks as bytes (lines of a base64 token and its rank); ``end`` is the free id of the end mark."""

    ranks: bytes
    pattern: str
    end: int

    @classmethod
    def public(cls, name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None, end: int = 50_256) -> Vocabulary:
        """The vocabulary file at ``path``, by default that of the installed public tokenizers called ``name``."""
        import public_tokenizers

        with open(path or public_tokenizers.path(name), "rb") as file:
            return cls(file.read(), public_tokenizers.PATTERN, end)

    def encoding(self) -> tiktoken.Encoding:
        return _encoding(self.ranks, self.pattern)


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def encoded(text: str | None, vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """The tokens of a text, a stretch at a time, and the end mark."""
    encode, text, at = vocabulary.encoding().encode_ordinary, text or "", 0
    while at < len(text):
        cut = _CUT.search(text, at + _BLOCK) if at + _BLOCK < len(text) else None
        to = cut.start() if cut else len(text)
        yield np.array(encode(text[at:to] if at or to < len(text) else text), np.uint16)
        at = to
    yield np.array([vocabulary.end], np.uint16)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. ``n`` - 1 puts each index.

    A Feistel network permutes the smallest square power of two that holds
    ``n``; what falls outside walks on along its cycle until it is inside,
    which takes four steps on average at most.
    """
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask, x = _U((1 << half) - 1), np.array(index, np.uint64)
    keys = [_U((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) % (1 << 64)) for r in range(1, _ROUNDS + 1)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> _U(half), v & mask
        for k in keys:
            h = (right + k) * _U(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> _U(31))) * _U(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> _U(29))) & mask)
        return left << _U(half) | right

    x = once(x)
    outside = np.flatnonzero(x >= _U(n))
    while len(outside):
        x[outside] = once(x[outside])
        outside = outside[x[outside] >= _U(n)]
    return x.astype(np.int64)


_PIECES = "doc_ids array<long>, starts array<int>, sizes array<int>, origins array<long>"


def packed(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH, block_sequences: int = BLOCK_SEQUENCES) -> DataFrame:
    """Blocks of packed sequences: ``part, first, n, tokens``, and the pieces of documents in them.

    A task packs the documents of its input partition one after another and
    fills up its last sequence with end marks; ``first`` numbers a part's
    sequences. Pieces are given by document, place in the block, size, and
    place in the document. Tokens are 16 bits, compressed by block.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, room = TaskContext.get().partitionId(), 0, length * block_sequences
        held, size, pieces = [], 0, []
        squeeze = zstandard.ZstdCompressor(level=3)

        def block(n: int) -> pd.DataFrame:
            tokens = np.concatenate(held)
            tokens = np.append(tokens, np.full(n * length - len(tokens), vocabulary.end, np.uint16))
            columns = [list(c) for c in zip(*pieces, strict=True)]
            names = ["doc_ids", "starts", "sizes", "origins"]
            row = {"part": part, "first": first, "n": n, "tokens": squeeze.compress(tokens.tobytes())}
            return pd.DataFrame([row | dict(zip(names, columns, strict=True))])

        for frame in frames:
            for doc, text in zip(frame["doc"], frame["text"], strict=True):
                origin = 0
                for tokens in encoded(text, vocabulary):
                    while len(tokens):
                        taken = tokens[: room - size]
                        held.append(taken)
                        if pieces and pieces[-1][0] == doc and origin and pieces[-1][3] + pieces[-1][2] == origin:
                            pieces[-1][2] += len(taken)
                        else:
                            pieces.append([doc, size, len(taken), origin])
                        size, origin, tokens = size + len(taken), origin + len(taken), tokens[len(taken) :]
                        if size == room:
                            yield block(block_sequences)
                            first, held, size, pieces = first + block_sequences, [], 0, []
        if size:
            yield block(-(-size // length))

    source = docs.select(order_id().alias("doc"), F.col("text").alias("text"))
    return saved(source.mapInPandas(pack, "part int, first long, n int, tokens binary, " + _PIECES), "packed")


@dataclass(frozen=True)
class Shards:
    """``path`` holds ``count`` shard files of ``sequences`` slots for ``index``; ``stride`` bytes are a sequence and a line feed."""

    path: str
    count: int
    total: int
    length: int
    sequences: int
    index: DataFrame

    @property
    def stride(self) -> int:
        return 2 * self.length + 1


def write_shards(
    docs: DataFrame,
    vocabulary: Vocabulary,
    *,
    key: int = 20_240_601,
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
    block_sequences: int = BLOCK_SEQUENCES,
    path: str | None = None,
) -> Shards:
    """Writes ``docs`` (``doc_id, text``) as shards below ``path``, by default a fresh folder in the shared one.

    Token ids must fit in 16 bits. A sequence is ``length`` little-endian ids
    and a line feed; file n holds the slots from n x ``shard_sequences`` on, in
    order. Spark's own writer commits the files, so a lost executor or a task
    run twice leaves no half of one. ``index`` has a row per sequence: ``slot,
    shard, byte_offset, n_tokens`` (without padding) and, in lists that run in
    step, the ``doc_ids`` in it with their ``starts``, ``sizes`` and ``origins``
    (the place in the document's tokens). Null and empty texts are an end mark;
    rows without an id have a null in ``doc_ids``; repeated rows are packed each.
    Equal input partitions and keys give equal shards. An empty table writes none.
    """
    if vocabulary.end >= 1 << 16:
        raise ValueError("token ids must fit in 16 bits")
    spark = docs.sparkSession
    blocks = packed(docs, vocabulary, length, block_sequences)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    total, n_parts = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases) if n_parts <= MAX_BROADCAST_PARTS else bases, "part")
    count = -(-total // shard_sequences)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze, widen = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for frame in frames:
            for base, first, n, tokens in zip(frame["base"], frame["first"], frame["n"], frame["tokens"], strict=True):
                raw = memoryview(widen.decompress(tokens))
                slots = permuted(np.arange(base + first, base + first + n), total, key)
                step = 2 * length
                yield pd.DataFrame({"slot": slots, "tokens": [squeeze.compress(raw[i * step : (i + 1) * step]) for i in range(n)]})

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        widen = zstandard.ZstdDecompressor()
        for frame in frames:
            for at in range(0, len(frame), 512):
                yield pd.DataFrame({"tokens": [widen.decompress(t) for t in frame["tokens"].iloc[at : at + 512]]})

    path = path or work_dir(spark, "shards")
    dealt = placed.select("base", "first", "n", "tokens").mapInPandas(deal, "slot long, tokens binary")
    shard = F.expr(f"cast(slot div {shard_sequences} as int)")
    if count:
        ordered = dealt.repartitionById(count, shard).sortWithinPartitions("slot").select("tokens")
        raw = ordered.mapInPandas(unpack, "tokens binary").select(F.col("tokens").cast("string"))
        raw.write.option("lineSep", "\n").option("compression", "none").text(path)

    def list_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                slots = permuted(np.arange(row.base + row.first, row.base + row.first + row.n), total, key)
                starts, sizes = np.asarray(row.starts, np.int64), np.asarray(row.sizes, np.int64)
                ends, out = starts + sizes, []
                for i, slot in enumerate(slots.tolist()):
                    lo, hi = i * length, (i + 1) * length
                    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
                    begin, end = np.maximum(starts[a:b], lo), np.minimum(ends[a:b], hi)
                    origins = np.asarray(row.origins[a:b], np.int64) + begin - starts[a:b]
                    out.append((slot, int((end - begin).sum()), list(row.doc_ids[a:b]), list(begin - lo), list(end - begin), list(origins)))
                yield pd.DataFrame(out, columns=["slot", "n_tokens", "doc_ids", "starts", "sizes", "origins"])

    pieces = placed.drop("tokens", "part").mapInPandas(list_pieces, "slot long, n_tokens int, " + _PIECES)
    stride = 2 * length + 1
    index = pieces.select(
        "slot",
        shard.alias("shard"),
        ((F.col("slot") % shard_sequences) * stride).alias("byte_offset"),
        "n_tokens",
        F.transform("doc_ids", lambda d: F.when(d != NO_ID, d)).alias("doc_ids"),
        "starts",
        "sizes",
        "origins",
    )
    return Shards(path, count, total, length, shard_sequences, index)


def read_shards(spark: SparkSession, shards: Shards, first_slot: int = 0) -> DataFrame:
    """``slot, tokens`` from the files alone, in slots from ``first_slot`` on; earlier shards are not opened."""
    files = spark.read.format("binaryFile").load(shards.path)
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("long")
    wanted = files.select(number.alias("shard"), "content").where(F.col("shard") >= first_slot // shards.sequences)
    stride, per, size = shards.stride, shards.sequences, 2 * shards.length

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, content in zip(frame["shard"], frame["content"], strict=True):
                skip = max(0, first_slot - shard * per)
                for at in range(skip, len(content) // stride, 1024):
                    to = min(at + 1024, len(content) // stride)
                    rows = [content[i * stride : i * stride + size] for i in range(at, to)]
                    yield pd.DataFrame({"slot": np.arange(at, to) + shard * per, "tokens": rows})

    return wanted.mapInPandas(cut, "slot long, tokens binary")
