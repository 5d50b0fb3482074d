"""Mixing sources to target weights with fixed-length blocks.

The words of each source, its documents one after another in a pseudorandom
order, are cut into blocks of ``block_words``. The output is a row of slots in
shards; every shard draws how many slots each source gets. The n-th slot of a
source takes the block that a permutation of the source's blocks puts at n, a
new permutation each time all blocks were taken once. Slots and blocks meet in
one join on (source, block), so no key is hotter than a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.llm.common import WORD, saved, unused

#: A word with the white space before it, and after it at the text's end: joined, they give the text.
_PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"
#: A source's documents are laid out in so many parts, each ordered by itself.
_PARTS_BITS = 12
_ROUNDS = 20
#: Slots that one task unfolds from one row.
_RUN = 1024
SEED = 20_240_601


@dataclass(frozen=True)
class Mix:
    """``rows``: each document with its place; ``sources``: sizes and targets; ``slots``: what each slot takes."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int

    def segments(self) -> DataFrame:
        """The part of each block that each document fills: ``_row, source_no, block, words``."""
        size, n = F.col("size"), self.block_words
        first = F.expr(f"_offset div {n}")
        last = F.expr(f"(_offset + size - 1) div {n}")
        words = F.least(F.col("_offset") + size, (F.col("block") + 1) * n) - F.greatest("_offset", F.col("block") * n)
        return (
            self.rows.where("size > 0")
            .withColumn("block", F.explode(F.sequence(first, last)))
            .select("_row", "source_no", "block", words.alias("words"))
        )


def source_targets(
    sizes: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, size`` with ``source_no, weight, target``: the words each source shall give.

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all words. No target is above ``most`` times its source's
    size: in the order in which sources reach that limit as the common level
    rises, the first one that the rest's level leaves below it sets the level.
    The window over all sources sees one row per source.
    """
    each = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    listed = (
        sizes.withColumn("source_no", F.row_number().over(each).cast("long") - 1)
        .withColumn("weight", pick)
        .withColumn("limit", F.col("size") * F.lit(float(most)))
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    everyone = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = listed.withColumn("level", level)
    reached = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    return levels.withColumn("level", F.first(reached, ignorenulls=True).over(everyone)).select(
        "source",
        "source_no",
        "size",
        "weight",
        F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"),
    )


def _permuted(slots: DataFrame, seed: int) -> DataFrame:
    """``slots`` with ``block``: ``_i`` under a permutation of 0 .. ``blocks`` - 1 for each source and turn.

    Swap-or-not rounds: a round pairs each number with its mirror about a
    keyed point and swaps the pair on a keyed coin, which is a permutation for
    any number of blocks.
    """
    key = [F.lit(seed), F.col("source_no"), F.col("turn")]

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), F.col("blocks")) - x, F.col("blocks"))
        coin = F.xxhash64(*key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, mirror).otherwise(x)

    rounds = F.sequence(F.lit(1), F.lit(_ROUNDS))
    return slots.withColumn("block", F.aggregate(rounds, F.col("_i"), swap)).drop("_i")


def _uniform(*parts: Column) -> Column:
    """A number from 0 below 1 with 53 random bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _draws(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``source_no, blocks, shard, slots``: how many slots of each shard each source gets.

    The whole part of a source's expected number is given; the rest of the
    shard's slots are drawn, a multinomial over the fractions that are left.
    """
    expected = F.col("target") * F.col("blocks") / F.col("size")
    live = sources.where("size > 0 and target > 0").withColumn("expected", expected)
    total = live.agg(F.sum("expected")).first()[0] or 0.0  # one number
    slots = round(total)
    shards = max(1, -(-slots // shard_slots))
    here = F.when(F.col("shard") < shards - 1, F.lit(shard_slots)).otherwise(F.lit(slots - (shards - 1) * shard_slots))
    each = live.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    each = each.withColumn("_mean", here * F.col("expected") / F.lit(total or 1.0))
    each = each.withColumn("slots", F.floor("_mean")).withColumn("_part", F.col("_mean") - F.col("slots"))
    shard = Window.partitionBy("shard")
    upto = shard.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    each = (
        each.withColumn("_upto", F.sum("_part").over(upto))
        .withColumn("_end", F.max("_upto").over(shard))
        .withColumn("_open", here - F.sum("slots").over(shard))
    )
    draws = (
        each.groupBy("shard")
        .agg(F.first("_open").alias("_open"), F.first("_end").alias("_end"))
        .where("_open > 0")
        .withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_open").cast("long"))))
        .select("shard", (_uniform(F.lit(seed), F.col("shard"), F.col("_draw")) * F.col("_end")).alias("_at"))
    )
    # Each draw falls to the first source whose running sum is above it.
    steps = each.select("shard", F.col("_upto").alias("_at"), "source_no").unionByName(draws, allowMissingColumns=True)
    after = Window.partitionBy("shard").orderBy(F.col("_at"), F.col("source_no").isNotNull(), "source_no")
    found = F.first("source_no", ignorenulls=True).over(after.rowsBetween(0, Window.unboundedFollowing))
    extra = (
        steps.withColumn("_to", found)
        .where("source_no is null and _to is not null")
        .groupBy("shard", F.col("_to").alias("source_no"))
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    return each.join(extra, ["shard", "source_no"], "left").select(
        "source_no", "blocks", "shard", (F.col("slots") + F.coalesce("_extra", F.lit(0))).alias("slots")
    )


def _order(seed: int) -> Column:
    """Where a document stands among those of its source; equal for rows that agree in id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))


def mix(
    docs: DataFrame,
    *,
    keep: Sequence[str] = ("doc_id",),
    block_words: int = 128,
    shard_slots: int = 65_536,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = SEED,
) -> Mix:
    """The plan of a mix of ``docs`` (``doc_id, text, source``); ``keep`` names columns to carry in ``rows``.

    A document's size is its number of words; null texts have none, and
    documents without words take no part. Rows without a source form the last
    source. Repeated rows count each by itself; which of two equal rows comes
    first is open, as they are equal. A source's turn ends when all its blocks
    were taken; slots drawn beyond ``most`` turns stay empty, so nothing is
    taken more often. Equal input and seed give the same mix.
    """
    order = _order(seed)
    rows = saved(
        docs.select(
            F.struct(*[F.col(c) for c in keep]).alias("doc"),
            F.col("doc_id").alias("_id"),
            F.col("source").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            order.alias("_order"),
            F.shiftrightunsigned(order, 64 - _PARTS_BITS).alias("_part"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-rows",
    )
    parts = rows.groupBy("source", "_part").agg(F.sum("size").alias("size"))
    sources = source_targets(
        parts.groupBy("source").agg(F.sum("size").alias("size")), weights=weights, share=share, most=most
    ).withColumn("blocks", F.ceil(F.col("size") / F.lit(block_words)))
    sources = saved(sources, "mix-sources")

    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_start"))
    named = sources.select(
        F.col("source").alias("_s"), "source_no", F.col("size").alias("source_size"), "target", "blocks"
    )
    starts = starts.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnsRenamed(
        {"source": "_s", "_part": "_p"}
    )
    inside = Window.partitionBy("source", "_part").orderBy("_order", "_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        .withColumn("_offset", F.col("_start") + F.col("_before"))
        .drop("_s", "_p", "_start", "_before", "_order", "_part", "_id")
    )

    draws = _draws(sources, shard_slots, seed)
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Few rows become many slots: runs of them are dealt out before they unfold.
    end, tasks = F.col("_base") + F.col("slots") - 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (
        draws.withColumn("_base", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
        .where("slots > 0")
        .withColumn("_from", F.explode(F.sequence(F.col("_base"), end, F.lit(_RUN).cast("long"))))
        .withColumn("_to", F.least(end, F.col("_from") + _RUN - 1))
        .repartition(tasks, "source_no", "_from")
        .withColumn("_n", F.explode(F.sequence("_from", "_to")))
        .where(F.col("_n") < F.col("blocks") * most)
        .select(
            "source_no",
            "shard",
            "blocks",
            F.expr("_n div blocks").alias("turn"),
            F.expr("_n % blocks").alias("_i"),
        )
    )
    return Mix(placed, sources, _permuted(slots, seed), block_words)


def taken(plan: Mix) -> DataFrame:
    """Per document ``doc, size, source_size, target`` and ``taken``, the words that the mix takes of it."""
    times = plan.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    sums = (
        plan.segments()
        .join(times.hint("merge"), ["source_no", "block"])
        .groupBy("_row")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    return plan.rows.join(sums, "_row", "left").select(
        "doc", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_documents(docs: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: per slot and document in its block, one row with the columns of ``docs``.

    ``text`` is the stretch of the document that lies in the block, with its
    white space (and ``n_chars``, where there is such a column, its length).
    Rows are in no order; shards are put in order when they are written.
    ``docs`` is read twice, first for the sizes, and must give the same rows
    again: the plan is made without texts, and those join it once. Rows that
    agree in id, text and source lie one after another, so the first place tells
    the places of all.
    """
    name, names = unused(docs, "_key"), ["_order", "_text", "_source", "_none"]
    source = [F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")]
    key = [_order(seed).alias("_order"), F.xxhash64("text").alias("_text"), *source]
    plan = mix(docs.withColumn(name, F.struct(*key)), keep=[name], seed=seed, **options)
    n = plan.block_words
    first, last = F.expr(f"_offset div {n}"), F.expr(f"(_offset + size - 1) div {n}")
    places = plan.rows.where("size > 0").select(f"doc.{name}.*", "source_no", "size", "_offset")
    places = places.groupBy(*names).agg(*[F.min(c).alias(c) for c in ("source_no", "size", "_offset")])
    whole = docs.select(F.struct("*").alias("doc"), *key, F.monotonically_increasing_id().alias("_row"))
    copy = F.row_number().over(Window.partitionBy(*names).orderBy("_row")) - 1
    held = whole.withColumn("_copy", copy).join(places, names).withColumn("_offset", F.col("_offset") + F.col("_copy") * F.col("size"))
    held = held.withColumn("_words", F.regexp_extract_all("doc.text", F.lit(_PIECE), F.lit(0)))
    begin = lambda b: F.greatest(b * n - F.col("_offset"), F.lit(0).cast("long"))
    end = lambda b: F.least((b + 1) * n - F.col("_offset"), F.col("size"))
    piece = lambda b: F.struct(
        b.alias("block"),
        F.array_join(F.slice("_words", (begin(b) + 1).cast("int"), (end(b) - begin(b)).cast("int")), "").alias("text"),
    )
    pieces = held.select(
        "source_no",
        F.col("doc").dropFields("text").alias("doc") if len(docs.columns) > 1 else F.lit(None).alias("doc"),
        F.explode(F.transform(F.sequence(first, last), piece)).alias("piece"),
    ).select("source_no", "doc", F.col("piece.block").alias("block"), F.col("piece.text").alias("text"))
    out = pieces.join(plan.slots.select("source_no", "block").hint("merge"), ["source_no", "block"])
    columns = []
    for c in docs.columns:
        if c.lower() == "text":
            columns.append(F.col("text").alias(c))
        elif c.lower() == "n_chars":
            columns.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"doc.`{c}`").alias(c))
    return out.select(*columns)
