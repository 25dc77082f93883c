"""Mixing of sources to target weights by capped water-filling and seeded repetitions.

All sources together are to give ``share`` times the words of the corpus, in proportion to
their weights. A source whose part exceeds ``max_epochs`` times its size is clamped there; the
excess goes to the others by weight, until none is above. A document is then taken as often as
its source's target holds the source completely, and once more if it comes early enough in a
seeded order of its source for the rest of the target.

Defined results
    A null or blank text has size 0 and adds nothing. A null source is a source of its own.
    Rows equal in id and size share their place in the order, so repeated rows are taken alike.
    A null id is ordered like an empty one. An empty table gives an empty result. Columns other
    than the named ones are carried along by ``mix`` and may have any names that do not start
    with ``__mix_``.

Scale
    Only the per-source table (a row for each source) is ordered in one task. The place of the
    cut in a source's order is found from sums over hash ranges, then inside the single range
    that holds it, so no source is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3.0
SEED = 7
RANGE_DIGITS = 4  # hex digits of the order that name a range: 65,536 ranges in each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_place(key: Column, seed: int) -> Column:
    """A pseudo-random order of ids, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def cycled_weight(source: Column) -> Column:
    """Weights 1, 2, 3, repeating, by code point with null last; over distinct sources."""
    place = F.row_number().over(Window.orderBy(source.asc_nulls_last()))
    return ((place - 1) % 3 + 1).cast("bigint")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Add ``target`` to a table of (source, source_size, weight), one row for each source.

    Sources are filled in the order in which they reach their limits: a source is clamped if its
    limit lies below its part of what the sources clamped before it leave over.
    """
    everything = Window.partitionBy()
    limit = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    filled = sources.withColumn("__mix_total", total).withColumn(
        "__mix_clamped",
        limit
        <= F.col("weight")
        * (F.col("__mix_total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    clamped = F.col("__mix_clamped")
    held = F.coalesce(F.sum(F.when(clamped, limit)).over(everything), F.lit(0.0))
    free = F.sum(F.when(~clamped, F.col("weight"))).over(everything)
    level = (F.col("__mix_total") - held) / free
    target = F.when(clamped, limit).otherwise(F.col("weight") * level)
    return filled.withColumn("target", target).drop("__mix_total", "__mix_clamped")


def draw_plan(
    sized: DataFrame,
    weight=cycled_weight,
    max_epochs: float = MAX_EPOCHS,
    share: float = 1.0,
) -> DataFrame:
    """One row for each source: target, whole repetitions, and where its fraction ends.

    ``sized`` has source, size, __mix_place and __mix_key (place, id, size).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(totals.withColumn("weight", weight(F.col("source"))), max_epochs, share)
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    plan = stored(
        targets.withColumn("whole", whole).withColumn(
            "rest", F.col("target") - F.col("whole") * F.col("source_size")
        ),
        "mix-targets",
    )
    in_range = F.substring("__mix_place", 1, RANGE_DIGITS).alias("range")
    ranges = sized.groupBy("source", in_range).agg(F.sum("size").alias("range_size"))
    upto = F.sum("range_size").over(Window.partitionBy("source").orderBy("range"))
    reached = ranges.withColumn("upto", upto).alias("r").join(
        plan.select(F.col("source").alias("plan_source"), "rest"),
        F.col("source").eqNullSafe(F.col("plan_source")),
    )
    cut = stored(
        reached.where(
            (F.col("upto") - F.col("range_size") <= F.col("rest")) & (F.col("rest") < F.col("upto"))
        ).select("plan_source", "rest", F.col("range").alias("cut"), (F.col("upto") - F.col("range_size")).alias("held")),
        "mix-ranges",
    )
    # Within the range of the cut, rows up to the one whose middle passes the target are taken.
    in_order = Window.partitionBy("source").orderBy("__mix_key")
    inside = (
        sized.withColumn("range", in_range)
        .join(cut, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("range") == F.col("cut")))
        .withColumn("__mix_upto", F.col("held") + F.sum("size").over(in_order))
        .where(F.col("__mix_upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy(F.col("source").alias("last_source"))
        .agg(F.max("__mix_key").alias("last"))
    )
    return stored(
        plan.join(cut.select("plan_source", "cut"), F.col("source").eqNullSafe(F.col("plan_source")), "left")
        .join(inside, F.col("source").eqNullSafe(F.col("last_source")), "left")
        .select("source", "source_size", "target", "whole", "cut", "last"),
        "mix-plan",
    )


def with_size(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Add size, place in the seeded order, and the key that breaks its ties."""
    placed = docs.withColumn("size", word_count(F.col(text))).withColumn(
        "__mix_place", seeded_place(F.col(key), seed)
    )
    return placed.withColumn("__mix_key", F.struct("__mix_place", F.col(key).alias("id"), "size"))


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Add how often each row is taken. The plan is broadcast only where its files are small."""
    own = plan.select(
        F.col("source").alias("__mix_source"),
        F.col("source_size").alias("__mix_source_size"),
        F.col("target").alias("__mix_target"),
        F.col("whole").alias("__mix_whole"),
        F.col("cut").alias("__mix_cut"),
        F.col("last").alias("__mix_last"),
    )
    at = F.substring("__mix_place", 1, RANGE_DIGITS)
    once_more = F.col("__mix_cut").isNotNull() & (
        (at < F.col("__mix_cut"))
        | ((at == F.col("__mix_cut")) & F.coalesce(F.col("__mix_key") <= F.col("__mix_last"), F.lit(False)))
    )
    return sized.join(own, F.col("source").eqNullSafe(F.col("__mix_source")), "left").withColumn(
        "__mix_copies", F.col("__mix_whole") + F.coalesce(once_more, F.lit(False)).cast("bigint")
    )


def mix_report(
    docs: DataFrame,
    max_epochs: float = MAX_EPOCHS,
    share: float = 1.0,
    seed: int = SEED,
    weight=cycled_weight,
) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken."""
    sized = stored(
        with_size(docs.select("doc_id", "source", "text"), seed=seed).drop("text"), "mix-sizes"
    )
    mixed = with_copies(sized, draw_plan(sized, weight, max_epochs, share))
    return mixed.select(
        "doc_id",
        "size",
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("size") * F.col("__mix_copies")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    max_epochs: float = MAX_EPOCHS,
    share: float = 1.0,
    seed: int = SEED,
    weight=cycled_weight,
) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, columns unchanged."""
    sized = stored(
        with_size(docs.select("doc_id", "source", "text"), seed=seed).drop("text"), "mix-sizes"
    )
    plan = draw_plan(sized, weight, max_epochs, share)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row")
    placed = docs.select(own, F.col("source"), F.col("doc_id"), F.col("text"))
    copies = with_copies(with_size(placed, seed=seed).drop("text"), plan)
    repeated = copies.select("__mix_row", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies").cast("int"))))
    return repeated.select("__mix_row.*")
