"""Exact quantiles without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored

BINS = 4096  # of a bracket in one round of narrowing
MAX_ROUNDS = 200  # far above what the range of doubles asks for


def _place(total: Column, q: Column) -> Column:
    return (total - 1) * q


def _interpolated(by: list[str], ends: DataFrame, value: str) -> DataFrame:
    """From (by, q, place, lower, upper) to the quantile."""
    part = F.col("__place") - F.floor("__place")
    between = F.col("__lower") + (F.col("__upper") - F.col("__lower")) * part
    return ends.select(*by, "q", F.when(part == 0, F.col("__lower")).otherwise(between).alias(value))


def _asked(probabilities: list[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))


def quantiles_of_counts(counts: DataFrame, by: list[str], value: str, uses: str, probabilities: list[float]) -> DataFrame:
    """Linearly interpolated quantiles per group of values with their numbers of uses.

    One plan, for values of a small domain such as ratings: the distinct values of a group meet
    in one window. Columns ``by``, ``q`` and ``value``.
    """
    running = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.select(*by, F.col(value).cast("double").alias("__v"), F.col(uses).alias("__n")).where("__v IS NOT NULL")
    upto = upto.withColumn("__upto", F.sum("__n").over(running)).withColumn("__total", F.sum("__n").over(Window.partitionBy(*by)))
    asked = upto.withColumn("q", _asked(probabilities)).withColumn("__place", _place(F.col("__total"), F.col("q")))

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__n") <= k) & (k < F.col("__upto")), F.col("__v")))

    ends = asked.groupBy(*by, "q").agg(
        F.first("__place").alias("__place"), at(F.floor("__place")).alias("__lower"), at(F.ceil("__place")).alias("__upper")
    )
    return _interpolated(by, ends, value)


def _bin(v: Column, low: Column, high: Column) -> Column:
    """0 at the lower end, ``BINS`` at the upper, and steps of equal width between; never decreasing.

    Halves, so that the width of a bracket stays finite; with an infinite end all inner values share a bin.
    """
    share = F.nanvl((v / 2 - low / 2) / (high / 2 - low / 2), F.lit(0.0))
    inner = F.least(F.greatest(F.floor(share * (BINS - 1)), F.lit(0)), F.lit(BINS - 2)) + 1
    return F.when(v == low, 0).when(v == high, BINS).otherwise(inner).cast("int")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Linearly interpolated quantiles per group: columns ``by``, ``q`` and ``value``.

    Selection by narrowing histograms, for all groups and places at once. The rows are reduced to
    distinct values with their uses first. A place is sought in a bracket of values; each round counts
    the bracket's values in ``BINS`` steps with a combine before the shuffle, and goes on with the least
    and greatest value of the step that holds the place, until they are equal. The only windows run over
    the steps, of which there are at most ``BINS`` + 1 whatever the size of the group.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL")
    counts = stored(rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")), "value-counts")
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    asked = stored(totals.withColumn("q", _asked(probabilities)).withColumn("__place", _place(F.col("__total"), F.col("q"))), "places")
    places = F.array(F.floor("__place"), F.ceil("__place"))
    brackets = stored(
        asked.select(*by, F.explode(places).alias("__k"), "__low", "__high", F.lit(0).cast("bigint").alias("__before")).distinct(), "brackets"
    )
    keys = [f"__by{i}" for i in range(len(by))]
    same = [F.col(key).eqNullSafe(F.col(c)) for key, c in zip(keys, by, strict=True)]
    for _ in range(MAX_ROUNDS):
        open_ = brackets.where("__low < __high")
        if open_.isEmpty():
            break
        sought = open_.select(*[F.col(c).alias(key) for key, c in zip(keys, by, strict=True)], "__k", "__low", "__high", "__before")
        inside = counts.join(sought, [*same, F.col("__v").between(F.col("__low"), F.col("__high"))])
        steps = inside.groupBy(*keys, "__k", "__before", _bin(F.col("__v"), F.col("__low"), F.col("__high")).alias("__step")).agg(
            F.sum("__n").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
        )
        below = F.sum("__n").over(Window.partitionBy(*keys, "__k").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1))
        placed = steps.withColumn("__below", F.col("__before") + F.coalesce(below, F.lit(0)))
        found = placed.where((F.col("__below") <= F.col("__k")) & (F.col("__k") < F.col("__below") + F.col("__n")))
        narrower = found.select(*[F.col(key).alias(c) for key, c in zip(keys, by, strict=True)], "__k", "__low", "__high", F.col("__below").alias("__before"))
        brackets = stored(brackets.where("__low = __high").unionByName(narrower), "brackets")
    else:
        raise RuntimeError("brackets did not close")
    values = brackets.select(*[F.col(c).alias(key) for key, c in zip(keys, by, strict=True)], "__k", F.col("__low").alias("__value"))
    unfolded = asked.withColumn("__k", F.explode(F.array_distinct(places))).withColumnRenamed("__k", "__at")
    ends = unfolded.join(values, [*same, F.col("__at") == F.col("__k")]).groupBy(*by, "q").agg(
        F.first("__place").alias("__place"), F.min("__value").alias("__lower"), F.max("__value").alias("__upper")
    )
    return _interpolated(by, ends, value)
