"""Dense numbers and running sums in sort order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored

ROW_BITS = 33  # of Spark's increasing ids; the bits above hold the partition


def numbered(df: DataFrame, order: list[str], name: str = "number", first: int = 0) -> DataFrame:
    """Append ``name``: consecutive numbers from ``first`` in the order of the columns.

    The rows are cut into ranges and sorted within them, and written with their place in the
    range. Only the number of rows of each range comes to the driver, one for each partition;
    a range's numbers begin where those of the ranges before it end. Equal rows get numbers
    next to each other; one value that fills a range makes this range as large as itself.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__place", ROW_BITS)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, before = {}, first
    for range_number, size in sizes:
        starts[range_number] = before
        before += size
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("bigint")).drop("__place")
    table = F.array(*[F.lit(starts.get(i, 0)).cast("bigint") for i in range(max(starts) + 1)])
    inside = F.col("__place").bitwiseAND((1 << ROW_BITS) - 1)
    return placed.withColumn(name, F.get(table, part.cast("int")) + inside).drop("__place")


def sorted_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``range``, written in ranges of the order that are cut at quantiles of a sample."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    return stored(cut, "ranges")


def with_sum_before(ranged: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Append the sum of ``value`` over all rows that sort before each row of ``sorted_ranges``.

    Sums run within each range; what the ranges before it hold is carried on, one number a range. The
    rows should be distinct in the order's columns.
    """
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum(value).alias("n")).collect())
    carried, total = {}, 0
    for place, n in sums:
        carried[place] = total
        total += n or 0
    table = F.array(*[F.lit(carried.get(i, 0)).cast("bigint") for i in range(max(carried, default=0) + 1)])
    return ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.get(table, F.col("range")))
