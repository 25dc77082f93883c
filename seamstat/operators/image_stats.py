"""Image statistics: from decoded image rows or from a long pixel table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamstat.schema import IMAGE_FEATURES

# Luminance weights, histogram size and smoothing terms.
RED_WEIGHT, GREEN_WEIGHT, BLUE_WEIGHT = 0.299, 0.587, 0.114
HISTOGRAM_BINS = 32
DENSITY_FLOOR = 1e-12
TONE_FLOOR = 1e-6
# End of fixed values.


TILE = 1024  # pixels along each side of what one task must see together


def _tiled(pixels: DataFrame, tile: int) -> DataFrame:
    """The pixels by tile, each tile with the last column and row of its left and upper neighbours as ``rim``."""
    down, right = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)

    def seat(ty: Column, tx: Column, rim: bool) -> Column:
        return F.struct(ty.cast("int").alias("ty"), tx.cast("int").alias("tx"), F.lit(rim).alias("rim"))

    ends_row, ends_column = F.col("x") % tile == tile - 1, F.col("y") % tile == tile - 1
    seats = F.array_compact(
        F.array(seat(down, right, False), F.when(ends_row, seat(down, right + 1, True)), F.when(ends_column, seat(down + 1, right, True)))
    )
    return pixels.select("*", F.inline(seats))


def image_stats_from_pixels(pixels: DataFrame, key: str = "image_id", tile: int = TILE) -> DataFrame:
    """One row of statistics per image from rows ``(key, y, x, r, g, b)`` with 0-255 channels.

    The pixels are dealt once, by image and tile, which serves both directions of neighbour differences.
    A large picture is so spread over tasks, with a rim of one pixel along the cuts for the differences;
    rows and columns are sorted within a tile only. The totals of the tiles are combined before the last
    shuffle. Pictures should be complete: a gap is bridged within a tile, not over a cut.
    """
    r, g, b = (F.col(c) / F.lit(255.0) for c in "rgb")
    gray = F.lit(RED_WEIGHT) * r + F.lit(GREEN_WEIGHT) * g + F.lit(BLUE_WEIGHT) * b
    shaded = _tiled(pixels, tile).repartition(key, "ty", "tx").select(
        key, "ty", "tx", "rim", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"), gray.alias("gray")
    )
    along_row = Window.partitionBy(key, "ty", "tx", "y").orderBy("x")
    along_column = Window.partitionBy(key, "ty", "tx", "x").orderBy("y")
    edged = shaded.withColumn("dx", _step(along_row)).withColumn("dy", _step(along_column)).where("NOT rim")
    bin_of = F.least(F.floor(F.col("gray") * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1))
    # One fixed-width aggregate row per image and task goes through the last shuffle.
    totals = (
        edged.withColumn("bin", bin_of)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.stddev_pop("gray").alias("img_contrast"),
            F.avg("gray").alias("img_brightness"),
            F.avg(F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("img_saturation"),
            F.avg(F.col("dx") + F.col("dy")).alias("img_edge_density"),
            F.avg("r").alias("img_dominant_red"),
            F.avg("g").alias("img_dominant_green"),
            F.avg("b").alias("img_dominant_blue"),
            (F.max("x") + 1).alias("width"),
            (F.max("y") + 1).alias("height"),
            *[F.expr(f"count_if(bin = {i}) AS bin_{i}") for i in range(HISTOGRAM_BINS)],
        )
    )
    derived = {
        "img_aspect_ratio": F.col("width") / F.greatest(F.col("height"), F.lit(1)),
        "img_warm_tone_ratio": F.col("img_dominant_red")
        / (F.col("img_dominant_blue") + F.lit(TONE_FLOOR)),
        "img_color_entropy": F.expr(f"-({' + '.join(map(_entropy_term, range(HISTOGRAM_BINS)))})"),
        "img_has_image": F.lit(1.0),
    }
    return totals.select(
        key, *[derived.get(n, F.col(n)).cast("double").alias(n) for n in IMAGE_FEATURES]
    )


def _step(window: WindowSpec) -> Column:
    gray = F.col("gray")
    return F.coalesce(F.abs(gray - F.lag(gray).over(window)), F.lit(0.0))


def _entropy_term(slot: int) -> str:
    density = f"(bin_{slot} * {HISTOGRAM_BINS}D / n + {DENSITY_FLOOR}D)"
    return f"{density} * log2({density})"


def _stats_of(rgb: np.ndarray) -> list[float]:
    """Statistics of one H x W x 3 array scaled to [0, 1], in schema order."""
    height, width, _ = rgb.shape
    gray = rgb @ np.array([RED_WEIGHT, GREEN_WEIGHT, BLUE_WEIGHT])
    edges = np.abs(np.diff(gray, axis=1)).sum() + np.abs(np.diff(gray, axis=0)).sum()
    bins = np.minimum((gray * HISTOGRAM_BINS).astype(int), HISTOGRAM_BINS - 1)
    density = np.bincount(bins.ravel(), minlength=HISTOGRAM_BINS) * (HISTOGRAM_BINS / gray.size)
    density = density + DENSITY_FLOOR
    red, green, blue = rgb.reshape(-1, 3).mean(axis=0)
    return [
        gray.mean(),
        gray.std(),
        (rgb.max(axis=2) - rgb.min(axis=2)).mean(),
        width / max(height, 1),
        red / (blue + TONE_FLOOR),
        edges / gray.size,
        -(density * np.log2(density)).sum(),
        red,
        green,
        blue,
        1.0,
    ]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for origin, height, width, channels, data in frame.itertuples(index=False):
            if height <= 0 or channels not in (1, 3, 4):
                rows.append([origin, *[0.0] * len(IMAGE_FEATURES)])
                continue
            pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
            # Stored blue-green-red(-alpha); a single channel is repeated.
            bgr = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, :3]
            rows.append([origin, *_stats_of(bgr[:, :, ::-1] / 255.0)])
        yield pd.DataFrame(rows, columns=["origin", *IMAGE_FEATURES])


def image_stats(images: DataFrame) -> DataFrame:
    """Statistics for rows of the ``image`` source; undecodable files keep a zero row.

    No shuffle: each task walks its own images, a few to a batch.
    """
    schema = T.StructType(
        [T.StructField("origin", T.StringType())]
        + [T.StructField(name, T.DoubleType()) for name in IMAGE_FEATURES]
    )
    fields = ["origin", "height", "width", "nChannels", "data"]
    return images.select(*[F.col(f"image.{f}").alias(f) for f in fields]).mapInPandas(
        _batches, schema
    )


def rejected_images(stats: DataFrame) -> DataFrame:
    """How many files could not be decoded."""
    return stats.agg(F.count_if(F.col("img_has_image") == 0.0).alias("rejected"))
