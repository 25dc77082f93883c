"""Numbers and running sums over ranges, and pictures cut into tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamstat.functions.numbering import numbered, sorted_ranges, with_sum_before
from seamstat.operators.image_stats import image_stats_from_pixels
from seamstat.schema import IMAGE_FEATURES


def test_numbers_follow_the_order(spark):
    frame = spark.range(5_000).selectExpr("(id * 7919) % 5003 AS v", "id % 3 AS k").repartition(7)
    got = numbered(frame, ["k", "v"], first=2)
    rows = sorted(got.collect(), key=lambda r: r["number"])
    assert [r["number"] for r in rows] == list(range(2, 5_002))
    assert [(r["k"], r["v"]) for r in rows] == sorted((r["k"], r["v"]) for r in rows)
    assert numbered(frame.limit(0), ["v"]).collect() == []


def test_sums_carry_on_over_ranges(spark):
    draw = np.random.default_rng(1).permutation(3_000)
    frame = spark.createDataFrame([(int(v), int(v) % 5) for v in draw], "v int, n int")
    rows = sorted(with_sum_before(sorted_ranges(frame, ["v"]), ["v"], "n").collect())
    assert len({r["range"] for r in rows}) == 8
    before = 0
    for row in rows:
        assert row["before"] == before
        before += row["n"]
    assert with_sum_before(sorted_ranges(frame.limit(0), ["v"]), ["v"], "n").collect() == []


@pytest.mark.parametrize("tile", [1, 4, 7, 64])
def test_a_picture_cut_in_tiles_equals_the_whole_one(spark, tile):
    draw = np.random.default_rng(3)
    rows = [
        (image, y, x, *map(int, draw.integers(0, 256, 3)))
        for image, (height, width) in enumerate([(17, 22), (1, 9), (8, 1), (8, 8)])
        for y in range(height)
        for x in range(width)
    ]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int")
    whole = {r["image_id"]: r for r in image_stats_from_pixels(pixels, tile=10**6).collect()}
    for row in image_stats_from_pixels(pixels, tile=tile).collect():
        assert [row[n] for n in IMAGE_FEATURES] == pytest.approx([whole[row["image_id"]][n] for n in IMAGE_FEATURES], abs=1e-12)
    gray = np.array([0.299 * r + 0.587 * g + 0.114 * b for i, _, _, r, g, b in rows if i == 0]).reshape(17, 22) / 255
    edges = (np.abs(np.diff(gray, axis=0)).sum() + np.abs(np.diff(gray, axis=1)).sum()) / gray.size
    assert whole[0]["img_edge_density"] == pytest.approx(edges, abs=1e-12)


def test_tiles_are_what_meets_in_a_task(spark):
    pixels = spark.range(100).select((F.col("id") % 2).alias("image_id"), (F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"), *[F.lit(0).alias(c) for c in "rgb"])
    plan = image_stats_from_pixels(pixels)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("ty" in line and "tx" in line for line in shuffles) and len(shuffles) == 2
