"""Nearest neighbours by low-dimensional stable projections in kd-trees.

Vectors are projected to ``PROJECTED`` dimensions with normal, that is 2-stable, coefficients. The
squared projected distance over the squared true distance then follows a chi-square law with as
many degrees of freedom. A search visits the leaves of a kd-tree over the projections by growing
distance and verifies their vectors by true distance. It stops when a vector as near as the worst
of the k found would, with probability ``CONFIDENCE``, have been projected nearer than all that is
left.

The upper kd-tree is fitted on a bounded sample and deals all vectors to cells; a large cell is cut
into blocks at random, and each block has a kd-tree of its own. A query first searches the cell that
it falls into, then, with the distance found, every other cell that the stopping test does not rule
out.

Defined results
    Vectors that are null, zero, hold a null or non-finite component, or have a null id take no part.
    Rows of one id are one vector, the smallest if they differ. Distances between vectors of
    different length are undefined, so each vector searches among those of its length only. Ties go
    to the smaller id. An empty table gives an empty result. Further columns are not read.

Scale
    Of equal vectors only the k + 1 smallest ids can be among the nearest of anything; the rest are
    left out exactly. A task holds one block of vectors and one block of queries. The projection
    boxes that travel to all tasks are those of at most ``MAX_CELLS`` cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored
from seamstat.llm.vectors import by_dimension, unpack, usable

K = 10
PROJECTED = 8  # even, for the closed form of the chi-square law
CONFIDENCE = 0.98
BLOCK = 4096
LEAF = 64
SAMPLE = 65_536
MAX_CELLS = 4096
SEED = 29


def chi_square(x: float, freedom: int = PROJECTED) -> float:
    """Probability that a chi-square variable with an even number of degrees of freedom is at most x."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def stop_ratio(confidence: float = CONFIDENCE) -> float:
    """Squared projected over squared true distance at which the stopping test begins to hold."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square(middle) >= confidence else (middle, high)
    return high


def projected(vectors: np.ndarray) -> np.ndarray:
    """Sums in a fixed order: the same vector is projected alike in every batch."""
    dimension = vectors.shape[1]
    coefficients = np.random.default_rng([SEED, dimension]).normal(size=(dimension, PROJECTED))
    return np.einsum("ij,jk->ik", vectors, coefficients)


def project_all(packed: list[bytes]) -> np.ndarray:
    out = np.empty((len(packed), PROJECTED))
    for _, rows in by_dimension([range(len(p) // 8) for p in packed]):
        out[rows] = projected(unpack([packed[i] for i in rows]))
    return out


@dataclass
class CellTree:
    """A kd-tree with as many levels as ``axes``; cells are numbered by the branches taken."""

    axes: list[np.ndarray]
    cuts: list[np.ndarray]

    @classmethod
    def fit(cls, points: np.ndarray, levels: int) -> CellTree:
        axes, cuts, cell = [], [], np.zeros(len(points), np.int64)
        for level in range(levels):
            axis, cut = np.zeros(1 << level, np.int64), np.zeros(1 << level)
            for node in range(1 << level):
                own = points[cell == node]
                if len(own):
                    axis[node] = np.ptp(own, axis=0).argmax()
                    cut[node] = np.median(own[:, axis[node]])
            axes.append(axis)
            cuts.append(cut)
            cell = cell * 2 + (points[np.arange(len(points)), axis[cell]] > cut[cell])
        return cls(axes, cuts)

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int64)
        for axis, cut in zip(self.axes, self.cuts, strict=True):
            cell = cell * 2 + (points[np.arange(len(points)), axis[cell]] > cut[cell])
        return cell


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree by halves along the widest side."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        own = points[rows]
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0.0) ** 2).sum(1)


def search_block(ids: np.ndarray, vectors: np.ndarray, queries: list[tuple[int, np.ndarray, float]], k: int, ratio: float) -> Iterator[tuple[int, int, float]]:
    """(query, id, distance) of the nearest found in one block, for queries with a known limit."""
    points = projected(vectors)
    parts = leaves(points)
    low = np.stack([points[rows].min(0) for rows in parts])
    high = np.stack([points[rows].max(0) for rows in parts])
    for query, vector, limit in queries:
        gaps = box_distance(low, high, projected(vector[None])[0])
        order = np.argsort(gaps, kind="stable")
        best, rows_best, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 1
        while at < len(order):
            worst = min(limit, best[k - 1] if len(best) >= k else math.inf)
            # At distance 0 a leaf may still hold an equal vector with a smaller id.
            open_ = gaps[order[at : at + step]] <= ratio * worst * worst
            if not open_[0]:
                break
            rows = np.concatenate([parts[leaf] for leaf in order[at : at + step][open_]])
            rows = rows[ids[rows] != query]
            distances = np.sqrt(((vectors[rows] - vector) ** 2).sum(1))
            best, rows_best = np.concatenate([best, distances]), np.concatenate([rows_best, rows])
            keep = np.lexsort((ids[rows_best], best))[:k]
            best, rows_best = best[keep], rows_best[keep]
            at, step = at + step, step * 2
        for distance, row in zip(best, rows_best, strict=True):
            yield query, int(ids[row]), float(distance)


def packed_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of usable vectors, one for each id."""
    known_as = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = usable(batch.column(1))
            packed = pa.array([(v + 0.0).tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed], ["vec_id", "vector"])

    known = embeddings.select("vec_id", "embedding").where("vec_id IS NOT NULL")
    every = known.mapInArrow(run, f"vec_id {known_as}, vector binary")
    return every.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _with_cell(vectors: DataFrame, trees: dict[int, CellTree]) -> DataFrame:
    """Add the dimension and the cell in the upper tree of that dimension."""
    known_as = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            sizes = np.array([len(p) // 8 for p in packed], np.int64)
            cell = np.zeros(len(packed), np.int64)
            points = project_all(packed)
            for size, rows in by_dimension([range(n) for n in sizes]):
                if size in trees:
                    cell[rows] = trees[size].cell_of(points[rows])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(list(points), pa.list_(pa.float64()))],
                ["vec_id", "vector", "size", "cell", "point"],
            )

    schema = f"vec_id {known_as}, vector binary, size int, cell int, point array<double>"
    return vectors.select("vec_id", "vector").mapInArrow(run, schema)


def _searched(candidates: DataFrame, queries: DataFrame, k: int, ratio: float) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest of each query in each block that it is sent to.

    ``candidates`` has size, cell, block, vec_id, vector; ``queries`` has size, cell, block, part,
    query_id, query, reach. Vectors are repeated for each part of a cell's queries.
    """
    known_as = candidates.schema["vec_id"].dataType.simpleString()
    parts = queries.groupBy("size", "cell", "block").agg(F.collect_set("part").alias("parts"))
    keys = ["size", "cell", "block"]
    vectors = candidates.join(parts, keys).withColumn("part", F.explode("parts")).select(*keys, "part", "vec_id", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            asked = right.select(["query_id", "query", "reach"]).to_pylist()
            searches = [(q["query_id"], np.frombuffer(q["query"], np.float64), q["reach"]) for q in asked]
            ids, matrix = left.column("vec_id").to_numpy(), unpack(left.column("vector").to_pylist())
            rows = list(search_block(ids, matrix, searches, k, ratio))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table(
            {
                "query_id": pa.array(columns[0], left.schema.field("vec_id").type),
                "vec_id": pa.array(columns[1], left.schema.field("vec_id").type),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    grouped = [*keys, "part"]
    return vectors.groupBy(*grouped).cogroup(queries.groupBy(*grouped)).applyInArrow(
        run, f"query_id {known_as}, vec_id {known_as}, score double"
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of every query."""
    ratio = stop_ratio(confidence)
    every = stored(packed_vectors(embeddings), "vectors")
    order = Window.partitionBy("vector").orderBy("vec_id")
    useful = stored(
        every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place"), "useful"
    )
    trees = _upper_trees(useful)
    placed = stored(_with_cell(useful, trees), "placed")
    boxes = placed.groupBy("size", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(F.col("point")[i]).alias(f"{name}{i}") for i in range(PROJECTED) for name, f in (("low", F.min), ("high", F.max))],
    )
    cells = boxes.collect()  # at most MAX_CELLS for each dimension
    blocks = _lookup(placed, {(row["size"], row["cell"]): math.ceil(row["n"] / BLOCK) for row in cells})
    candidates = placed.select("size", "cell", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), "vec_id", "vector")
    asked = every.where(is_query)
    parts = max(1, math.ceil(asked.count() / BLOCK))
    queries = stored(
        _with_cell(asked, trees).select(
            "size",
            "cell",
            F.col("vec_id").alias("query_id"),
            F.col("vector").alias("query"),
            "point",
            F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
        ),
        "queries",
    )

    def in_blocks(df: DataFrame) -> DataFrame:
        """Send each query to every block of its cell."""
        last = _lookup(df, {(row["size"], row["cell"]): math.ceil(row["n"] / BLOCK) for row in cells}) - 1
        return df.withColumn("block", F.explode(F.sequence(F.lit(0), last)))

    home = in_blocks(queries.withColumn("reach", F.lit(math.inf))).drop("point")
    first = stored(ranked(_searched(candidates, home, k, ratio), k), "found-at-home")
    # With fewer than k found at home there is no limit yet.
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(math.inf).alias("reach"))
    limited = queries.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(math.inf)))
    away = in_blocks(_routed(limited, cells, ratio))
    second = _searched(candidates, away, k, ratio)
    final = ranked(first.drop("rank").unionByName(second), k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lookup(df: DataFrame, values: dict[tuple[int, int], int]) -> Column:
    """The number of blocks of a row's cell; 1 for a cell without vectors."""
    entries = [F.lit(x) for (size, cell), n in values.items() if n > 1 for x in ((size << 32) + cell, n)]
    if not entries:
        return F.lit(1)
    key = F.shiftleft(df["size"].cast("bigint"), 32) + df["cell"]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(1))


def _upper_trees(useful: DataFrame) -> dict[int, CellTree]:
    """One tree for each dimension, fitted on a sample of bounded size."""
    sizes = useful.groupBy((F.length("vector") / 8).cast("int").alias("size")).count().collect()
    total = sum(row["count"] for row in sizes)
    place = F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1_000_000)) / 1_000_000.0
    sample = useful.where(place < SAMPLE / max(total, 1)).select("vector").toPandas()["vector"].tolist()
    points = {size: projected(unpack([sample[i] for i in rows])) for size, rows in by_dimension([range(len(p) // 8) for p in sample])}
    trees = {}
    for row in sizes:
        if row["size"] in points:
            wanted = min(MAX_CELLS, math.ceil(row["count"] / BLOCK))
            trees[row["size"]] = CellTree.fit(points[row["size"]], max(0, math.ceil(math.log2(wanted))))
    return trees


def _routed(queries: DataFrame, cells: list, ratio: float) -> DataFrame:
    """Each query once for every cell other than its own that may hold one of its nearest."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {row["size"] for row in cells}:
        own = [row for row in cells if row["size"] == size]
        low, high = (np.array([[row[f"{name}{i}"] for i in range(PROJECTED)] for row in own]) for name in ("low", "high"))
        by_size[size] = np.array([row["cell"] for row in own], np.int32), low, high
    columns = ["size", "cell", "query_id", "query", "point", "part", "reach"]
    queries = queries.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, targets = [], []
            for i, (size, cell, point, reach) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in ("size", "cell", "point", "reach")], strict=True)
            ):
                if size not in by_size:
                    continue
                names, low, high = by_size[size]
                near = (box_distance(low, high, np.array(point)) <= ratio * reach * reach) & (names != cell)
                targets.append(names[near])
                rows.append(np.full(near.sum(), i))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            out = [batch.column(c).take(take) for c in columns]
            out[1] = pa.array(np.concatenate(targets) if targets else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(out, columns)

    return queries.mapInArrow(run, queries.schema).drop("point")
