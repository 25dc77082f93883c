"""Near-duplicate vectors by E8 lattice hashing.

In each of ``TABLES`` tables a random projection takes the unit vectors to eight dimensions, and
the nearest point of the E8 lattice is a vector's home cell. A vector also probes the ``PROBES``
neighbouring cells nearest to it. Vectors that meet in the home cell of one of them are compared by
cosine in double precision. With the given width, a pair at cosine 0.9 meets with probability 0.997,
one at 0.95 with 0.99999.

Cells are dealt by key first: a row holds cell, id and a sketch of 128 signs of random projections,
but no vector. Cells with one vector go, and so do vectors whose sketch is far from all others of
their block; vectors are fetched only for those that may have a partner there. A pair at cosine 0.9
passes the sketches but for less than one in a million.

Equal vectors are compared once, with their number. A cell with many vectors is cut into blocks;
each pair of blocks is compared on its own, so no cell is gathered. A pair that meets more than
once is counted where it meets first, which both vectors' cells tell.

Defined results
    A vector that is null, zero, or holds a null or non-finite component, or has a null id, has no
    links and is its own component. Vectors of different length are not linked. Repeated rows with
    equal id and vector are one vector. Further columns are not read. An empty table gives an
    empty result.

Scale
    Links are counted in the blocks and never listed: a block gives one row for each of its vectors,
    with its number of links and the smallest vector it is connected with there. Rows of cells are of
    one small size, whatever the dimension; vectors travel only to blocks where they have a partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstat.llm.components import components
from seamstat.llm.shingles import mixed
from seamstat.sources.scratch import stored
from seamstat.llm.vectors import by_dimension, unpack, usable

LEAST = 0.9
TABLES, PROBES = 6, 2
WIDTH = 2.0
BLOCK = 1024
SEED = 23
SIGNS = 128
MOST_APART = 40  # signs; at cosine 0.9 18.4 of 128 differ, with a deviation of 4
LINKS_AT_ONCE = 200_000

#: The 240 shortest vectors of E8: the steps to a cell's neighbours.
NEIGHBOURS = np.array(
    [v for v in product((-1.0, 0.0, 1.0), repeat=8) if sum(map(abs, v)) == 2]
    + [v for v in product((-0.5, 0.5), repeat=8) if sum(v) % 2 == 0]
)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(gap[odd]).argmax(1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: integers with an even sum, or all moved by a half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def cells(units: np.ndarray) -> np.ndarray:
    """(vectors, tables, 1 + probes): keys of each vector's home cell and of those it probes."""
    dimension = units.shape[1]
    random = np.random.default_rng([SEED, dimension])
    places = random.integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(units), TABLES, 1 + PROBES), np.int64)
    for table in range(TABLES):
        projection, shift = random.normal(size=(dimension, 8)) / WIDTH, random.random(8) * 2
        # A sum of products in a fixed order: the same vector gets the same cell in every batch.
        x = np.einsum("ij,jk->ik", units, projection) + shift
        home = nearest_point(x)
        towards = (x - home) @ NEIGHBOURS.T
        points = [home]
        for _ in range(PROBES):
            nearest = towards.argmax(1)
            points.append(home + NEIGHBOURS[nearest])
            towards[np.arange(len(x)), nearest] = -np.inf
        points = np.stack(points, axis=1)
        doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
        out[:, table] = mixed((doubled * places).sum(2, dtype=np.uint64) + np.uint64(table * 1000 + dimension)).view(np.int64)
    return out


def digests(embeddings: DataFrame) -> DataFrame:
    """(vec_id, digest, vector) of usable vectors, as bytes of doubles."""
    known_as = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = usable(batch.column(1))
            packed = [(v + 0.0).tobytes() for v in vectors]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()),
                    pa.array(packed, pa.binary()),
                ],
                ["vec_id", "digest", "vector"],
            )

    known = embeddings.select("vec_id", "embedding").where("vec_id IS NOT NULL")
    return known.mapInArrow(run, f"vec_id {known_as}, digest binary, vector binary")


def sketches(units: np.ndarray) -> np.ndarray:
    """(vectors, bytes): the signs of ``SIGNS`` random projections of each vector."""
    random = np.random.default_rng([SEED, SIGNS, units.shape[1]])
    return np.packbits(units @ random.normal(size=(units.shape[1], SIGNS)) > 0, axis=1)


def hashed(distinct: DataFrame) -> DataFrame:
    """Each distinct vector once for each of its cells, without the vector: cell, home, id, sketch."""
    known_as = distinct.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_vector = TABLES * (1 + PROBES)
        home = np.tile(np.arange(1 + PROBES) == 0, TABLES)
        for batch in batches:
            packed = batch.column(1).to_pylist()
            sizes = [len(p) // 8 for p in packed]
            keys = np.empty((len(packed), per_vector), np.int64)
            signs = np.empty((len(packed), SIGNS // 8), np.uint8)
            for _, rows in by_dimension([range(n) for n in sizes]):
                units = _units([packed[i] for i in rows])
                keys[rows] = cells(units).reshape(len(rows), -1)
                signs[rows] = sketches(units)
            repeat = pa.array(np.repeat(np.arange(len(packed)), per_vector))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel()),
                    pa.array(np.tile(home, len(packed))),
                    batch.column(0).take(repeat),
                    pa.array([row.tobytes() for row in signs], pa.binary()).take(repeat),
                ],
                ["cell", "home", "id", "sketch"],
            )

    return distinct.select("id", "vector").mapInArrow(run, f"cell bigint, home boolean, id {known_as}, sketch binary")


def _units(packed: list[bytes]) -> np.ndarray:
    vectors = unpack(packed)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in the squares
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _met_here(cell: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether a pair's first meeting is in this cell; cells of each pair as (pairs, tables, 1 + probes)."""
    equal = left[:, :, :, None] == right[:, :, None, :]
    equal[:, :, 1:, 1:] = False  # two probes do not meet
    cells_met = np.where(equal, left[:, :, :, None], np.iinfo(np.int64).max).reshape(len(left), TABLES, -1).min(2)
    met = cells_met != np.iinfo(np.int64).max
    first = met.argmax(1)
    return cells_met[np.arange(len(left)), first] == cell


def compare(cell: int, ids: np.ndarray, times: np.ndarray, home: np.ndarray, side: np.ndarray, packed: list[bytes]) -> tuple:
    """Links of the vectors of one pair of blocks: (rows, number of linked vectors, smallest id reached).

    ``side`` is 0 or 1 for the two blocks; in a block with itself all are 0.
    """
    units = _units(packed)
    n = len(ids)
    counts, roots = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    near = (units @ units.T >= LEAST) & _meeting(home, side)
    near &= near.T
    a, b = np.nonzero(np.triu(near))
    if not len(a):
        return np.zeros(0, np.int64), counts, ids
    used = np.unique(np.concatenate([a, b]))
    keys = np.empty((n, TABLES, 1 + PROBES), np.int64)
    keys[used] = cells(units[used])
    for at in range(0, len(a), LINKS_AT_ONCE):
        x, y = a[at : at + LINKS_AT_ONCE], b[at : at + LINKS_AT_ONCE]
        here = _met_here(cell, keys[x], keys[y])
        counts += np.bincount(x[here], times[y[here]], n).astype(np.int64)
        counts += np.bincount(y[here], times[x[here]], n).astype(np.int64)
    roots = rank.copy()
    while True:
        new = roots.copy()
        np.minimum.at(new, a, roots[b])
        np.minimum.at(new, b, roots[a])
        new = np.minimum(new, new[order[new]])  # and on to what that one reaches
        if (new == roots).all():
            break
        roots = new
    return used, counts[used], ids[order[roots[used]]]


def _meeting(home: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs that a pair of blocks compares: not two probes, and of two blocks one from each."""
    meet = home[:, None] | home[None, :]
    if side.any():
        meet &= side[:, None] != side[None, :]
    np.fill_diagonal(meet, False)
    return meet


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (cell, x, y), read off sorted rows; one group may go on in the next batch."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
        if not len(key):
            continue
        edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        bounds = [0, *edges.tolist(), len(key)]
        for k, (start, stop) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if rest and (k or tuple(key[start]) != last):
                yield pa.concat_tables(rest)
                rest = []
            rest.append(table.slice(start, stop - start))
            last = tuple(key[start])
    if rest:
        yield pa.concat_tables(rest)


def with_partner(placed: DataFrame) -> DataFrame:
    """(cell, x, y, side, home, id) of the vectors that have a near sketch in a pair of blocks.

    ``placed`` also has the sketch, and is sorted within partitions by the first three.
    """
    known_as = placed.schema["id"].dataType.simpleString()
    names = ["cell", "x", "y", "side", "home", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for group in _block_pairs(batches):
            if group.num_rows < 2:
                continue
            side, home = group.column(3).to_numpy(), group.column(4).to_numpy()
            packed = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(-1, SIGNS // 8)
            signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
            near = (signs @ signs.T >= SIGNS - 2 * MOST_APART) & _meeting(home, side)
            found = np.flatnonzero(near.any(1))
            if len(found):
                kept.append([group.column(i).to_numpy()[found] for i in range(6)])
                rows += len(found)
            if rows >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)
                kept, rows = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)

    return placed.mapInArrow(run, f"cell bigint, x int, y int, side int, home boolean, id {known_as}")


def block_links(placed: DataFrame) -> DataFrame:
    """(id, links, root) of the vectors with links in each pair of blocks.

    ``placed`` has cell, x, y, side, home, id, times and vector, sorted within partitions by the first
    three.
    """
    known_as = placed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, counts_out, roots_out = [], [], []
        for group in _block_pairs(batches):
            if group.num_rows < 2:
                continue
            cell = group.column(0)[0].as_py()
            side, home, ids, times = (group.column(i).to_numpy() for i in (3, 4, 5, 6))
            rows, counts, roots = compare(cell, ids, times, home, side, group.column(7).to_pylist())
            if len(rows):
                ids_out.append(ids[rows])
                counts_out.append(counts)
                roots_out.append(roots)
            if len(ids_out) >= 200:
                yield _batch(ids_out, counts_out, roots_out)
                ids_out, counts_out, roots_out = [], [], []
        if ids_out:
            yield _batch(ids_out, counts_out, roots_out)

    return placed.mapInArrow(run, f"id {known_as}, links bigint, root {known_as}")


def _batch(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id", "links", "root"])


def groups(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    every = stored(digests(embeddings), "vectors")
    distinct = stored(
        every.select("vec_id", "digest", "vector")
        .dropDuplicates(["vec_id", "digest"])
        .groupBy("digest")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"), F.min("vector").alias("vector")),
        "distinct",
    )
    spread = stored(hashed(distinct), "cells")
    # A cell matters if it is somebody's home and holds two vectors.
    sizes = (
        spread.groupBy(F.col("cell").alias("of_cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived_in"))
        .where("n > 1 AND lived_in")
        .select("of_cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        spread.join(sizes, F.col("cell") == F.col("of_cell"))
        .withColumn("own", own)
        .withColumn("other", partner)
        .select(
            "cell",
            F.least("own", "other").alias("x"),
            F.greatest("own", "other").alias("y"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "home",
            "id",
            "sketch",
        )
    )
    block = ["cell", "x", "y"]
    partnered = stored(with_partner(placed.repartition(*block).sortWithinPartitions(*block)), "partnered")
    vectors = distinct.select(F.col("id").alias("of_id"), "times", "vector")
    fetched = partnered.join(vectors, F.col("id") == F.col("of_id")).drop("of_id")
    dealt = fetched.repartition(*block).sortWithinPartitions(*block)
    found = stored(block_links(dealt), "block-links")
    component = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = stored(
        distinct.select("digest", "id", "times")
        .join(links, "id", "left")
        .join(component, F.col("id") == F.col("node"), "left")
        .select(
            F.col("digest").alias("of"),
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("root"),
        ),
        "vector-groups",
    )
    linked = every.join(known, F.col("digest") == F.col("of")).select("vec_id", "n_links", "root")
    alone = _without_vector(embeddings)
    return linked.unionByName(alone).select(
        "vec_id",
        "n_links",
        F.col("root").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("root"), F.lit(True)).alias("kept"),
    )


def _without_vector(embeddings: DataFrame) -> DataFrame:
    """Rows that ``digests`` leaves out, linked with nothing."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    zero = ~F.exists(vector, lambda v: v != 0)
    out = F.col("vec_id").isNull() | vector.isNull() | F.coalesce(bad, F.lit(True)) | F.coalesce(zero, F.lit(True))
    return embeddings.where(out).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("root"))
