import math

import numpy as np
import pytest

from seamstat.llm import lattice_dup, nearest
from tests.llm import brute

VEC = "vec_id bigint, embedding array<double>, label int, n_links string"
ODD = [(9001, None), (9002, [0.0] * 16), (9003, [1.0, None] + [0.0] * 14), (9004, [float("nan")] * 16), (9005, [float("inf")] + [1.0] * 15), (9006, []), (None, [1.0] * 16)]


def sample(seed=0, n=300):
    random = np.random.default_rng(seed)
    base = random.normal(size=(n, 16))
    rows = {i * 10: v for i, v in enumerate(base)}
    for i in range(0, n, 5):  # near copies on both sides of the limit
        for k in range(1, 5):
            rows[i * 10 + k] = base[i] + random.normal(size=16) * random.choice([0.05, 0.3, 0.5])
    for k in range(400):  # a large group in one cell, and equal vectors
        rows[20_000 + k] = base[0] + random.normal(size=16) * 0.02 if k % 2 else base[1] * 1.0
    return rows


def table(spark, rows, more=()):
    return spark.createDataFrame([(i, [float(x) for x in v], 1, "x") for i, v in rows.items()] + [(i, v, None, None) for i, v in more], VEC)


def test_links_and_groups_equal_brute_force(spark, monkeypatch):
    rows = sample()
    ids = np.array(list(rows))
    matrix = np.array(list(rows.values()))
    units = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(lattice_dup, "BLOCK", 50)  # so that cells are cut into blocks
    got = {r["vec_id"]: r for r in lattice_dup.groups(table(spark, rows, ODD)).collect()}
    assert len(got) == len(rows) + len(ODD)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    whole = brute.connected(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(np.triu(near))])
    assert np.mean([got[i]["component_id"] == whole[i] for i in whole]) > 0.99
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items() if i is not None)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in ODD)


def test_equal_repeated_and_other_length_vectors(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, -0.0]), (4, [1.0, 0.0]), (8, [1e200, 0.0, 0.0]), (9, [0.0, 1.0, 0.0])]
    got = sorted(map(tuple, lattice_dup.groups(table(spark, {}, rows)).collect()))
    assert got == [(3, 2, 3, True), (4, 0, 4, True), (5, 2, 3, False), (5, 2, 3, False), (8, 2, 3, False), (9, 0, 9, True)]
    assert lattice_dup.groups(table(spark, {})).collect() == []


def test_nearest_lattice_point():
    random = np.random.default_rng(2)
    x = random.normal(size=(200, 8)) * 3
    point = lattice_dup.nearest_point(x)
    doubled = np.rint(point * 2).astype(int)
    assert np.allclose(doubled, point * 2) and (np.ptp(doubled % 2, axis=1) == 0).all() and (np.rint(point.sum(1)) % 2 == 0).all()
    others = point[:, None] + lattice_dup.NEIGHBOURS[None]
    assert len(lattice_dup.NEIGHBOURS) == 240
    assert (((x - point) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()


def nearest_by_all(rows, query, k):
    found = sorted((math.dist(rows[query], v), i) for i, v in rows.items() if i != query)
    return found[:k]


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 100)
    rows = sample(1, 400)
    asked = [i for i in rows if i % 100 == 0]
    got = nearest.nearest(table(spark, rows, ODD), nearest.F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for query in asked:
        own = got[got["query_id"] == query].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert list(zip(own["score"], own["vec_id"], strict=True)) == sorted(zip(own["score"], own["vec_id"], strict=True))
        assert own["score"].tolist() == pytest.approx([math.dist(rows[query], rows[i]) for i in own["vec_id"]])
        hits += len({i for _, i in nearest_by_all(rows, query, 10)} & set(own["vec_id"]))
    assert hits / (10 * len(asked)) >= 0.95
    assert set(got["query_id"]) == set(asked)


def test_ties_few_candidates_and_repeats(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), *[(i, [1.0, 0.0]) for i in range(1, 40)], (200, [1.0, 2.0, 3.0]), (300, [0.0, 0.0])]
    got = nearest.nearest(table(spark, {}, rows), nearest.F.col("vec_id") % 100 == 0, k=10)
    assert sorted(map(tuple, got.collect())) == [(100, n, n, 0.0) for n in range(1, 11)]
    few = nearest.nearest(table(spark, {}, [(0, [1.0, 0.0]), (7, [0.0, 0.0, 1.0]), (5, [4.0, 4.0])]), nearest.F.col("vec_id") % 100 == 0)
    assert list(map(tuple, few.collect())) == [(0, 1, 5, 5.0)]
    assert nearest.nearest(table(spark, {}), nearest.F.col("vec_id") % 100 == 0).collect() == []


def test_chi_square_law():
    draws = np.random.default_rng(3).chisquare(nearest.PROJECTED, 200_000)
    for x in (2.0, 8.0, 15.0):
        assert nearest.chi_square(x) == pytest.approx((draws <= x).mean(), abs=0.005)
    assert nearest.chi_square(nearest.stop_ratio(0.9)) == pytest.approx(0.9)


def test_sketches_keep_near_pairs_and_part_others():
    random = np.random.default_rng(5)
    a = random.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other = random.normal(size=a.shape)
    other -= (other * a).sum(1)[:, None] * a
    other /= np.linalg.norm(other, axis=1)[:, None]
    apart = [
        np.unpackbits(lattice_dup.sketches(a) ^ lattice_dup.sketches(b), axis=1).sum(1)
        for b in (0.9 * a + math.sqrt(1 - 0.81) * other, other)
    ]
    assert (apart[0] <= lattice_dup.MOST_APART).all() and (apart[1] > lattice_dup.MOST_APART).mean() > 0.99
