import random

import numpy as np
import pytest

from seamstat.llm import components as closing
from seamstat.llm import near_dup
from seamstat.llm.components import components, merged
from seamstat.llm.shingles import shingle_sets
from tests.llm import brute

DOC = "doc_id bigint, text string, kept string"


def sample_texts():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passage = {}, " ".join(draw.choices(vocabulary, k=40))
    for i in range(60):
        words = draw.choices(vocabulary, k=draw.randint(20, 120))
        texts[i * 10] = " ".join(words)
        for k in range(1, draw.randint(1, 6)):  # near and far copies
            other = list(words)
            for _ in range(draw.choice([1, 1, 2, 3, 5, 8])):
                other[draw.randrange(len(other))] = draw.choice(vocabulary)
            texts[i * 10 + k] = " ".join(other)
    for i in range(40):  # a passage that makes many pairs of middling similarity
        texts[1000 + i] = passage + " " + " ".join(draw.choices(vocabulary, k=12))
    for i in range(30):
        texts[2000 + i] = texts[0].upper() if i % 2 else texts[0].replace(" ", "\n\t ")
    texts |= {3000: None, 3001: "", 3002: " \n ", 3003: "Two words", 3004: "two WORDS", 3005: "two\u00a0words", 3006: "a b c d e"}
    return texts


def test_groups_equal_brute_force(spark):
    texts = sample_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOC)
    sizes, component = brute.near_duplicates(texts)
    got = {r["doc_id"]: r for r in near_dup.groups(docs).collect()}
    assert len(got) == len(texts)
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["kept"] == (i == component[i]) for i, r in got.items())
    kept = near_dup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(component.values()))


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(None, "a b c d e f", ""), (None, "a b c d e f", ""), (1, "a b c d e f", ""), (1, "a b c d e f", ""),
            (2, "g h i j k l", ""), (1, "g h i j k l", ""), (7, long, ""), (6, long + " end", ""), (9, None, None)]
    got = near_dup.groups(spark.createDataFrame(rows, DOC)).collect()
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    assert found == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 3 + [(2, 1, False), (7, 6, False), (6, 6, True), (9, 9, True)], key=str)


def test_empty_table(spark):
    assert near_dup.groups(spark.createDataFrame([], DOC)).collect() == []


def test_members_apart_in_the_bucket_of_a_leader(spark, monkeypatch):
    """A bucket whose smallest member resembles none of the others still links the others."""
    base = " ".join(f"v{i}" for i in range(60))
    rows = [(1, " ".join(f"u{i}" for i in range(60)), ""), (2, base, ""), (3, base + " more", ""), (4, "even " + base, "")]
    monkeypatch.setattr(near_dup, "band_keys", lambda least: np.tile(np.arange(near_dup.BANDS), (len(least), 1)))
    docs = spark.createDataFrame(rows, DOC)
    signed = [tuple(r) for r in near_dup.signed(docs).collect()]
    # Python workers do not see the patch; the table is made here instead.
    table = spark.createDataFrame([(*r[:3], list(range(near_dup.BANDS)), r[4]) for r in signed], near_dup.signed(docs).schema)
    monkeypatch.setattr(near_dup, "signed", lambda _: table)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(20)]
    nodes = {n for link in links for n in link}
    got = components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint"))
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert {n: roots.get(n, n) for n in nodes} == brute.connected(nodes, links)


def test_shingle_sets_have_the_right_sizes_in_any_block(monkeypatch):
    texts = list(sample_texts().values())
    whole = list(shingle_sets(texts))
    assert [len(s) for s in whole] == [len(brute.shingles(t)) for t in texts]
    monkeypatch.setattr("seamstat.llm.shingles.BYTES_AT_ONCE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingle_sets(texts), strict=True))


@pytest.mark.parametrize("common, left, right", [(3, 0, 1), (6, 1, 1), (9, 0, 3), (12, 2, 2), (30, 5, 5), (4, 0, 1), (33, 4, 4)])
def test_signatures_of_small_sets_keep_near_pairs(common, left, right):
    """Sets of 3 to 40 shingles at 0.75 to 0.81 are not told apart by their signatures."""
    draw = np.random.default_rng(common)
    first, second = [], []
    for _ in range(400):
        values = draw.integers(0, 2**64, common + left + right, np.uint64)
        first.append(np.sort(values[: common + left]))
        second.append(np.sort(np.concatenate([values[:common], values[common + left :]])))
    a, b = (near_dup.packed(near_dup.minima(sets)) for sets in (first, second))
    differing = np.bitwise_count((a ^ b).view(np.uint64)).sum(1)
    assert (differing > 165).sum() <= 2


def test_short_near_copies_equal_brute_force(spark):
    """Texts of 7 to 44 words and copies at 0.75 to 0.82 that lack or change words at their end."""
    draw, texts = random.Random(12), {}
    for i in range(300):
        shingles = draw.randint(3, 40)
        words = [f"{i}w{k}" for k in range(shingles + 4)]
        more = next(m for m in range(shingles + 1, 0, -1) if 100 * shingles >= 75 * (shingles + m))
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join([*words, *[f"{i}v{k}" for k in range(more)]])
    got = near_dup.groups(spark.createDataFrame([(i, t, "") for i, t in texts.items()], DOC)).collect()
    _, component = brute.near_duplicates(texts)
    assert sum(component[i] != i for i in texts) == 300
    missed = [r["doc_id"] for r in got if r["component_id"] != component[r["doc_id"]]]
    assert len(missed) <= 1  # 5e-4 of the pairs at exactly 0.75


def test_batches_of_blank_texts(spark):
    """A table, and one partition among several, whose texts are all blank."""
    blank = spark.createDataFrame([(1, None, ""), (2, " \n", ""), (3, "", "")], DOC)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert sorted(map(tuple, near_dup.groups(blank).collect())) == want
    more = spark.createDataFrame([(4, "a b c d e f", ""), (5, "A b c d e f", "")], DOC)
    got = sorted(map(tuple, near_dup.groups(blank.coalesce(1).union(more)).collect()))
    assert got == [*want, (4, 2, 4, True), (5, 2, 4, False)]


def test_signatures_do_not_depend_on_the_slices():
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**64, 5 + i, np.uint64)) for i in range(30)]
    whole = near_dup.packed(near_dup.minima(sets))
    assert whole.shape == (30, near_dup.MINIMA // 64)
    assert (whole == np.concatenate([near_dup.packed(near_dup.minima(sets[i : i + 7])) for i in range(0, 30, 7)])).all()


def test_forest_of_links_takes_one_shuffle(spark, monkeypatch):
    """Each shuffle costs as many tasks as there are shuffle partitions, however small the table."""
    links = [(i, i // 2) for i in range(2, 200)] + [(1000 + i, 1001 + i) for i in range(100)]
    found, real = [], closing.stored

    def counted(df, name):
        found.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(df, name)

    monkeypatch.setattr(closing, "stored", counted)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert roots == {i: 1 for i in range(2, 200)} | {i: 1000 for i in range(1001, 1101)}
    assert sum(found) <= 2


def test_roots_of_components_that_are_joined_later(spark):
    component = spark.createDataFrame([(2, 1), (3, 1), (6, 5)], "node bigint, root bigint")
    more = spark.createDataFrame([(5, 1), (9, 8)], "node bigint, root bigint")
    got = {r["node"]: r["root"] for r in merged(component, more).collect()}
    assert got == {2: 1, 3: 1, 6: 1, 5: 1, 9: 8}
