import zlib

import numpy as np
import pytest

from seamstat.llm import language_id as li
from seamstat.llm import registry

SMALL = "/root/testdata/sf0.01"


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or (n == 1 and word not in pieces and word[:1] not in pieces):
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations_and_expected_counts():
    names = ["▁", "a", "b", "ab", "▁a", "bab", "▁ab", "ba"]
    pieces = li.Pieces(names)
    table = np.random.default_rng(1).random((len(pieces.pieces) + 2, 2))
    table[-1] = 0
    row = {p: i for i, p in enumerate(pieces.pieces)}
    words, uses = ["abab", "babz", "a"], np.array([[1.0, 2.0], [3.0, 0.0], [1.0, 1.0]])
    model = li.LanguageModel(pieces.pieces, ["x", "y"], table)
    logs = model.word_logs(words)
    counts = np.zeros_like(table)
    for w, word in enumerate(words):
        ways = [[row.get(p, pieces.unknown) for p in s] for s in segmentations("▁" + word, row)]
        chances = np.array([np.prod(table[way], axis=0) for way in ways])
        assert np.allclose(logs[w], np.log(chances.sum(0)))
        for way, chance in zip(ways, chances, strict=True):
            for p in way:
                counts[p] += uses[w] * chance / chances.sum(0)
    assert np.allclose(li.expected_counts(pieces, words, uses, table), counts)


def test_held_out_accuracy_and_contract(spark):
    got = registry.QUERIES["op1_language_id"](spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(got)
    assert list(got.columns[:4]) == ["doc_id", "held_out", "lang_pred", "score"]
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"]]).all()
    test = both[both["held_out"] & both["lang"].notna()]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.98
    assert both["score"].between(0, 1).all()


@pytest.fixture(scope="module")
def trained(spark):
    return li.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), per_language=40, rounds=2)


def test_held_out_labels_are_not_learnt(spark, trained):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    hidden = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    again = li.fit(hidden, per_language=40, rounds=2)
    assert again.languages == trained.languages and np.array_equal(again.table, trained.table)


def test_nulls_blanks_long_and_repeated_rows(spark, trained):
    rows = [
        (1, None, 0.5, "x"), (2, "", 0.5, "x"), (3, "12 34 !?", 0.5, "x"), (4, "the and of the this", None, None),
        (4, "the and of the this", None, None), (None, "der die und das", 1.0, "y"), (5, "the " * 100_000 + "z" * 5000, 0.0, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in li.predict(docs, trained).collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert got[3] == got[4] == (4, "en") and got[5] == (None, "de") and got[6] == (5, "en")
    kept = li.keep_known(docs, trained)
    assert kept.schema == docs.schema
    assert [r["doc_id"] for r in kept.collect()] == [4, 4, None, 5]


def test_empty_table_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    model = li.fit(empty)
    assert model.languages == [] and li.predict(empty, model).collect() == []
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    assert li.predict(docs, li.fit(docs)).first()[1:] == ("und", 0.0)


def test_words_beyond_the_remembered_number(trained, monkeypatch):
    texts = [f"the of and {'ab' * (i % 7 + 1)}" for i in range(50)]
    whole = trained.score(texts)
    monkeypatch.setattr(li, "REMEMBERED_BYTES", 300)
    monkeypatch.setattr(li, "CHARS_AT_ONCE", 40)
    assert trained.score(texts) == whole


def test_number_signs_are_no_letters_but_hide_none():
    assert li.words_of("m² ²a ½cup ab²cd Ⅷ 12 _x_") == ["m", "a", "cup", "ab", "cd", "x"]
    assert li.words_of("² ½ 34 !") == []
