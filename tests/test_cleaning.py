import math

import pandas as pd
import pytest

from seamstat.operators.cleaning import clean_reviews, fill_columns, from_form, with_review_id
from seamstat.schema import TARGET_COLUMN

NUMBERS = ["5d", "5f", "0x1A", "0x1p3", "1.", ".5", "+3", "-2.5E-3", "1e3", "1_0", "1,000",
           "inf", "-inf", "Infinity", "nan", "NaN", "1e", "--1", " 5 ", "", "abc", None]


def test_numbers_are_read_like_pandas_reads_them(spark, presets):
    base = presets.limit(1).drop("Age")
    ages = spark.createDataFrame([(i, v) for i, v in enumerate(NUMBERS)], "i int, Age string")
    got = [r["Age"] for r in fill_columns(base.crossJoin(ages)).orderBy("i").collect()]
    want = pd.to_numeric(pd.Series(NUMBERS), errors="coerce").fillna(0).tolist()
    assert got == want


def test_gaps_and_target(spark, presets):
    rows = [(None, None, math.nan, None, 4.0, None, "Tops", None, 1.9),
            ("a", "b", 1.0, 2.0, 3.0, "x", "y", "z", None),
            ("a", "b", 1.0, 2.0, 3.0, "x", "y", "z", math.nan),
            ("a", "b", 1.0, 2.0, 3.0, "x", "y", "z", -0.5)]
    numeric = ("Age", "Positive Feedback Count", "Rating", TARGET_COLUMN)
    names = [c for c in presets.columns if c != "review_id"] + [TARGET_COLUMN]
    ddl = ", ".join(f"`{c}` {'double' if c in numeric else 'string'}" for c in names)
    frame = spark.createDataFrame(rows, ddl)
    first, last = clean_reviews(frame).orderBy("Age").collect()
    assert tuple(first) == ("", "", 0.0, 0.0, 4.0, "Unknown", "Tops", "Unknown", 1)
    assert last[TARGET_COLUMN] == 0
    assert fill_columns(frame).count() == 4
    assert clean_reviews(frame.drop(TARGET_COLUMN)).count() == 4


def test_missing_columns_are_named(presets):
    with pytest.raises(KeyError, match="Rating"):
        clean_reviews(presets.drop("Rating"))


def test_content_keys_are_stable(presets):
    keyed = with_review_id(presets.drop("review_id"))
    a = {r["Title"]: r["review_id"] for r in keyed.collect()}
    b = {r["Title"]: r["review_id"] for r in with_review_id(presets.drop("review_id").repartition(3)).collect()}
    assert a == b and len(set(a.values())) == 3


def test_form_fields_become_columns(spark):
    entries = spark.createDataFrame([("T", "R", 30, 2, 5, None, "Tops", "Knits", "x")], "title string, review string, age int, feedback int, rating int, division string, department string, class_name string, extra string")
    row = clean_reviews(from_form(entries)).first().asDict()
    assert row == {"Title": "T", "Review Text": "R", "Age": 30.0, "Positive Feedback Count": 2.0, "Rating": 5.0, "Division Name": "Unknown", "Department Name": "Tops", "Class Name": "Knits", "extra": "x"}
    with pytest.raises(KeyError, match="class_name"):
        from_form(entries.drop("class_name"))
