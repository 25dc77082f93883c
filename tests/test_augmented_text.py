"""The augmented text against plain Python."""

from pyspark.sql import functions as F

from seamstat.operators.survey import survey_defaults, with_augmented_text


def test_text_is_stripped_like_python_and_tagged(spark):
    pairs = [("", ""), (" a", "b \x1c"), (None, "x"), (" t ", "  "), ("", "\x1f y\u0085z "), ("a\n", " b")]
    frame = survey_defaults(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, Title string, `Review Text` string"))
    tagged = frame.withColumns({"survey_size_vs_usual": F.lit(-1.0), "survey_return_likelihood": F.lit(0.7)})
    bases = [f"{t or ''} {r or ''}".strip() for t, r in pairs]
    assert [r["text"] for r in with_augmented_text(frame).orderBy("i").collect()] == bases
    want = [f"{b} high_return_intent runs_small".strip() for b in bases]
    assert [r["text"] for r in with_augmented_text(tagged).orderBy("i").collect()] == want
