import math
import random

from pyspark.sql import functions as F

from seamstat.functions.numeric import fixed, percent
from seamstat.operators.rules import batch_signals, review_emoji
from seamstat.operators import explain as ex
from seamstat.schema import FEATURES


def test_fixed_point_text_equals_python(spark):
    rng = random.Random(5)
    values = [k / 1000 for k in range(-300, 1300)] + [k / 64 for k in range(200)]
    values += [rng.uniform(-50, 50) for _ in range(500)] + [0.155, 0.145, 0.135, 2.675, 1e6 + 0.005]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select(
        "v", *[fixed(F.col("v"), d).alias(f"d{d}") for d in range(4)], percent(F.col("v"), 1).alias("p")
    ).collect()
    for row in got:
        v = row["v"]
        assert [row[f"d{d}"] for d in range(4)] == [f"{v:.{d}f}" for d in range(4)], v
        assert row["p"] == f"{v:.1%}", v


def _batch(spark, rows):
    names = "prediction int, score double, Rating double, `Positive Feedback Count` double"
    return spark.createDataFrame(rows, names)


def test_batch_rules_at_their_thresholds(spark):
    rows = [(1, 0.8, 4.0, 8.0), (1, 0.79, 3.0, 7.0), (0, 0.65, 2.5, 0.0), (0, 0.4, 0.0, 0.0),
            (1, 0.55, 4.0, 0.0), (1, 0.9, math.nan, math.nan), (0, 0.4, None, None)]
    got = [(r["business_emoji"], r["local_ai_insight"].split()[0]) for r in batch_signals(_batch(spark, rows)).collect()]
    assert got == [
        ("✅ Strong buy signal | ⭐ High rating | 👍 Helpful traction", "Promote"),
        ("🤔 Mixed signal", "Monitor"),
        ("🤔 Mixed signal | ⭐ Low rating", "Prioritize"),
        ("⚠️ Risk signal", "Monitor"),
        ("🤔 Mixed signal | ⭐ High rating", "Star"),
        ("✅ Strong buy signal", "Promote"),
        ("⚠️ Risk signal", "Monitor"),
    ]


def test_summary_keeps_five_tags(spark):
    frame = _batch(spark, [(1, 0.9, 5.0, 9.0)]).withColumns(
        {"repurchase_likelihood": F.lit(0.9), "return_likelihood": F.lit(0.6), "photo_uploaded": F.lit(True)}
    )
    tags = review_emoji(frame).first()["emoji_summary"].split(" | ")
    assert tags == ["✅ Strong recommend signal", "⭐ High rating", "🔁 High repurchase intent",
                    "↩️ High return risk", "👍 Helpful-vote traction"]
    plain = review_emoji(_batch(spark, [(0, 0.2, None, None)])).first()["emoji_summary"]
    assert plain == "⚠️ Low recommend signal | ⭐ Low rating | 📦 Low return risk"


def test_text_columns_are_read_loosely(spark):
    frame = spark.createDataFrame([("1", "0.9", "4d", "1_0")], "prediction string, score string, Rating string, `Positive Feedback Count` string")
    assert batch_signals(frame).first()["business_emoji"] == "✅ Strong buy signal | 👍 Helpful traction"


def test_short_labels_are_unique():
    assert len({f.short_label for f in FEATURES}) == len(FEATURES) == 72
    assert ex.display_rule(FEATURES[0]) == ("signed", 400.0)
