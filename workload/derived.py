"""Review, survey and image tables derived from the given star-schema tables.

One review per order. Every document is the whole body of exactly one review, every part
and customer contributes its attributes, and every embedding becomes one small picture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamstat.functions.partitioning import spread
from seamstat.operators.cleaning import clean_reviews
from seamstat.operators.survey import answers_for
from seamstat.operators.text_features import text_features
from seamstat.plans.scoring import linear_score

SENTENCES = [
    "I absolutely LOVE this dress! Perfect fit, great quality cotton. Would recommend to friends.",
    "Runs small and the material feels cheap. Very disappointed; it was return only.",
    "Don't buy! Color off, not as pictured. I wasn't happy with the price.",
    "True to color, as pictured. Soft navy and ivory silk, flattering and comfortable.",
    "Arrived late, packaging ripped. Shipping was slow... refund requested?",
    "Highly recommend this striped linen blouse. Will buy again & again #fav #ootd",
    "The zipper and hem were defective. A hole and pilling after 2 wears!!! Never again.",
    "Oversized boxy cropped sweater, scratchy wool. Long sleeve, short waist.",
    "Worth the money on sale. Bright red floral print, vivid and dark blue lace.",
    "ok",
    "My favorite! ☀☁❤ I would recommend, tell friends, purchase again. ² ① ٣ 5",
    "'love' ill-fitting true-to-size İstanbul ⒶⅧ É. Looks different than online",
    "...!!!???",
]
TITLES = [
    "Perfect fit and beautiful fabric", "Not worth the price", "Okay but nothing special",
    "NO WAY!", "", "So pretty, so soft", "Wrong color",
]
# Order keys per document: document d is the body of review d * DOCUMENT_STRIDE.
DOCUMENT_STRIDE = 7
UNSURVEYED = ["4-NOT SPECIFIED", "5-LOW"]

CHANNELS = ["Online", "In-store", "Gift", "Marketplace"]
SIZES = ["Runs small", "True to size", "Runs large"]
BOOLEAN_KEYS = """
first_time_buyer compared_alternatives gift_purchase alterations_needed odor_issue
support_contact photo_uploaded
""".split()
LIKERT_KEYS = """
fit_vs_expectation material_vs_price durability_expectation color_accuracy
shipping_satisfaction packaging_quality
""".split()
SHARE_KEYS = """
return_likelihood repurchase_likelihood occasion_formality season_match care_difficulty
sustainability_importance price_sensitivity brand_loyalty
""".split()
# Position of every answer column, used to vary values and gaps.
ANSWER_ORDER = """
purchase_channel days_since_purchase first_time_buyer compared_alternatives gift_purchase
fit_vs_expectation size_vs_usual alterations_needed comfort_hours worn_before_review
material_vs_price durability_expectation color_accuracy odor_issue shipping_satisfaction
packaging_quality support_contact return_likelihood repurchase_likelihood
occasion_formality season_match care_difficulty sustainability_importance
price_sensitivity brand_loyalty photo_uploaded
""".split()

# A small linear scorer with given weights, so that scores can be checked in plain SQL.
WEIGHTS = {
    "Rating": 0.75,
    "Age": -0.01,
    "Positive Feedback Count": 0.02,
    "nlp_sentiment_pos": 0.55,
    "nlp_sentiment_neg": -0.65,
    "nlp_negation_count": -0.3,
    "nlp_recommend_signal": 0.8,
    "nlp_return_mentions": -0.45,
    "nlp_uppercase_ratio": -1.5,
    "nlp_avg_sentence_len": -0.002,
    "vis_photo_accuracy_signal": 0.35,
    "vis_stain_damage_mentions": -0.5,
}
INTERCEPT = -1.75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews: text with gaps, numbers with gaps, categories with gaps, optional target."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    bodies = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") * DOCUMENT_STRIDE).alias("o_orderkey"), F.col("text").alias("body")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment"
    )
    part_count = parts.agg(F.count(F.lit(1)).alias("n_parts"))
    keyed = orders.withColumn("p_partkey", F.col("o_orderkey") % part_count.scalar())
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    stars = 1 + (n * 7 + c) % 5
    said = F.concat(_pick(SENTENCES, n), F.lit(" The "), F.col("p_name"), F.lit("."))
    return (
        keyed.join(customers, "o_custkey")
        .join(parts, "p_partkey")
        .join(bodies, "o_orderkey", "left")
        .select(
            n.alias("review_id"),
            F.when(n % 11 != 0, _pick(TITLES, c)).alias("Title"),
            F.when(F.col("body").isNotNull(), F.concat(said, F.lit(" "), F.col("body")))
            .when(n % 17 != 0, said)
            .alias("Review Text"),
            F.when(n % 37 != 0, (18 + c % 85).cast("double")).alias("Age"),
            F.when(n % 41 != 0, (n % 15).cast("double")).alias("Positive Feedback Count"),
            stars.cast("double").alias("Rating"),
            F.when(n % 29 != 0, F.col("c_mktsegment")).alias("Division Name"),
            F.col("p_brand").alias("Department Name"),
            F.col("p_type").alias("Class Name"),
            F.when(n % 53 != 0, (stars + c % 3 >= 5).cast("int")).alias("Recommended IND"),
        )
    )


def survey_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to 26 questions, with gaps, for all but the low-priority orders."""
    n = F.col("o_orderkey")

    def value(key: str, k: int) -> Column:
        if key == "purchase_channel":
            return _pick(CHANNELS, n)
        if key == "size_vs_usual":
            return _pick(SIZES, n)
        if key in BOOLEAN_KEYS:
            return (n + k) % 2 == 0
        if key in LIKERT_KEYS:
            return 1 + (n * 3 + k) % 5
        if key in SHARE_KEYS:
            return ((n * 7 + k) % 21) / F.lit(20.0)
        return {
            "days_since_purchase": n % 91,
            "comfort_hours": (n % 25) / F.lit(2.0),
            "worn_before_review": n % 21,
        }[key]

    columns = [
        F.when((n + k) % 7 != 0, value(key, k)).alias(key) for k, key in enumerate(ANSWER_ORDER)
    ]
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return orders.where(~F.col("o_orderpriority").isin(UNSURVEYED)).select(
        n.alias("review_id"), *columns
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 picture per embedding: channel values are digits of its 64 entries."""
    e, i = F.col("e").cast("double"), F.col("i")
    channel = lambda factor: F.pmod(F.floor(e * factor).cast("bigint"), F.lit(256))
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
        .select(
            "image_id",
            F.floor(i / 8).cast("int").alias("y"),
            (i % 8).cast("int").alias("x"),
            channel(1000).alias("r"),
            channel(3000).alias("g"),
            channel(7000).alias("b"),
        )
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_reviews(reviews(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned reviews with text features, score, prediction and label."""
    return linear_score(text_features(cleaned(spark, sf_dir)), WEIGHTS, INTERCEPT)


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reviews with the raw answers of those who gave any."""
    return answers_for(scored(spark, sf_dir), survey_answers(spark, sf_dir))
