"""Every registered query: name -> function of (spark, folder with the given tables).

Doubles whose value depends on summation order or on a platform's ``exp`` and ``log`` are
rounded here, so that two engines can be compared; the operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamstat.functions.partitioning import spread
from seamstat.operators import cleaning
from seamstat.operators import enrich as en
from seamstat.operators import explain as ex
from seamstat.operators import image_stats as im
from seamstat.operators import learning as ln
from seamstat.operators import rules as ru
from seamstat.operators import segments as sg
from seamstat.operators import survey as sv
from seamstat.operators import survey_report as sr
from seamstat.operators import text_features as tf
from seamstat.plans import scoring as sc
from seamstat.plans import training as tr
from seamstat.schema import (
    CATEGORICAL_COLUMNS,
    CORE_NUMERIC_COLUMNS,
    FORM_COLUMNS,
    IMAGE_FEATURES,
    NLP_FEATURES,
    NUMERIC_COLUMNS,
    SURVEY_FEATURES,
    TARGET_COLUMN,
    VISUAL_FEATURES,
)
from seamstat.sources.scratch import stored
from workload import derived as dv

Query = Callable[[SparkSession, str], DataFrame]
PLACES = 6
IMAGE_PLACES = 9  # means over 64 pixels can be exact ties at 6 places
QUERIES: dict[str, Query] = {}
LINEAR_SIZES = NLP_FEATURES + VISUAL_FEATURES


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named columns, or every double column."""
    chosen = names or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({n: F.round(F.col(n), PLACES) for n in chosen})


def rounded_images(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), IMAGE_PLACES) for n in IMAGE_FEATURES})


def image_table(spark: SparkSession, sf: str) -> DataFrame:
    return im.image_stats_from_pixels(dv.pixels(spark, sf)).withColumnRenamed(
        "image_id", "review_id"
    )


def full_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned reviews with all 72 engineered columns and the augmented text."""
    return en.model_frame(
        dv.reviews(spark, sf), dv.survey_answers(spark, sf), image_table(spark, sf)
    )


def scorer(frame: DataFrame) -> DataFrame:
    return sc.linear_score(frame, dv.WEIGHTS, dv.INTERCEPT)


# -- cleaning and enrichment --------------------------------------------------------------


@query
def clean_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return dv.cleaned(spark, sf)


@query
def form_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews as they come from the entry form, under its field names, cleaned."""
    entries = dv.reviews(spark, sf).withColumnsRenamed({column: field for field, column in FORM_COLUMNS.items()})
    return cleaning.clean_reviews(cleaning.from_form(entries))


@query
def enrich_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = en.attach_survey(dv.cleaned(spark, sf), dv.survey_answers(spark, sf))
    joined = en.attach_images(joined, image_table(spark, sf))
    return rounded_images(joined.select("review_id", *SURVEY_FEATURES, *IMAGE_FEATURES))


@query
def model_frame(spark: SparkSession, sf: str) -> DataFrame:
    frame = full_frame(spark, sf)
    columns = ["review_id", *NUMERIC_COLUMNS, *CATEGORICAL_COLUMNS, TARGET_COLUMN, "text"]
    return rounded_images(frame.select(*columns))


# -- text features ------------------------------------------------------------------------


@query
def nlp_features(spark: SparkSession, sf: str) -> DataFrame:
    return tf.nlp_features(dv.reviews(spark, sf)).select("review_id", *NLP_FEATURES)


@query
def nlp_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(dv.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    documents = documents.withColumn("title", F.lit(None).cast("string"))
    return tf.nlp_features(documents, "title", "text").select("doc_id", *NLP_FEATURES)


@query
def vision_text_features(spark: SparkSession, sf: str) -> DataFrame:
    return tf.visual_text_features(dv.reviews(spark, sf)).select("review_id", *VISUAL_FEATURES)


# -- images -------------------------------------------------------------------------------


@query
def image_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_images(im.image_stats_from_pixels(dv.pixels(spark, sf)))


@query
def image_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ex.image_profile(im.image_stats_from_pixels(dv.pixels(spark, sf))))


# -- survey -------------------------------------------------------------------------------


def encoded_with_answers(spark: SparkSession, sf: str) -> DataFrame:
    return sv.encode_survey(dv.survey_answers(spark, sf), keep_answers=True)


@query
def survey_encode(spark: SparkSession, sf: str) -> DataFrame:
    return sv.encode_survey(dv.survey_answers(spark, sf))


@query
def survey_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return sv.survey_defaults(dv.reviews(spark, sf).select("review_id"))


@query
def survey_augmented_text(spark: SparkSession, sf: str) -> DataFrame:
    joined = en.attach_survey(dv.cleaned(spark, sf), dv.survey_answers(spark, sf))
    return sv.with_augmented_text(joined).select("review_id", "text")


@query
def survey_report(spark: SparkSession, sf: str) -> DataFrame:
    return sr.survey_report(encoded_with_answers(spark, sf))


@query
def survey_sections(spark: SparkSession, sf: str) -> DataFrame:
    return sr.section_counts(sr.survey_report(encoded_with_answers(spark, sf)))


@query
def survey_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sv.survey_profile(sv.encode_survey(dv.survey_answers(spark, sf))))


@query
def survey_likert(spark: SparkSession, sf: str) -> DataFrame:
    return sv.survey_likert(dv.survey_answers(spark, sf))


@query
def journey_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sv.journey_funnel(dv.scored_answers(spark, sf), ["review_id"]))


@query
def journey_by_department(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sv.journey_by_segment(dv.scored_answers(spark, sf)))


@query
def journey_links(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sv.journey_links(dv.scored_answers(spark, sf)))


@query
def intent_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sv.intent_gauges(dv.scored_answers(spark, sf)))


# -- learning -----------------------------------------------------------------------------


@query
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    raw = dv.reviews(spark, sf).select("review_id", *CORE_NUMERIC_COLUMNS)
    return ln.impute_median(raw, CORE_NUMERIC_COLUMNS)


@query
def scale_numeric(spark: SparkSession, sf: str) -> DataFrame:
    columns = CORE_NUMERIC_COLUMNS + LINEAR_SIZES + SURVEY_FEATURES
    frame = sv.survey_defaults(tf.text_features(dv.cleaned(spark, sf)))
    return rounded(ln.scale_numeric(frame.select("review_id", *columns), columns))


@query
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    raw = dv.reviews(spark, sf).select("review_id", *CATEGORICAL_COLUMNS)
    return ln.impute_mode(raw, CATEGORICAL_COLUMNS)


@query
def onehot(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = dv.cleaned(spark, sf)
    return ln.onehot(cleaned, stored(ln.category_positions(cleaned), "categories"))


@query
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    joined = en.attach_survey(dv.cleaned(spark, sf), dv.survey_answers(spark, sf))
    return rounded(ln.tfidf_weights(sv.with_augmented_text(joined), ln.default_stop_words()))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return ln.stratified_split(dv.cleaned(spark, sf)).select("review_id", TARGET_COLUMN, "split")


@query
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ln.class_weights(dv.cleaned(spark, sf))


@query
def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        dv.scored(spark, sf).select("review_id", "score", "prediction", "recommended_label")
    )


@query
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ln.eval_metrics(dv.scored(spark, sf)))


@query
def prediction_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    compared = ln.prediction_vs_actual(dv.scored(spark, sf))
    return compared.select("review_id", TARGET_COLUMN, "prediction", "correct")


@query
def batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """Train the full text + number + category model, then score every raw review with it."""
    raw = dv.reviews(spark, sf)
    model, _ = tr.train_and_evaluate(raw)
    return sc.batch_score(raw, model)


@query
def fit_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Train the full model and compare the gradient of every column with the solver's tolerance."""
    model, _ = tr.train_and_evaluate(dv.reviews(spark, sf))
    return tr.certificate(model).select("block", "columns", "settled")


@query
def batch_score_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.batch_score(dv.reviews(spark, sf), scorer))


@query
def rating_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sc.rating_sensitivity(dv.reviews(spark, sf), scorer), "score")


# -- explanation --------------------------------------------------------------------------


@query
def feature_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return ex.feature_breakdown(ranked_frame(spark, sf))


def ranked_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The feature frame with rounded image values, so that both engines rank alike."""
    return rounded_images(full_frame(spark, sf))


@query
def top_signals(spark: SparkSession, sf: str) -> DataFrame:
    return ex.top_signals(ranked_frame(spark, sf))


@query
def modality_strength(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ex.modality_strength(ranked_frame(spark, sf)))


@query
def modality_drivers(spark: SparkSession, sf: str) -> DataFrame:
    return ex.modality_drivers(ranked_frame(spark, sf))


@query
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ex.feature_matrix(ranked_frame(spark, sf))


# -- business rules -----------------------------------------------------------------------


def explained_answers(spark: SparkSession, sf: str) -> DataFrame:
    return sv.answers_for(scorer(ranked_frame(spark, sf)), dv.survey_answers(spark, sf))


@query
def review_emoji(spark: SparkSession, sf: str) -> DataFrame:
    return ru.review_emoji(dv.scored_answers(spark, sf)).select("review_id", "emoji_summary")


@query
def review_insights(spark: SparkSession, sf: str) -> DataFrame:
    told = ru.review_insights(explained_answers(spark, sf))
    return told.select("review_id", F.posexplode_outer("insights").alias("place", "insight"))


@query
def batch_signals(spark: SparkSession, sf: str) -> DataFrame:
    signals = ru.batch_signals(dv.scored(spark, sf))
    return signals.select(
        "review_id", "recommended_label", "business_emoji", "local_ai_insight"
    )


@query
def predict_and_explain(spark: SparkSession, sf: str) -> DataFrame:
    """Score and breakdown of each review in one record, unfolded for the comparison."""
    told = ex.explained(scorer(ranked_frame(spark, sf)))
    grouped = told.select(
        "review_id", "score", "prediction", "recommended_label", F.explode_outer("breakdown").alias("group", "features")
    )
    unfolded = grouped.select(*grouped.columns[:-1], F.explode_outer("features").alias("feature", "value"))
    return rounded(unfolded, "score")


@query
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    scored = dv.scored(spark, sf)
    return scored.select("review_id", ru.verdict(F.col("prediction")).alias("verdict"))


@query
def batch_preview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.batch_preview(ru.batch_signals(dv.scored(spark, sf))))


# -- segments -----------------------------------------------------------------------------


@query
def corpus_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.corpus_kpis(dv.cleaned(spark, sf)))


@query
def catalog_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.catalog_hierarchy(dv.cleaned(spark, sf)))


@query
def catalog_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.catalog_rollup(dv.cleaned(spark, sf)))


@query
def department_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.department_volume(dv.cleaned(spark, sf)))


@query
def age_rating_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.age_rating(dv.cleaned(spark, sf)), "recommend")


@query
def age_rating_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.age_rating_pivot(dv.cleaned(spark, sf), sc.RATINGS))


@query
def department_landscape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.department_landscape(dv.cleaned(spark, sf)))


@query
def dept_rating_box(spark: SparkSession, sf: str) -> DataFrame:
    return sg.department_rating_box(dv.cleaned(spark, sf))


@query
def market_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sg.market_sample(dv.cleaned(spark, sf))


@query
def batch_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.batch_sample(dv.scored(spark, sf)))


@query
def random_review(spark: SparkSession, sf: str) -> DataFrame:
    return sg.random_review(dv.cleaned(spark, sf), seed=7)


@query
def batch_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sg.batch_kpis(dv.scored(spark, sf)))


@query
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return sg.score_histogram(dv.scored(spark, sf))


@query
def category_options(spark: SparkSession, sf: str) -> DataFrame:
    return sg.category_options(dv.cleaned(spark, sf))
