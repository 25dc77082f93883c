"""Shape of the physical plans, and the same plans on a stream."""

import re

from seamstat.plans.scoring import linear_score
from seamstat.operators import explain as ex
from seamstat.operators.learning import stratified_split
from seamstat.streaming.scoring import review_stream, score_stream
from tests.conftest import COLUMNS, PRESETS, SMALL
from workload import catalog, derived as dv


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_not_shuffled_for_rankings(spark):
    narrow = ["survey_report", "survey_profile", "batch_signals", "rating_sensitivity", "review_emoji"]
    for name in narrow:
        plan = physical(catalog.QUERIES[name](spark, SMALL))
        assert "Window" not in plan and "Cartesian" not in plan, name
    frame = catalog.full_frame(spark, SMALL)
    base = physical(frame).count("Exchange hashpartitioning")
    for view in (ex.top_signals, ex.feature_breakdown, ex.modality_drivers, ex.feature_matrix, ex.modality_strength):
        assert physical(view(frame)).count("Exchange hashpartitioning") == base


def test_scans_read_only_what_is_used(spark):
    plan = physical(catalog.QUERIES["department_volume"](spark, SMALL))
    assert "text" not in "".join(re.findall(r"ReadSchema: struct<[^>]*>", plan))
    split = stratified_split(dv.cleaned(spark, SMALL)).select("review_id", "split")
    assert "p_name" not in physical(split)


def test_files_are_scored_as_they_arrive(spark, tmp_path):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    (tmp_path / "in").mkdir()
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    header = ",".join(quote(c) for c in COLUMNS)

    def arrive(name, rows):
        lines = [header] + [",".join(map(quote, row)) for row in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    scorer = lambda frame: linear_score(frame, dv.WEIGHTS, dv.INTERCEPT)
    for i, rows in enumerate((PRESETS[:2], PRESETS[2:])):
        arrive(f"{i}.csv", rows)
        score_stream(review_stream(spark, folder, COLUMNS), scorer, out, progress).awaitTermination()
        assert spark.read.parquet(out).count() == (2, 3)[i]
    labels = {r["Title"]: r["recommended_label"] for r in spark.read.parquet(out).collect()}
    assert labels[PRESETS[0][0]] == "Recommended" and labels[PRESETS[1][0]] == "Not recommended"


def test_joins_keep_one_row_per_review(spark, presets):
    """Repeated answers and pictures, and a picture whose name is no key, add no review."""
    from seamstat.operators.enrich import attach_images, attach_survey, unfit_names
    from seamstat.operators.survey import answers_for
    from seamstat.schema import IMAGE_FEATURES

    answers = spark.createDataFrame([(0, 5.0), (0, 2.0), (1, None), (None, 1.0)], "review_id bigint, fit_vs_expectation double")
    joined = attach_survey(presets, answers)
    assert joined.count() == answers_for(presets, answers).count() == 3
    assert {r["review_id"]: r["survey_fit_vs_expectation"] for r in joined.collect()}[0] == 2.0
    zeros = ", ".join(f"CAST(1 AS DOUBLE) AS {n}" for n in IMAGE_FEATURES)
    images = spark.sql(f"SELECT name AS review_id, {zeros} FROM VALUES ('1'), ('1'), ('front'), ('01x') AS t(name)")
    pictured = attach_images(presets, images)
    assert sorted((r["review_id"], r["img_has_image"]) for r in pictured.collect()) == [(0, 0.0), (1, 1.0), (2, 0.0)]
    assert unfit_names(images, presets).first()["unfit"] == 2
