import numpy as np
import pytest
from pyspark.sql import functions as F

from seamstat.functions.quantiles import exact_quantiles, quantiles_of_counts
from seamstat.operators import learning as ln
from seamstat.operators.enrich import model_frame
from seamstat.operators.survey import encode_survey
from seamstat.plans.scoring import batch_score, rating_sensitivity
from seamstat.functions.numbering import sorted_ranges
from seamstat.plans.training import certificate, gradients, solver_tasks, train
from seamstat.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, TARGET_COLUMN
from seamstat.sources.models import load_model, save_model
from seamstat.sources.scratch import shared_folder, stored


@pytest.fixture(scope="module")
def labelled(spark, presets):
    """90 variations of the three presets, stars and outcome loosely related."""
    copies = spark.range(30).withColumnRenamed("id", "copy")
    n = F.col("review_id") * 30 + F.col("copy")
    frame = presets.crossJoin(copies).withColumns(
        {
            "Review Text": F.concat("Review Text", F.lit(" word"), (n % 7).cast("string"), F.lit(" again")),
            "Rating": (1 + (n * 7) % 5).cast("string"),
            "Age": (20 + n % 40).cast("string"),
            TARGET_COLUMN: ((n * 7 % 5 + n % 3) >= 3).cast("int"),
        }
    )
    return stored(model_frame(frame.withColumn("review_id", n).drop("copy")), "labelled")


@pytest.fixture(scope="module")
def model(labelled):
    return train(labelled, tolerance=1e-9, max_iterations=400)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"smooth": rng.normal(size=100_000), "ties": rng.integers(0, 4, 5_000).astype(float), "one": np.array([3.5]),
              "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("smooth", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for row in exact_quantiles(frame, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert row["v"] == pytest.approx(np.quantile(groups[row["g"]], row["q"]), abs=1e-12)


def test_quantiles_with_infinite_and_crowded_values(spark):
    values = {"wide": [-np.inf, -1e308, 0.0, 5e-324, 1e308, np.inf], "near": [1 + i * 2e-16 for i in range(40)] + [1e9], None: [2.0, 4.0]}
    frame = spark.createDataFrame([(g, float(v)) for g, some in values.items() for v in some], "g string, v double")
    for row in exact_quantiles(frame, ["g"], "v", [0.0, 0.2, 0.5, 0.6, 1.0]).collect():
        some, place = sorted(values[row["g"]]), (len(values[row["g"]]) - 1) * row["q"]
        low, high = some[int(np.floor(place))], some[int(np.ceil(place))]
        want = low if place == int(place) else low + (high - low) * (place - np.floor(place))
        assert row["v"] == want or abs(row["v"] - want) < 1e-15
    assert exact_quantiles(frame.limit(0), ["g"], "v", [0.5]).collect() == []


def test_narrowing_has_windows_over_steps_only(spark):
    """No window's rows grow with the group: the last plan reads closed brackets."""
    frame = spark.range(50_000).selectExpr("id % 2 AS g", "sin(id) AS v")
    plan = exact_quantiles(frame, ["g"], "v", [0.25, 0.75])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_quantiles_of_counts_equal_those_of_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), rng.integers(1, 6, 900))]
    frame = spark.createDataFrame(rows, "g int, v double")
    counts = frame.groupBy("g", "v").count()
    for row in quantiles_of_counts(counts, ["g"], "v", "count", [0.1, 0.5, 0.75]).collect():
        assert row["v"] == pytest.approx(np.quantile([v for g, v in rows if g == row["g"]], row["q"]), abs=1e-12)


def quotas(frame):
    return {r[TARGET_COLUMN]: r["quota"] for r in ln.hold_out_quotas(ln.class_counts(frame), 0.2).collect()}


def classes(spark, counts):
    rows = [(c,) for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, f"`{TARGET_COLUMN}` int")


def test_quotas_follow_class_shares(spark):
    assert quotas(classes(spark, {0: 30, 1: 70})) == {0: 6, 1: 14}
    assert sum(quotas(classes(spark, {0: 7, 1: 11, 2: 13})).values()) == 7
    with pytest.raises(Exception, match="too few rows"):
        quotas(classes(spark, {0: 1, 1: 50}))


def test_split_is_exact_and_repeatable(spark):
    frame = spark.range(5_003).select(F.col("id").alias("review_id"), (F.col("id") % 3 == 0).cast("int").alias(TARGET_COLUMN))
    split = ln.stratified_split(frame)
    counts = {(r[0], r[1]): r[2] for r in split.groupBy(TARGET_COLUMN, "split").count().collect()}
    assert {c: counts[c, "test"] for c in (0, 1)} == quotas(frame) and sum(counts.values()) == 5_003
    again = ln.stratified_split(frame.repartition(5))
    assert split.exceptAll(again).isEmpty()


@pytest.mark.parametrize("keys", [1, 4])
def test_split_quota_holds_for_repeated_keys(spark, keys):
    """Rows of one key, equal or not, are divided where the quota falls between them."""
    number = F.col("id")
    frame = spark.range(1_000).select(
        (number % keys).alias("review_id"), (number % 2).cast("int").alias(TARGET_COLUMN), F.floor(number / 400).alias("content")
    )
    split = ln.stratified_split(frame)
    assert split.columns == [*frame.columns, "split"]
    counts = {(r[0], r[1]): r[2] for r in split.groupBy(TARGET_COLUMN, "split").count().collect()}
    assert counts == {(0, "test"): 100, (1, "test"): 100, (0, "train"): 400, (1, "train"): 400}
    assert split.drop("split").exceptAll(frame).isEmpty()
    assert split.exceptAll(ln.stratified_split(frame.repartition(5))).isEmpty()


def test_split_quota_holds_for_missing_keys(spark):
    """A missing key is a key like any other: its rows are divided where the quota falls between them."""
    frame = spark.range(400).select(
        F.when(F.col("id") % 4 < 2, F.col("id")).alias("review_id"), (F.col("id") % 2).cast("int").alias(TARGET_COLUMN), F.floor(F.col("id") / 7).alias("content")
    )
    counts = {(r[0], r[1]): r[2] for r in ln.stratified_split(frame).groupBy(TARGET_COLUMN, "split").count().collect()}
    assert counts == {(0, "test"): 40, (1, "test"): 40, (0, "train"): 160, (1, "train"): 160}


def test_area_of_saturated_scores_in_even_ranges(spark):
    """95 % of the scores lie above 0.9999: no range of scores holds much more than its share."""
    rng = np.random.default_rng(6)
    scores = np.where(rng.random(4_000) < 0.95, 1 - rng.random(4_000) * 1e-4, rng.random(4_000))
    labels = (rng.random(4_000) < scores * 0.5).astype(int)
    rows = [(float(s), int(y), 1) for s, y in zip(scores, labels)]
    frame = spark.createDataFrame(rows, f"score double, `{TARGET_COLUMN}` int, prediction int")
    pos, neg = scores[labels == 1], scores[labels == 0]
    assert ln.eval_metrics(frame).first()["roc_auc"] == pytest.approx(np.mean(pos[:, None] > neg) + 0.5 * np.mean(pos[:, None] == neg), abs=1e-12)
    sizes = [r["count"] for r in sorted_ranges(frame.select("score").distinct(), ["score"]).groupBy("range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4_000 / 8
    plan = ln.eval_metrics(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "rangepartitioning(score" not in plan


def test_positions_need_no_single_task(spark):
    frame = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y")], "c string, d string")
    positions = ln.category_positions(frame, ["c", "d"])
    assert "SinglePartition" not in positions._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, positions.collect()), key=lambda r: r[2]) == [("c", "a", 0), ("c", "b", 1), ("d", "x", 2), ("d", "y", 3)]


def test_certificate_holds_for_a_fit_and_not_for_a_stopped_one(labelled, model):
    told = {r["block"]: r for r in certificate(model).collect()}
    assert set(told) == {"text", "numbers", "categories", "constants", "bias"}
    assert all(r["settled"] == r["columns"] for r in told.values())
    assert sum(r["columns"] for r in told.values()) == len(model.table_stages.stages[-1].coefficients) + len(model.constant_weights) + 1
    stopped = train(labelled, max_iterations=1)
    assert any(r["settled"] < r["columns"] for r in certificate(stopped).collect())


def test_gradients_equal_those_of_numpy(labelled, model):
    rows = model.table_stages.stages[-1].transform(model.design).select("features", "probability", "class_weight", TARGET_COLUMN).collect()
    x = np.array([r["features"].toArray() for r in rows])
    error = np.array([r["class_weight"] * (r["probability"][1] - r[TARGET_COLUMN]) for r in rows])
    solver = model.table_stages.stages[-1]
    want = x.T @ error / sum(r["class_weight"] for r in rows) + solver.getRegParam() * solver.coefficients.toArray()
    got = {r["position"]: r["gradient"] for r in gradients(model).collect()}
    assert all(abs(got[j] - want[j]) < 1e-12 for j in range(len(want)))


def test_gradients_pass_over_the_matrix_once(model):
    """Sums and totals are of one pass, whose result is stored: no plan that is left reads the matrix."""
    plan = gradients(model)._jdf.queryExecution().optimizedPlan().toString()
    assert "features" not in plan and "inline" not in plan and "gradient" in plan


def test_solver_reads_a_stored_matrix(model):
    """Short lineage: the plan is one scan, and its schema names no cells."""
    plan = model.design._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Project" not in plan and "UDF" not in plan
    assert model.design.schema["features"].metadata == {} and model.design.rdd.getNumPartitions() == 1


def test_intermediate_tables_need_a_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


def test_area_under_curve_counts_ties_half(spark):
    rng = np.random.default_rng(2)
    scores, labels = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    frame = spark.createDataFrame([(float(s), int(y), int(s > 0.5)) for s, y in zip(scores, labels)], f"score double, `{TARGET_COLUMN}` int, prediction int")
    pos, neg = scores[labels == 1], scores[labels == 0]
    area = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    got = ln.eval_metrics(frame).first()
    assert got["roc_auc"] == pytest.approx(area, abs=1e-12)
    assert got["accuracy"] == pytest.approx(np.mean((scores > 0.5) == labels))
    only = ln.eval_metrics(frame.where(F.col(TARGET_COLUMN) == 0).withColumn("prediction", F.lit(0))).first()
    assert only["roc_auc"] is None and only["f1"] == 0.0


def test_imputation_ties_and_constants(spark):
    frame = spark.createDataFrame([("b", 1.0, 5.0), ("a", None, 5.0), ("b", 4.0, 5.0), ("a", float("nan"), 5.0), (None, 9.0, 5.0)], "c string, v double, k double")
    assert ln.column_modes(frame, ["c"]) == {"c": "a"}
    assert sorted(r["v"] for r in ln.impute_median(frame, ["v"]).collect()) == [1.0, 4.0, 4.0, 4.0, 9.0]
    assert {r["k"] for r in ln.scale_numeric(frame, ["k"]).collect()} == {5.0}


def test_spread_of_gaps_and_constants(spark):
    """Missing values do not count; a column without any has no spread."""
    rows = [(1.0, None, 7, None), (4.0, 2.0, 7, None), (None, 5.0, 7, None), (9.5, -1.0, 7, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c int, d double")
    got = ln.numeric_spread(frame, ["a", "b", "c", "d"])
    assert got["a"] == pytest.approx((np.std([1.0, 4.0, 9.5]), 1.0, 9.5)) and got["b"] == pytest.approx((np.std([2.0, 5.0, -1.0]), -1.0, 5.0))
    assert got["c"] == (0.0, 7.0, 7.0) and got["d"] == (None, None, None)
    assert ln.numeric_spread(frame.limit(0), ["a"]) == {"a": (None, None, None)}


def test_spread_of_many_columns_is_one_small_aggregate(spark):
    """The number of aggregate functions in a plan does not grow with the columns."""
    frame = spark.range(50).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(75)])
    seen, aggregate = [], type(frame).groupBy

    def spied(self, *keys):
        seen.append(keys)
        return aggregate(self, *keys)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(frame), "groupBy", spied)
        patch.setattr(type(frame), "agg", lambda *a: pytest.fail("aggregates side by side"))
        got = ln.numeric_spread(frame, frame.columns)
    assert seen == [("place",)] and got["c3"] == pytest.approx((3 * np.std(range(50)), 0.0, 147.0))


def test_tasks_of_the_solver_grow_slower_than_the_matrix():
    """Each task sends a gradient of all columns, so a large matrix has larger partitions."""
    assert [solver_tasks(size << 20, 6) for size in (0, 1, 8, 9, 384, 400, 1_536, 3_200)] == [1, 1, 1, 2, 48, 48, 48, 100]
    assert solver_tasks(13 << 30, 6) == 416 and solver_tasks(13 << 30, 600) == 1_664


def test_unknown_categories_have_no_cell(spark):
    known = ln.category_positions(spark.createDataFrame([("x",), ("w",), ("x",)], "c string"), ["c"])
    cells = ln.onehot(spark.createDataFrame([(1, "x"), (2, "new")], "review_id int, c string"), known, ["c"])
    assert [tuple(r) for r in cells.collect()] == [(1, "c", "x", 1)]


def test_long_and_vector_text_weights_agree(labelled, model):
    long = {(r["review_id"], r["term"]): r["weight"] for r in ln.tfidf_weights(labelled, ln.default_stop_words()).collect()}
    vocabulary = next(s for s in model.text_stages.stages if hasattr(s, "vocabulary")).vocabulary
    seen = {}
    for row in model.vectorise_text(labelled).select("review_id", "text_vector").collect():
        vector = row["text_vector"]
        seen |= {(row["review_id"], vocabulary[i]): v for i, v in zip(vector.indices, vector.values) if v}
    assert seen.keys() == long.keys()
    assert all(seen[k] == pytest.approx(long[k], abs=1e-12) for k in long)


def test_text_weights_shuffle_no_terms(labelled):
    """The terms of a text are weighted inside its row: the plan of the result has no exchange."""
    plan = ln.tfidf_weights(labelled, ln.default_stop_words())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_solution_matches_newton_on_the_penalised_objective(labelled, model):
    rows = model.table_stages.transform(model.vectorise_text(labelled)).collect()
    constants = model.constant_weights
    assert {"survey_days_since_purchase", "img_has_image"} <= constants.keys()
    x = np.array([[*row["features"].toArray(), *[row[c] for c in constants], 1.0] for row in rows])
    y = np.array([row[TARGET_COLUMN] for row in rows])
    sample = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (sample * (p - y)) + w / 1.5
        hessian = (x * (sample * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / 1.5
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    want = 1 / (1 + np.exp(-x @ w))
    got = np.array([r["score"] for r in model.score_vectors(model.vectorise_text(labelled)).orderBy("review_id").collect()])
    order = np.argsort([row["review_id"] for row in rows])
    assert np.abs(got - want[order]).max() < 2e-3


def test_saved_model_scores_alike_and_keeps_every_row(spark, labelled, model, presets, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, spark, path)
    again = load_model(spark, path)
    raw = presets.withColumn(TARGET_COLUMN, F.lit(None).cast("int")).withColumn("Class Name", F.lit("unseen"))
    first = [tuple(r) for r in batch_score(raw, model).orderBy("review_id").collect()]
    second = [tuple(r) for r in batch_score(raw, again).orderBy("review_id").collect()]
    assert first == second and len(first) == 3
    assert batch_score(raw, model).columns == [*raw.columns, "prediction", "score", "recommended_label"]
    save_model(model, spark, path, version=1)
    with pytest.raises(ValueError, match="Stale"):
        load_model(spark, path)
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "nothing"))


def test_survey_answers_move_the_score(spark, model, presets):
    answers = spark.createDataFrame([(0, 90, 12.0)], "review_id bigint, days_since_purchase int, comfort_hours double")
    plain = {r["review_id"]: r["score"] for r in batch_score(presets, model).collect()}
    told = {r["review_id"]: r["score"] for r in batch_score(presets, model, survey=answers).collect()}
    assert told[0] != plain[0] and told[1] == plain[1]
    assert encode_survey(answers).first()["survey_comfort_hours"] == 12.0


def test_sensitivity_equals_rescoring(model, presets):
    curve = {(r["review_id"], r["Rating"]): r["score"] for r in rating_sensitivity(presets, model.score_vectors, model.vectorise_text).collect()}
    assert len(curve) == 15
    for stars in (1.0, 4.0):
        for row in batch_score(presets.withColumn("Rating", F.lit(stars)), model).collect():
            assert curve[row["review_id"], stars] == pytest.approx(row["score"], abs=1e-12)


def test_frame_has_every_model_column(labelled):
    assert set(NUMERIC_COLUMNS + CATEGORICAL_COLUMNS + ["text", TARGET_COLUMN]) <= set(labelled.columns)
    assert len(NUMERIC_COLUMNS) == 75
