import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamstat.operators.image_stats import image_stats_from_pixels, rejected_images
from seamstat.operators.survey import encode_survey
from seamstat.schema import IMAGE_FEATURES, SURVEY_DEFAULTS, SURVEY_FEATURES
from seamstat.sources.images import read_image_features
from seamstat.sources.reviews import MISSING, read_reviews_csv, write_scored_csv
from seamstat.sources.survey import answer_schema, read_survey_answers


def test_csv_fields_match_pandas(spark, tmp_path):
    path = tmp_path / "in.csv"
    odd = [*MISSING, "none", "Null", "na", 'say ""hi""', "two\nlines", "a,b", " NA "]
    lines = ["Title,Age"] + [f'"{v}",{i}' for i, v in enumerate(odd)]
    path.write_text("\n".join(lines) + "\n")
    got = read_reviews_csv(spark, str(path)).orderBy(F.col("Age").cast("int")).toPandas()["Title"]
    want = pd.read_csv(path)["Title"]
    assert [None if v is None else v for v in got] == [None if pd.isna(v) else v for v in want]


def test_scored_csv_round_trip(spark, tmp_path):
    rows = [(1, 'q"uote', 0.25), (2, "new\nline, comma", 0.5), (3, None, 1.0), (4, "é☁", 0.0)]
    out = str(tmp_path / "out")
    write_scored_csv(spark.createDataFrame(rows, "id int, Title string, score double"), out)
    back = read_reviews_csv(spark, out).select(F.col("id").cast("int"), "Title", F.col("score").cast("double"))
    assert sorted(map(tuple, back.collect())) == rows
    plain = pd.concat([pd.read_csv(f) for f in (tmp_path / "out").glob("*.csv")])
    assert sorted(plain["id"]) == [1, 2, 3, 4]


def test_answers_keep_their_types(spark, tmp_path):
    path = tmp_path / "answers.csv"
    path.write_text("review_id,purchase_channel,days_since_purchase,first_time_buyer\n7,Gift,3,true\n8,,,\n")
    schema = answer_schema()
    some = type(schema)([schema[n] for n in ("review_id", "purchase_channel", "days_since_purchase", "first_time_buyer")])
    answers = read_survey_answers(spark, str(path), "csv", some)
    first, second = encode_survey(answers).orderBy("review_id").collect()
    assert (first["survey_purchase_channel"], first["survey_days_since_purchase"], first["survey_first_time_buyer"]) == (2.0, 3.0, 1.0)
    assert [second[n] for n in SURVEY_FEATURES] == list(SURVEY_DEFAULTS.values())


def png(path, rgb):
    height, width, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_equal_the_pixel_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    pictures = {"10": rng.integers(0, 256, (7, 5, 3)), "11": rng.integers(0, 256, (16, 33, 3)),
                "12": np.full((4, 6, 3), 120)}
    for name, rgb in pictures.items():
        png(tmp_path / f"{name}.png", rgb)
    (tmp_path / "13.txt").write_text("no picture")
    files = read_image_features(spark, str(tmp_path)).cache()
    assert rejected_images(files).first()["rejected"] == 1
    pixels = pd.DataFrame(
        [(n, y, x, *map(int, rgb[y, x])) for n, rgb in pictures.items() for y in range(rgb.shape[0]) for x in range(rgb.shape[1])],
        columns=["review_id", "y", "x", "r", "g", "b"],
    )
    table = {r["review_id"]: r for r in image_stats_from_pixels(spark.createDataFrame(pixels), "review_id").collect()}
    for row in files.collect():
        if row["review_id"] == "13":
            assert [row[n] for n in IMAGE_FEATURES] == [0.0] * 11
            continue
        rgb = pictures[row["review_id"]] / 255.0
        gray = 0.299 * rgb[:, :, 0] + 0.587 * rgb[:, :, 1] + 0.114 * rgb[:, :, 2]
        hist = np.histogram(gray.ravel(), bins=32, range=(0, 1), density=True)[0] + 1e-12
        assert row["img_color_entropy"] == pytest.approx(-(hist * np.log2(hist)).sum(), abs=1e-6)
        assert row["img_contrast"] == pytest.approx(gray.std(), abs=1e-9)
        for name in IMAGE_FEATURES:
            assert row[name] == pytest.approx(table[row["review_id"]][name], abs=1e-7), name
    assert table["12"]["img_color_entropy"] == pytest.approx(-160, abs=1)
