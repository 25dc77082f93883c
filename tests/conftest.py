import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.session import build  # noqa: E402

SMALL = "/root/testdata/sf0.001"

PRESETS = [
    ("Perfect fit and beautiful fabric",
     "I absolutely love this piece. The quality exceeded my expectations, fits true to size, "
     "and I have already recommended it to friends.", "34", "12", "5", "General", "Dresses", "Dresses"),
    ("Not worth the price",
     "Material feels cheap and sizing runs small. Color was different from the photos. Very "
     "disappointed and would not recommend.", "28", "2", "2", "General", "Tops", "Blouses"),
    ("Okay but nothing special", "Decent for the sale price. Comfortable for casual wear.",
     "41", "0", "3", "General Petite", "Bottoms", "Pants"),
]
COLUMNS = ["Title", "Review Text", "Age", "Positive Feedback Count", "Rating",
           "Division Name", "Department Name", "Class Name"]


@pytest.fixture(scope="session")
def spark():
    return build()


@pytest.fixture(scope="session")
def presets(spark):
    rows = [(i, *row) for i, row in enumerate(PRESETS)]
    types = ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.createDataFrame(rows, f"review_id bigint, {types}")
