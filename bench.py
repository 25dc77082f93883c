"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line.

Every result row is produced and discarded; each number is the median of three runs and
includes building and planning the query. The total leaves out the costly queries, which run
once, so that it compares with earlier rounds.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from workload.catalog import QUERIES
from workload.session import build

HEADLINE = """
clean_reviews nlp_features vision_text_features nlp_documents model_frame survey_report
linear_score batch_signals rating_sensitivity feature_breakdown top_signals feature_matrix
review_insights catalog_rollup age_rating_heatmap dept_rating_box market_sample
stratified_split tfidf_weights eval_metrics image_stats journey_by_department
""".split()
COSTLY = ["batch_score"]  # trains to convergence: one run, without a warm-up
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build()
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or [*HEADLINE, *COSTLY]:
        times = []
        for _ in range(1 if name in COSTLY else RUNS):  # the median leaves a slow first run out
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "review_analytics_total",
                "value": round(sum(s for name, s in seconds.items() if name not in COSTLY), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
