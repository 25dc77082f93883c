"""Review analytics on Spark: features, scoring, explanation and segment reports."""
