import pytest
from pyspark.sql import functions as F

from seamstat.llm import mixing

DOC = "doc_id bigint, text string, source string, size string, target string"


def test_water_filling_clamps_and_shares_the_excess(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 100, 2), ("c", 1000, 3), (None, 0, 1)], "source string, source_size bigint, weight bigint")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sources).collect()}
    assert got == pytest.approx({"a": 30.0, "b": 300.0, "c": 780.0, None: 0.0})


def docs(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 3}", "x", "y") for i in range(200)]
    rows += [(1000 + i, "long " * 50, "big", "x", "y") for i in range(100)]
    rows += [(3, "w " * 4, "s0", "x", "y")] * 3 + [(None, "a b", "s1", None, None), (5000, None, None, "", ""), (5001, "", None, "", ""),
             (5002, "word " * 20_000, "one", "x", "y")]
    return spark.createDataFrame(rows, DOC)


def test_report_and_mixed_rows_agree(spark):
    table = docs(spark)
    report = mixing.mix_report(table).toPandas()
    assert len(report) == table.count()
    assert (report["taken"] <= 3 * report["size"]).all()
    report["source"] = report.groupby(["source_size", "target"]).ngroup()
    for _, own in report.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    mixed = mixing.mix(table)
    assert mixed.schema == table.schema
    taken = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas()
    left = taken.fillna(-1).set_index("doc_id")["n"]
    right = report.fillna({"doc_id": -1}).groupby("doc_id")["taken"].sum()
    assert {k: v for k, v in left.items() if v} == {k: v for k, v in right.items() if v}
    again = mixing.mix_report(table.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    rows = [sorted(map(tuple, frame[key].fillna(-1).astype(int).to_numpy().tolist())) for frame in (again, report)]
    assert rows[0] == rows[1]


def test_empty_and_blank_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.mix_report(empty).collect() == [] and mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "a", "", ""), (2, " ", None, "", "")], DOC)
    assert [r["taken"] for r in mixing.mix_report(blank).collect()] == [0, 0]
