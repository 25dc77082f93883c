"""The stages over a table with odd rows, and the whole run against plain Python."""

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from seamstat.llm import mixing, secret_scan, sentencepiece_backend
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark):
    """Stage by stage on plain rows: letters, groups, patterns, and the library's own ids."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    kept = [d for d in docs if d["text"] and any(map(str.isalpha, d["text"]))]
    _, component = brute.near_duplicates({d["doc_id"]: d["text"] for d in kept})
    kept = [d for d in kept if component[d["doc_id"]] == d["doc_id"]]
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in kept], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = secret_scan.fit(frame)
    masked = {}
    for d in kept:
        spans = model.spans(d["text"])
        assert [s for s in spans if s[1] < 3] == brute.base_spans(d["text"])
        masked[d["doc_id"]] = secret_scan.masked(d["text"], spans)
    clean = spark.createDataFrame([(d["doc_id"], masked[d["doc_id"]], d["source"]) for d in kept], "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(clean).collect() if r["size"]}
    judge = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_backend.MODEL)
    want = Counter()
    for doc, text in masked.items():
        want[doc, tuple(judge.encode(text))] += copies.get(doc, 0)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in got) == +want
    assert all(r["parity"] and r["round_trip"] for r in got)


ROWS = [
    (1, "the and of that this with", "en", "a", 25, "x", 1.0), (1, "the and of that this with", "en", "a", 25, "x", 1.0), (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "", 0.0), (None, "for the and of the token=abcdefgh12", "en", None, 35, "", 0.0), (4, "12 34", None, "b", 5, "", 0.0),
    (5, "is the and of " * 20_000, "en", "b", 280_000, "", 0.0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    stage, last = dict(corpus_pipeline.STAGES)[name], corpus_pipeline.STAGES[-1][0]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = stage(spark, docs, SMALL)
    assert name == last or out.columns == docs.columns
    assert out.count() >= 3
    assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_names_and_number_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix_sources", "sentencepiece"]
