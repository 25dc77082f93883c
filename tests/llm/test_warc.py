import base64
import gzip
import hashlib
import io
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamstat.llm import warc

SMALL = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string, record_type string, first string"
ROWS = [
    (1, "http://a/", "same", "x", "y"), (2, None, "same", None, None), (3, "", "", None, None), (4, "http://b\r\nX: y/ ", None, None, None),
    (None, "u", "same", None, None), (None, "u", "only null", None, None), (None, "v", "only null", None, None), (1, "again", "same", None, None),
    (5, "http://é/?q=ü", "WARC/1.0\r\n\r\n<p>é 日本 \U0001f600</p>", None, None), (6, "long", "x" * 3_000_000, None, None), (7, "s", "\x00\n", None, None),
]


def expected(rows):
    """What the contract says, page by page."""
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        again = (html or "") in first and first[html or ""] != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if again else "response", first[html or ""] if again else None, None if again else True))
    return Counter(out)


def test_round_trip_of_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGE).repartition(3)
    got = warc.archived(pages, path=str(tmp_path / "archive"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    assert Counter(map(tuple, got.collect())) == expected(ROWS)
    found = warc.read_archive(spark, str(tmp_path / "archive")).where("record_type = 'response'").collect()
    assert Counter(r["payload"].decode() for r in found) == Counter(html or "" for _, _, html, *_ in ROWS) - Counter({"same": 2, "": 1})
    urls = {r["record_id"]: r["url"] for r in warc.read_archive(spark, str(tmp_path / "archive")).collect()}
    assert urls["urn:page:2"] is None and urls["urn:page:3"] == "" and urls["urn:page:4"] == "http://b%0D%0AX: y/%20" and urls["urn:page:5"] == "http://é/?q=ü"
    assert [p.name for p in (tmp_path / "archive").iterdir() if p.name.startswith("_")] == []


def test_empty_table(spark, tmp_path):
    assert warc.archived(spark.createDataFrame([], PAGE), path=str(tmp_path / "none")).collect() == []


def test_predicates_and_columns_reach_the_source(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.archived(spark.createDataFrame(ROWS, PAGE), path=path)
    found = warc.read_archive(spark, path, ["record_id", "record_type", "url"]).where("record_type = 'revisit' AND url IN ('again', 'u')")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)  # nothing is left for Spark to test
    assert [r["record_id"] for r in found.collect()] == ["urn:page:"]
    kinds = warc.read_archive(spark, path, ["record_type"]).groupBy("record_type").count().collect()
    assert {r[0] for r in kinds} == {"warcinfo", "response", "revisit"}
    with pytest.raises(Exception, match="not a column"):
        spark.read.format("warc").schema("text string").load(path).collect()


class Counting(io.BytesIO):
    """Bytes read so far, without what is sought over."""

    taken = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        self.taken += n
        return n


def test_unwanted_payloads_are_passed_over():
    big = b"y" * 5_000_000
    data = b"".join(warc.page_record(f"r{i}", "response", "u", None, big, warc.EPOCH) for i in range(3))
    raw = Counting(data)
    stream = io.BufferedReader(raw, warc.CHUNK)
    rows = list(warc.records(stream, True, [warc.EqualTo(("record_id",), "r1")], {"record_id", "payload_bytes"}))
    assert [(r["record_id"], r["payload_bytes"], r["payload"]) for r in rows] == [("r1", len(big), None)]
    assert raw.taken < 1_000_000
    everything = list(warc.records(io.BufferedReader(io.BytesIO(data)), True, [], {"payload", "intact"}))
    assert all(r["payload"] == big and r["intact"] for r in everything)


def test_records_of_other_writers():
    """Plain header names, folded lines, no HTTP header, blank lines, no digest; broken files are errors."""
    text = b"WARC/1.1\r\nwarc-type: resource\r\nWARC-RECORD-ID: <urn:x>\r\nX-Long: a\r\n  b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n\r\n"
    rows = list(warc.records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(text) * 2))), False, [], {"payload", "intact"}))
    assert [(r["record_type"], r["record_id"], r["payload"], r["intact"], r["url"]) for r in rows] == [("resource", "urn:x", b"hello", None, None)] * 2
    damaged = warc.page_record("r", "response", "u", None, b"payload", warc.EPOCH).replace(b"\r\n\r\npayload", b"\r\n\r\nqayload")
    assert [r["intact"] for r in warc.records(io.BufferedReader(io.BytesIO(damaged)), True, [], {"intact"})] == [False]
    for cut in (text[:-12], text[:40]):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.records(io.BufferedReader(io.BytesIO(cut)), True, [], {"payload"}))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.records(io.BufferedReader(io.BytesIO(b"GIF89a")), True, [], set()))


def test_plain_files_and_small_partitions(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGE)
    path = str(tmp_path / "plain")
    warc.write_archive(warc.with_revisits(pages).repartition(4), path, compressed=False)
    assert all(p.name.endswith(".warc") for p in (tmp_path / "plain").iterdir())
    whole = warc.read_archive(spark, path).where(F.col("record_type") != "warcinfo")
    split = spark.read.format("warc").option("packedBytes", "1").load(path)
    assert split.rdd.getNumPartitions() == len(list((tmp_path / "plain").iterdir()))
    assert Counter(r["record_id"] for r in whole.collect()) == Counter(r["record_id"] for r in split.where("record_type <> 'warcinfo'").collect())
    assert warc.packed({"a": 3, "b": 3, "c": 9, "d": 1}, 6) == [["a", "b"], ["c"], ["d"]]


def test_small_payloads_are_responses_below_the_least_size(spark):
    rows = [(1, "u", "ab", None, None), (2, "u", "ab", None, None), (3, "u", "abcd", None, None), (4, "u", "abcd", None, None)]
    found = warc.with_revisits(spark.createDataFrame(rows, PAGE), least_bytes=3).orderBy("record_id").collect()
    assert [r["record_type"] for r in found] == ["response", "response", "response", "revisit"]
