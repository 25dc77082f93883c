"""Alignment against a plain restatement over tokens, links and counts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seamstat.llm import token_alignment as ta

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, pair string, block int"


@pytest.fixture(scope="module")
def aligner():
    aligner = ta.Aligner.load()
    aligner.open()
    return aligner


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(ta.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.PIECES)


def plainly(rows, libraries):
    """The rows of the result, token by token."""
    a_model, b_model = libraries
    b_bytes = ta.piece_tokens(b_model)
    byte = ta.byte_of_character()
    linked, documents = Counter(), []
    for doc, text in rows:
        whole = f" {text}".encode() if text else b""
        a_ids = a_model.encode(f" {text}", add_special_tokens=False).ids if text else []
        b_ids = b_model.encode(text) if text else []
        a_tokens = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a_ids]
        if b"".join(a_tokens) != whole or b"".join(b_bytes[i] for i in b_ids) != whole:
            documents.append((doc, [], [], [], []))
            continue
        spans = []
        for tokens in (a_tokens, [b_bytes[i] for i in b_ids]):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links, j = [], 0
        for i, (start, end) in enumerate(spans[0]):
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(b_ids) and spans[1][k][0] < end:
                links.append((a_ids[i], b_ids[k]))
                k += 1
        linked.update(links)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [
            ",".join(str(n) for n, (_, e) in zip(a_ids, spans[0], strict=True) if low < e <= high)
            + "|" + ",".join(str(n) for n, (_, e) in zip(b_ids, spans[1], strict=True) if low < e <= high)
            for low, high in zip([0, *common], common)
        ]
        documents.append((doc, a_ids, b_ids, groups, links))
    best = {}
    for (_, b), n in linked.items():
        best[b] = max(best.get(b, 0), n)
    result = [
        (
            doc, len(a), len(b), len(groups), len(links), sum(linked[p] == best[p[1]] for p in links), sum(linked[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc, a, b, groups, links in documents
    ]
    return result, linked


ODD = [
    (1, None), (2, ""), (3, " "), (4, "x"), (5, "a\u2581b"), (6, "<|endoftext|> and <s> it's"), (7, "\n\n\t  é ² 日本語 \u200b 🙂🙂"),
    (8, "abababab" * 300), (8, "abababab" * 300), (8, "other"), (None, "no id"), (None, None), (9, "\x00 zero  \r\n"), (10, "  two   spaces  "),
]


def test_odd_rows_equal_plain_python(spark, aligner, libraries):
    rows = [(doc, text, "x", 1) for doc, text in ODD]
    got = [tuple(r) for r in ta.alignment(spark.createDataFrame(rows, DOC), aligner).collect()]
    want, _ = plainly(ODD, libraries)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r[1:] for r in got if r[0] in (1, 2, 5)] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_documents_equal_plain_python_in_small_blocks(spark, aligner, libraries, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    want, linked = plainly([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], libraries)
    got = ta.alignment(docs.repartition(3), aligner)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    counted = {(r["a"], r["b"]): r["n"] for r in ta.count_table(docs, aligner).collect()}
    assert counted == linked


def test_empty_table(spark, aligner):
    assert ta.alignment(spark.createDataFrame([], DOC), aligner).collect() == []


def test_ranks_encode_like_the_tokenizers_library(spark, aligner, libraries):
    """Every token of the vocabulary that is text, and whole documents."""
    a_model, _ = libraries
    texts = [t.decode() for t in aligner.a_bytes if t == t.decode("utf-8", "ignore").encode()]
    texts += [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["x" * 200_000, " " * 50_000, "ab" * 50_000]
    for text, found in zip(texts, a_model.encode_batch([f" {t}" for t in texts], add_special_tokens=False), strict=True):
        assert aligner.a.encode_ordinary(f" {text}") == found.ids


def test_identity_pairs_elsewhere_count_together(aligner):
    """The same two tokens may also be linked across their ends; blocks end at both limits."""
    found = aligner.align(["abababab" * 50, None, "plain words"])
    assert found["n_links"].tolist() == (found["n_a"] + found["n_b"] - found["n_groups"]).tolist()
    assert found["vector"].sum() + found["uses"].sum() == found["n_links"].sum()


def test_blocks_end_at_both_limits(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abc", None, "abcdefgh", "", "ab", "abcd"])], ["doc_id", "text"])
    monkeypatch.setattr(ta, "CHARS_AT_ONCE", 5)
    assert [b.num_rows for b in ta.blocks([batch])] == [2, 1, 2, 1]
    monkeypatch.setattr(ta, "DOCS_AT_ONCE", 1)
    assert [b.num_rows for b in ta.blocks([batch])] == [1] * 6
