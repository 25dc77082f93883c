import random
import struct

import sentencepiece

from seamstat.llm import piece_model as pm
from seamstat.llm import sentencepiece_backend as sb

TEXTS = [
    "", " ", "   a  b ", "the and of", "Ünïcödé 漢字 🎉 é", "\n\n\t tab", "<s> </s> <unk> <0x41>", "▁ ▁▁ a▁b", "\x00\x01", "a" * 5000,
    "12 345 6.7", "ſecret ﬁ", "  ", "x" + " " * 40 + "y",
]


def test_parity_and_round_trip_on_odd_texts():
    codec = sb.PieceCodec.load()
    judge = sentencepiece.SentencePieceProcessor(model_file=sb.MODEL)
    draw = random.Random(9)
    letters = "abcdefghij klmnop qrstu vwxyz éüß漢🎉\n.,<>0123  "
    texts = TEXTS + ["".join(draw.choices(letters, k=draw.randint(1, 300))) for _ in range(400)]
    ids, back = codec.encode(texts)
    assert [i.tolist() for i in ids] == judge.encode(texts)
    assert all(codec.parity(texts, ids))
    plain = [(t, i.tolist()) for t, i, ok in zip(texts, ids, back, strict=True) if "▁" not in t]
    assert codec.decode([i for _, i in plain]) == [t for t, _ in plain]
    assert all(ok for t, ok in zip(texts, back, strict=True) if "▁" not in t)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model(spaces=True):
    """A small hand-made unigram model with byte fallback, in the published format."""
    pieces = [("<unk>", 0.0, pm.UNKNOWN), ("<s>", 0.0, pm.CONTROL), ("</s>", 0.0, pm.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, pm.BYTE) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("t", -4.0, 1), ("h", -4.1, 1), ("e", -4.2, 1), ("he", -3.3, 1), ("▁t", -3.4, 1), ("an", -3.1, 1), ("a", -4.3, 1), ("n", -4.4, 1)]
    data = b"".join(
        message(pm.PIECES, message(pm.PIECE_TEXT, p.encode()) + varint(pm.PIECE_SCORE << 3 | 5) + struct.pack("<f", s) + varint(pm.PIECE_TYPE << 3) + varint(t))
        for p, s, t in pieces
    )
    trainer = varint(pm.MODEL_TYPE << 3) + varint(pm.UNIGRAM) + varint(pm.BYTE_FALLBACK << 3) + varint(1)
    normalizer = message(1, b"identity") + varint(pm.REMOVE_EXTRA_SPACES << 3) + varint(int(spaces))
    return data + message(pm.TRAINER, trainer) + message(pm.NORMALIZER, normalizer)


def test_unigram_scores_and_space_settings():
    for spaces in (True, False):
        proto = unigram_model(spaces)
        judge, codec = sentencepiece.SentencePieceProcessor(model_proto=proto), sb.PieceCodec(proto)
        texts = ["the then a", "  the   than ", "hethe", "zebra ü the", "a", "", "than\nthe"]
        ids, _ = codec.encode(texts)
        assert [i.tolist() for i in ids] == judge.encode(texts)


def test_table_edges(spark):
    schema = "doc_id bigint, text string, token_ids string, parity int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "the and", None, None), (3, "the and", "y", 2), (3, "the and", "y", 2), (4, "ab c" * 50_000, "", 0)]
    codec = sb.PieceCodec.load()
    got = sb.encode(spark.createDataFrame(rows, schema), codec).collect()
    assert [r["doc_id"] for r in got] == [1, 2, None, 3, 3, 4]
    assert [r["n_tokens"] for r in got[:2]] == [0, 0] and got[0]["token_ids"] == []
    assert got[2]["token_ids"] == got[3]["token_ids"] == got[4]["token_ids"] and all(r["parity"] and r["round_trip"] for r in got)
    assert got[5]["n_tokens"] == len(got[5]["token_ids"])
    assert sb.encode(spark.createDataFrame([], schema), codec).collect() == []


def test_blocks_do_not_matter(monkeypatch):
    codec = sb.PieceCodec.load()
    texts = TEXTS + ["single spaces only here", "and the same words here again", "new\nlines of\ttabs"]
    whole = [i.tolist() for i in codec.encode(texts)[0]]
    assert [codec.encode([t])[0][0].tolist() for t in texts] == whole == codec.judge.encode(texts)
    monkeypatch.setattr(sb, "CHARS_AT_ONCE", 5)
    assert [t for part in sb.in_parts(texts) for t in part] == texts


def test_tables_decode_to_their_texts(spark):
    """Whole documents and odd rows come back; ids of no text decode like in the library."""
    codec = sb.PieceCodec.load()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    back = sb.decode(sb.encode(docs, codec), codec).join(docs, "doc_id")
    assert back.where("decoded IS DISTINCT FROM text").isEmpty() and back.count() == docs.count()
    judge = sentencepiece.SentencePieceProcessor(model_file=sb.MODEL)
    odd = [[], [1, 2], [0], [259], [3, 200, 201], [28705, 28705], [229, 186, 143, 5]]
    rows = [(i, ids) for i, ids in enumerate(odd)] + [(99, None)]
    got = sb.decode(spark.createDataFrame(rows, "doc_id bigint, token_ids array<int>"), codec).collect()
    assert got[-1]["decoded"] is None
    assert [r["decoded"] for r in got[:2]] == ["", ""]
    assert [r["decoded"] for r in got[3:-1]] == [judge.decode(ids) for ids in odd[3:]]
