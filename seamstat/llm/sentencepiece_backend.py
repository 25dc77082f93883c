"""Sentence-piece encoding and decoding with the tokenizers library as the backend.

The model file's protobuf is parsed (``piece_model``) and rebuilt: normaliser with character map
and spaces, the marker for spaces, unigram scores or ranked merges, and byte fallback. The ids are
those of the sentencepiece library, which every text is compared with.

Where no piece has a marker after another character, no piece can cross the beginning of a word.
The distinct words of a block of texts are then encoded in multithreaded batches, and the ids of its texts
gathered from theirs. A model with such pieces is encoded by whole texts. Words with pieces of equal rank,
such as runs of spaces, are joined here, leftmost first. Words of a block are told apart by 64-bit hashes; a
text whose ids differ from the library's would be encoded once more by itself.

``decode`` turns a table of ids back into texts by a table of the pieces' bytes. The round trip of every
document is that of its whole ids: they must give its normalised text.

Defined results
    A null or empty text has no ids; its parity and round trip hold. Null ids decode to null. Bytes
    that are no UTF-8 decode to U+FFFD each, as in the library. Strings of control pieces in a text are ordinary text. Repeated rows are encoded alike. Further columns are not read. An
    empty table gives an empty result.

Scale
    One pass over the texts without a shuffle. The model is read on the driver and travels with
    the tasks. Nothing is kept from one block of ``CHARS_AT_ONCE`` characters to the next.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from seamstat.llm import piece_model as pm
from seamstat.llm.shingles import word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_SIGN = " \u2047 "
THREADS = 2  # of the tokenizers library in each Python worker, unless the environment says otherwise
CHARS_AT_ONCE = 1_500_000
WORDS_AT_ONCE = 200  # in one text for the backend, which cuts it at the markers again
WORDS = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
_SPACE = np.arange(256) == 0x20


def ranked_merges(model: pm.PieceModel) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, the best third first, then by the ids of the two."""
    ids = {piece: i for i, piece in enumerate(model.pieces)}
    joins = []
    for piece, score, kind in zip(model.pieces, model.scores, model.types, strict=True):
        if kind == pm.NORMAL:
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    joins.append((-score, left, right))
    return [(model.pieces[left], model.pieces[right]) for _, left, right in sorted(joins)]


def tied_pieces(model: pm.PieceModel) -> list[str]:
    """The shortest of the pieces whose score is not theirs alone.

    The model joins the leftmost of equal scores first, which no ranking of merges can say.
    """
    if model.model_type != pm.BPE:
        return []
    normal = [(s, p) for p, s, kind in zip(model.pieces, model.scores, model.types, strict=True) if kind == pm.NORMAL and len(p) > 1]
    held = Counter(score for score, _ in normal)
    tied: list[str] = []
    for _, piece in sorted((len(p), p) for score, p in normal if held[score] > 1):
        if not any(other in piece for other in tied):
            tied.append(piece)
    return tied


def joined_by_score(word: str, scores: dict[str, float]) -> list[str]:
    """The pieces of a word when the best pair is joined first, the leftmost of equals."""
    parts: list[str | None] = list(word)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    open_: list[tuple[float, int, str]] = []

    def offer(left: int) -> None:
        if left >= 0 and after[left] < len(parts):
            both = parts[left] + parts[after[left]]
            if both in scores:
                heapq.heappush(open_, (-scores[both], left, both))

    for i in range(len(parts) - 1):
        offer(i)
    while open_:
        _, left, both = heapq.heappop(open_)
        right = after[left]
        if parts[left] is None or right >= len(parts) or parts[left] + parts[right] != both:
            continue
        parts[left], parts[right] = both, None
        after[left] = after[right]
        if after[right] < len(parts):
            before[after[right]] = left
        offer(before[left])
        offer(left)
    return [p for p in parts if p is not None]


def piece_bytes(model: pm.PieceModel) -> list[bytes]:
    """What each piece stands for in a text: nothing for control pieces, a sign for the unknown one."""
    found = []
    for piece, kind in zip(model.pieces, model.types, strict=True):
        if kind == pm.BYTE:
            found.append(bytes([int(piece[3:5], 16)]))
        elif kind == pm.CONTROL:
            found.append(b"")
        else:
            found.append(UNKNOWN_SIGN.encode() if kind == pm.UNKNOWN else piece.replace(MARKER, " ").encode())
    return found


def backend(model: pm.PieceModel) -> Tokenizer:
    """The model as a tokenizer of normalised text."""
    unknown = model.types.index(pm.UNKNOWN)
    if model.model_type == pm.UNIGRAM:
        scored = list(zip(model.pieces, model.scores, strict=True))
        core = models.Unigram(scored, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.model_type == pm.BPE:
        core = models.BPE(
            vocab={piece: i for i, piece in enumerate(model.pieces)},
            merges=ranked_merges(model),
            unk_token=model.pieces[unknown],
            byte_fallback=model.byte_fallback,
            fuse_unk=True,
        )
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    return Tokenizer(core)


@dataclass
class PieceCodec:
    """Encoder and decoder of one model file, given as its bytes."""

    proto: bytes

    def __post_init__(self) -> None:
        self.tokenizer: Tokenizer | None = None

    def __getstate__(self) -> bytes:
        return self.proto

    def __setstate__(self, proto: bytes) -> None:
        self.proto = proto
        self.__post_init__()

    @classmethod
    def load(cls, path: str = MODEL) -> PieceCodec:
        with open(path, "rb") as file:
            return cls(file.read())

    def _open(self) -> None:
        if self.tokenizer is None:
            os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
            self.model = pm.parse(self.proto)
            self.tokenizer = backend(self.model)
            self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
            self.by_word = not self.model.whitespace_as_suffix and self.model.escape_spaces and not any(
                MARKER in piece.lstrip(MARKER) for piece in self.model.pieces
            )
            self.tied = tied_pieces(self.model)
            kinds = zip(self.model.pieces, self.model.scores, self.model.types, strict=True)
            self.scores = {piece: score for piece, score, kind in kinds if kind == pm.NORMAL}
            self.bytes_of = piece_bytes(self.model)
            self.by_marker = backend(self.model)
            self.by_marker.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARKER, prepend_scheme="never", split=True)
            self.begins_word = np.array([piece.startswith(MARKER) for piece in self.model.pieces])
            self.judge = sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    def normalised(self, text: str) -> str:
        """The text as the model sees it: characters mapped, spaces marked."""
        self._open()
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.remove_extra_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = f"{text} " if self.model.whitespace_as_suffix else f" {text}"
        return text.replace(" ", MARKER) if self.model.escape_spaces else text

    def _encoded(self, words: list[str]) -> list[list[int]]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        for i in {i for piece in self.tied for i, word in enumerate(words) if piece in word}:
            encoded[i] = [n for part in joined_by_score(words[i], self.scores) for n in self._ids_of(part)]
        return encoded

    def _by_hash(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts that begin with a space and have single spaces between words only."""
        blocks = [text.replace(MARKER, " ").encode("utf-8", "surrogatepass") for text in texts]
        data = b"".join(blocks) + b" "
        starts, hashes = word_hashes(data, _SPACE)
        stops = np.append(starts[1:], len(data)) - 1
        _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        words = [MARKER + data[starts[i] : stops[i]].decode("utf-8", "surrogatepass") for i in first]
        runs = ["".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        encoded = [e.ids for e in self.by_marker.encode_batch_fast(runs, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(encoded), np.int32, sum(map(len, encoded)))
        begins = np.flatnonzero(self.begins_word[flat])  # one piece of each word has the marker
        sizes = np.diff(np.append(begins, len(flat)))
        n = sizes[word.ravel()]
        stop = np.cumsum(n)
        ids = flat[np.repeat(begins[word.ravel()] - (stop - n), n) + np.arange(n.sum())]
        ends = np.cumsum([len(block) for block in blocks])
        upto = np.concatenate([[0], stop])[np.searchsorted(starts, ends)]
        return np.split(ids, upto[:-1])

    def _by_text(self, texts: list[str]) -> list[np.ndarray]:
        words = [WORDS.findall(text) if self.by_word else [text] * bool(text) for text in texts]
        distinct = list({w for some in words for w in some})
        known = dict(zip(distinct, self._encoded(distinct), strict=True))
        return [np.array([n for w in some for n in known[w]], np.int32) for some in words]

    def _ids_of(self, part: str) -> list[int]:
        """The id of a piece, or what stands for a character that is none."""
        if part in self.scores:
            return [self.tokenizer.token_to_id(part)]
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they decode to its normalised form."""
        self._open()
        every = [self.normalised(text) for text in texts]
        apart = [MARKER * 2, *self.tied]
        single = [self.by_word and t[:1] == MARKER and t[-1] != MARKER and not any([piece in t for piece in apart]) for t in every]
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for way, chosen in ((self._by_hash, True), (self._by_text, False)):
            places = [i for i, one in enumerate(single) if one == chosen]
            if places:
                for i, found in zip(places, way([every[i] for i in places]), strict=True):
                    ids[i] = found
        spaced = [t.replace(MARKER, " ").encode("utf-8", "surrogatepass") for t in every]
        return ids, [self._bytes(a) == b for a, b in zip(ids, spaced, strict=True)]

    def _bytes(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """Texts of id sequences, without the space that encoding puts first."""
        self._open()
        texts = [None if some is None else self._bytes(some).decode("utf-8", "replace") for some in ids]
        return [t[1:] if t and self.model.dummy_prefix and t[0] == " " else t for t in texts]

    def parity(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the ids of each text are those of the sentencepiece library."""
        self._open()
        judged = self.judge.encode(texts, num_threads=1)
        return [np.array_equal(np.array(a, np.int32), b) for a, b in zip(judged, ids, strict=True)]


def in_parts(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of bounded total length; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHARS_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def encode(docs: DataFrame, codec: PieceCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, token_ids, parity and round_trip of every row."""
    known_as = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_parts([t or "" for t in batch.column(1).to_pylist()]):
                ids, round_trip = codec.encode(texts)
                parity = codec.parity(texts, ids)
                for i in [i for i, same in enumerate(parity) if not same]:  # words of one hash, if any
                    (ids[i],), (round_trip[i],) = codec.encode([texts[i]])
                    (parity[i],) = codec.parity([texts[i]], [ids[i]])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                        pa.array(parity, pa.bool_()),
                        pa.array(round_trip, pa.bool_()),
                    ],
                    [key, "n_tokens", "token_ids", "parity", "round_trip"],
                )
                at += len(texts)

    schema = f"`{key}` {known_as}, n_tokens bigint, token_ids array<int>, parity boolean, round_trip boolean"
    return docs.select(key, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, codec: PieceCodec, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """All rows with the text of their ids in a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = codec.decode(batch.column(ids).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields]
    return tokens.mapInArrow(run, ", ".join([*fields, f"`{text}` string"]))
