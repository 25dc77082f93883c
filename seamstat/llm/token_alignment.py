"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentence-piece model (B).

Both read a text with a space before it, so their tokens cut the same bytes. Byte offsets where
tokens of both end cut them into groups; inside a group, every pair of tokens whose bytes overlap
is linked. An id pair's count is the number of links of the corpus that hold it.

Identity-map fast path: for each A id the B id of the same bytes is known beforehand. A group of
one token each that is such a pair needs no pair key: it is counted at its A id, in a vector as
long as A's vocabulary. Only the links of other groups become pairs and are shuffled, once for
each block of documents and not for each link.

1. ``aligned`` encodes blocks of documents. A document holds the A ids of its identity groups and,
   for each other link, the place of its pair among the distinct pairs of its block. The last
   document of a block holds those pairs, and the block's vector, with their numbers of links.
2. The vectors are added up, and the pairs of all blocks summed by pair. The highest count of each
   B id is a vector as long as B's vocabulary.
3. Each block gets the counts of its own pairs back, and meets its documents for their sums.

Defined results
    A text that is null or empty has no tokens, and neither has one whose joined A or B bytes are not
    the space and the text (such as one with U+2581, which B cannot tell from a space): zeros and an
    empty digest. Strings of special tokens in a text are ordinary text. Repeated rows and rows with
    a null id are documents of their own. Further columns are not read. An empty table gives an empty
    result.

Scale
    One pass over the texts. Of a pair the shuffle holds one row for each block it occurs in, so a
    pair that occurs everywhere is a skewed join key at most, which adaptive execution splits. Vectors
    are bounded by the vocabularies and may pass the driver; pairs do not. Blocks end after
    ``CHARS_AT_ONCE`` characters or ``DOCS_AT_ONCE`` documents, so what meets in one group is bounded
    by the longest text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CHARS_AT_ONCE = 600_000
DOCS_AT_ONCE = 4_000
MARKER = "▁"

# How byte-level models cut a text before merging.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# End of fixed values.


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves; the other bytes, in order, for the
    characters from U+0100.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_tokens(model: dict) -> list[bytes]:
    """Bytes of each id of a byte-level BPE whose ids follow its merges."""
    byte = byte_of_character()
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    tokens = [b""] * len(vocabulary)
    for text, number in vocabulary.items():
        tokens[number] = bytes([byte[c] for c in text])
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if any(vocabulary[text] != 256 + rank for rank, text in enumerate(joined)):
        raise ValueError("ids do not follow the merges")
    return tokens


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each piece; none for control and unknown pieces."""
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            tokens.append(b"")
        else:
            tokens.append(piece.replace(MARKER, " ").encode())
    return tokens


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes, -1 where none is; the last of several B ids."""
    known = {token: i for i, token in enumerate(b) if token}
    return np.array([known.get(token, -1) for token in a], np.int64)


@dataclass
class Aligner:
    """The two models, given as the contents of their files."""

    byte_level: bytes
    pieces: bytes

    def __post_init__(self) -> None:
        self.a: tiktoken.Encoding | None = None

    def __getstate__(self) -> tuple[bytes, bytes]:
        return self.byte_level, self.pieces

    def __setstate__(self, state: tuple[bytes, bytes]) -> None:
        self.byte_level, self.pieces = state
        self.__post_init__()

    @classmethod
    def load(cls, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Aligner:
        with open(byte_level, "rb") as a, open(pieces, "rb") as b:
            return cls(a.read(), b.read())

    def open(self) -> None:
        if self.a is None:
            self.b = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
            self.a_bytes, self.b_bytes = byte_level_tokens(json.loads(self.byte_level)), piece_tokens(self.b)
            self.same = identity_map(self.a_bytes, self.b_bytes)
            self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
            self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
            # Ids in text with what follows them: in A "," or "|", in B "," or ";".
            signs = [(len(self.a_bytes), b","), (len(self.a_bytes), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";")]
            self.written = [b"%d%b" % (i, sign) for size, sign in signs for i in range(size)]
            ranks = {token: i for i, token in enumerate(self.a_bytes)}
            self.a = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text; none where their bytes are not those of the space and the text."""
        self.open()
        every_b = self.b.encode([t or "" for t in texts], num_threads=1)
        every_a: list[np.ndarray] = []
        none = np.zeros(0, np.int64)
        for i, text in enumerate(texts):
            whole = f" {text}".encode() if text else b""
            ids = self.a.encode_to_numpy(f" {text}", disallowed_special=()).astype(np.int64) if text else none
            # A cuts the bytes themselves, so that their number tells; B's are compared.
            if self.a_sizes[ids].sum() != len(whole) or b"".join([self.b_bytes[n] for n in every_b[i]]) != whole:
                ids, every_b[i] = none, []
            every_a.append(ids)
            every_b[i] = np.array(every_b[i], np.int64)
        return every_a, every_b

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Groups and links of a block of texts, as described in ``aligned``."""
        every_a, every_b = self.encode(texts)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (every_a, every_b))
        a, b = np.concatenate(every_a), np.concatenate(every_b)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        size = int(a_ends[-1]) + 1 if len(a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[a_ends], at_b[b_ends] = True, True
        a_last, b_last = at_b[a_ends], at_a[b_ends]  # the last tokens of their groups
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        a_in, b_in = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        # Links are the stretches between ends of either side: each lies in one token of both.
        ends = np.flatnonzero(at_a | at_b)
        a_link = np.cumsum(at_a)[ends] - at_a[ends]
        b_link = np.cumsum(at_b)[ends] - at_b[ends]
        link_a, link_b, of_group = a[a_link], b[b_link], a_group[a_link]
        plain = (a_in == 1)[of_group] & (b_in == 1)[of_group] & (self.same[link_a] == link_b)
        doc = np.repeat(np.arange(len(texts)), n_a)[a_link]
        pairs, places = np.unique(link_a[~plain] << 32 | link_b[~plain], return_inverse=True)
        # Ids in the order of the digest: by group, A before B.
        a_place = np.arange(len(a)) + np.concatenate([[0], np.cumsum(b_in)])[a_group]
        b_place = np.arange(len(b)) + np.cumsum(a_in)[b_group]
        order = np.empty(len(a) + len(b), np.int64)
        order[a_place] = a + len(self.a_bytes) * a_last
        order[b_place] = b + 2 * len(self.a_bytes) + len(self.b_bytes) * b_last
        stops = np.cumsum(n_a + n_b)
        digests = [
            hashlib.sha256(b"".join(map(self.written.__getitem__, order[last - n : last].tolist()))[:-1]).hexdigest() if n else ""
            for last, n in zip(stops.tolist(), (n_a + n_b).tolist(), strict=True)
        ]
        a_doc = np.repeat(np.arange(len(texts)), n_a)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(a_doc[a_last], minlength=len(texts)),
            "n_links": np.bincount(doc, minlength=len(texts)),
            "groups_sha256": digests,
            "plain": (link_a[plain], np.bincount(doc[plain], minlength=len(texts))),
            "other": (places.ravel(), np.bincount(doc[~plain], minlength=len(texts))),
            "vector": np.bincount(link_a[plain], minlength=len(self.a_bytes)),
            "pairs": pairs,
            "uses": np.bincount(places.ravel(), minlength=len(pairs)),
        }


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (id, text) in batches that end at one of the two limits."""
    for batch in batches:
        chars = np.cumsum([0, *[len(t or "") for t in batch.column(1).to_pylist()]])
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(chars, chars[first] + CHARS_AT_ONCE, "right")) - 1
            last = min(max(last, first + 1), first + DOCS_AT_ONCE, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def aligned(docs: DataFrame, aligner: Aligner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document, in blocks.

    plain holds the A ids of its identity groups, other the places of the pairs of its other links.
    The last document of a block also holds the block's pairs (A id in the upper half, B id in the
    lower) with their links, and the A ids of its identity groups with theirs.
    """
    known_as = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(blocks(batches)):
            found = aligner.align(batch.column(1).to_pylist())
            n = batch.num_rows
            ids = np.flatnonzero(found["vector"])
            at_end = np.arange(n) == n - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, task + number)),
                    batch.column(0),
                    *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(found["groups_sha256"], pa.string()),
                    *[_lists(*found[c], pa.int32()) for c in ("plain", "other")],
                    _lists(found["pairs"], at_end * len(found["pairs"]), pa.int64()),
                    _lists(found["uses"], at_end * len(found["uses"]), pa.int64()),
                    _lists(ids, at_end * len(ids), pa.int32()),
                    _lists(found["vector"][ids], at_end * len(ids), pa.int64()),
                ],
                names,
            )

    names = ["block", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "plain", "other", "pairs", "uses", "ids", "id_uses"]
    schema = (
        f"block bigint, `{key}` {known_as}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "plain array<int>, other array<int>, pairs array<bigint>, uses array<bigint>, ids array<int>, id_uses array<bigint>"
    )
    return docs.select(key, text).mapInArrow(run, schema)


def identity_counts(found: DataFrame, size: int) -> np.ndarray:
    """Links of each A id in identity groups, over the corpus: at most one row for each A id."""
    unfolded = found.select(F.inline(F.arrays_zip("ids", "id_uses")))
    summed = unfolded.groupBy("ids").agg(F.sum("id_uses").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[summed["ids"].to_numpy(np.int64)] = summed["n"]
    return counts


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): links of each pair outside identity groups, over the corpus."""
    unfolded = found.select(F.inline(F.arrays_zip("pairs", "uses")))
    return unfolded.groupBy(F.col("pairs").alias("pair")).agg(F.sum("uses").alias("n"))


def with_counts(found: DataFrame, aligner: Aligner, key: str = "doc_id") -> DataFrame:
    """key, the sizes and digest, n_best and count_sum of every document of a stored ``aligned`` table.

    An identity pair may also occur in other groups (a part of a longer token's bytes never is one,
    but the same two tokens may be linked there), so both kinds of counts are added up by pair.
    """
    aligner.open()
    same, b_size = aligner.same, len(aligner.b_bytes)
    vector = identity_counts(found, len(same))
    counts = stored(pair_counts(found), "pairs")
    # What identity pairs have in other groups; at most one row for each A id.
    spark = found.sparkSession
    mapped = np.flatnonzero(same >= 0)
    twins = spark.createDataFrame([(int(i) << 32 | int(same[i]),) for i in mapped], "twin bigint")
    for row in counts.join(F.broadcast(twins), F.col("pair") == F.col("twin")).select("pair", "n").collect():
        vector[row["pair"] >> 32] += row["n"]
    # The highest count of each B id; at most one row for each.
    best = np.zeros(b_size, np.int64)
    np.maximum.at(best, same[mapped], vector[mapped])
    highest = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).toPandas()
    highest_b = highest["b"].to_numpy(np.int64)
    best[highest_b] = np.maximum(best[highest_b], highest["n"].to_numpy(np.int64))
    plain_best = np.zeros(len(same), bool)
    plain_best[mapped] = vector[mapped] == best[same[mapped]]

    places = found.select(F.col("block").alias("in_block"), F.explode("pairs").alias("of"))
    looked_up = places.join(counts, F.col("of") == F.col("pair")).select("in_block", "pair", "n")
    known_as = found.schema[key].dataType.simpleString()

    def meet(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        pair, n = (pairs.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pair)
        pair, n = pair[order], n[order].copy()
        a, b = pair >> 32, pair & 0xFFFFFFFF
        twin = same[a] == b
        n[twin] = vector[a[twin]]
        is_best = n == best[b]
        total, hits = (np.zeros(len(documents), np.int64) for _ in range(2))
        for name, of, best_of in (("plain", vector, plain_best), ("other", n, is_best)):
            cells = documents.column(name).combine_chunks()
            values = cells.flatten().to_numpy()
            rows = np.repeat(np.arange(len(documents)), cells.value_lengths().to_numpy())
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(of[values])])
            stops = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())])
            total += sums[stops[1:]] - sums[stops[:-1]]
            hits += np.bincount(rows, best_of[values], len(documents)).astype(np.int64)
        kept = [documents.column(c) for c in (key, "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays(
            [*kept, pa.array(hits), pa.array(total), documents.column("groups_sha256")],
            [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    documents = found.select("block", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "plain", "other")
    schema = (
        f"`{key}` {known_as}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "n_best bigint, count_sum bigint, groups_sha256 string"
    )
    return documents.groupBy("block").cogroup(looked_up.groupBy("in_block")).applyInArrow(meet, schema)


def alignment(docs: DataFrame, aligner: Aligner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token, group and link numbers of every document, with the counts of its links over the corpus."""
    return with_counts(stored(aligned(docs, aligner, key, text), "aligned"), aligner, key)


def count_table(docs: DataFrame, aligner: Aligner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair of ids."""
    found = stored(aligned(docs, aligner, key, text), "aligned")
    aligner.open()
    same = aligner.same
    vector = identity_counts(found, len(same))
    rows = [(int(i) << 32 | int(same[i]), int(vector[i])) for i in np.flatnonzero(vector)]
    identities = found.sparkSession.createDataFrame(rows, "pair bigint, n bigint")
    summed = pair_counts(found).unionByName(identities).groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select(
        F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n"
    )
