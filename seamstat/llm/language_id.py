"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces, by the forward algorithm; that of a
text is the product over its words. The piece probabilities of a language are fitted by
expectation-maximisation on a sample of its texts, with the forward-backward sums.

Words are the maximal runs of letters in the lower-cased text, each with the vocabulary's marker
for a word start. A run of over ``LONGEST`` letters is scored in parts of that length.

Defined results
    A null text, or one without a letter, gets ``und`` and score 0; so does everything when there
    is nothing to learn from. The score is the posterior probability under equal priors; equal
    posteriors go to the first language by code point. A null id is neither held out nor learnt
    from. Repeated rows are scored alike. ``keep_known`` returns the columns as they are, whatever
    their names.

Scale
    One pass over the texts without a shuffle; words recur, so each worker keeps the scores of
    recent ones. The sample is bounded by ``TRAINING_DOCS`` for each language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.llm import piece_model

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_LANGUAGES = 1_000
TRAINING_DOCS = 300  # expected number of sampled documents of each language
ROUNDS = 4
UNKNOWN_LANGUAGE = "und"
WORD_START = "▁"
LONGEST = 32
SMOOTHING = 0.01
REMEMBERED_BYTES = 24 << 20  # of words and their scores, in each worker
WORD_BYTES = 120  # of a dictionary's entry with its key, beside the letters
WORDS_AT_ONCE = 4_000
CHARS_AT_ONCE = 250_000
#: Runs of word characters that are neither digits nor underscores; number signs such as ``²`` are among them.
RUNS = re.compile(r"[^\W\d_]+")
FOLDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 17


def words_of(text: str) -> list[str]:
    found = RUNS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = "".join([c if c.isalpha() else " " for run in found for c in [*run, " "]]).split()
    if not found:
        return []
    if max(map(len, found)) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


class Pieces:
    """A hash table from substrings of a fixed vocabulary to their ids."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = sorted({p for p in pieces if p and RUNS.fullmatch(p.lstrip(WORD_START) or "a")})
        self.unknown, self.absent = len(self.pieces), len(self.pieces) + 1
        self.longest = max(map(len, self.pieces), default=1)
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.ids = np.full(_SLOTS, self.absent, np.int32)
        for i, piece in enumerate(self.pieces):
            key = self._hash_of(piece)
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot]:
                slot = (slot + 1) % _SLOTS
            self.keys[slot], self.ids[slot] = key, i

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)).astype(np.int64)

    @staticmethod
    def _hash_of(piece: str) -> np.uint64:
        key = np.zeros(1, np.uint64)
        for c in piece:
            key = key * _BASE + np.uint64(ord(c) + 1)
        return key[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        slots = self._slot(flat)
        held = self.keys[slots]
        found = np.where(held == flat, self.ids[slots], self.absent)
        open_ = np.flatnonzero((held != flat) & (held != 0))
        while open_.size:
            slots[open_] = (slots[open_] + 1) % _SLOTS
            held = self.keys[slots[open_]]
            hit = held == flat[open_]
            found[open_[hit]] = self.ids[slots[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return found.reshape(keys.shape)

    def spans(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length n: at index l - 1, the piece ids (words, n - l + 1) of the substrings of length l."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = chars.reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        keys, spans = chars, []
        for length in range(1, min(n, self.longest) + 1):
            if length > 1:
                keys = keys[:, :-1] * _BASE + chars[:, length - 1 :]
            spans.append(self.find(keys))
        spans[0] = np.where(spans[0] == self.absent, self.unknown, spans[0])
        return spans


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1)


def forward(spans: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Sums over segmentations of every beginning: (n + 1, words, languages)."""
    n = spans[0].shape[1]
    sums = np.zeros((n + 1, spans[0].shape[0], table.shape[1]))
    sums[0] = 1.0
    for end in range(1, n + 1):
        for length in range(1, min(end, len(spans)) + 1):
            sums[end] += sums[end - length] * table[spans[length - 1][:, end - length]]
    return sums


def expected_counts(pieces: Pieces, words: list[str], uses: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of all words."""
    counts = np.zeros_like(table)
    for group in by_length(words):
        for part in np.array_split(group, len(group) // WORDS_AT_ONCE + 1):
            spans = pieces.spans([WORD_START + words[i] for i in part])
            n = spans[0].shape[1]
            before = forward(spans, table)
            after = np.zeros_like(before)
            after[n] = 1.0
            for start in range(n - 1, -1, -1):
                for length in range(1, min(n - start, len(spans)) + 1):
                    after[start] += after[start + length] * table[spans[length - 1][:, start]]
            weight = uses[part] / before[n]
            for length, ids in enumerate(spans, 1):
                for start in range(n - length + 1):
                    part_of = before[start] * table[ids[:, start]] * after[start + length] * weight
                    for k in range(table.shape[1]):
                        counts[:, k] += np.bincount(ids[:, start], part_of[:, k], len(counts))
    return counts


@dataclass
class LanguageModel:
    """Languages by code point and the probability of each piece (rows) in each of them."""

    pieces: list[str]
    languages: list[str]
    table: np.ndarray

    def __post_init__(self) -> None:
        self.index: Pieces | None = None
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.languages)))

    def __getstate__(self) -> tuple:
        return self.pieces, self.languages, self.table

    def __setstate__(self, state: tuple) -> None:
        self.pieces, self.languages, self.table = state
        self.__post_init__()

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        self.index = self.index or Pieces(self.pieces)
        logs = np.zeros((len(words), len(self.languages)))
        for group in by_length(words):
            for part in np.array_split(group, len(group) // WORDS_AT_ONCE + 1):
                spans = self.index.spans([WORD_START + words[i] for i in part])
                logs[part] = np.log(forward(spans, self.table)[-1])
        return logs

    def _remember(self, documents: list[list[str]]) -> None:
        fresh = {w for words in documents for w in words if w not in self.known}
        if not fresh:
            return
        each = WORD_BYTES + 8 * len(self.languages)
        if (len(self.known) + len(fresh)) * each > REMEMBERED_BYTES:
            self.known, self.logs = {}, np.zeros((0, len(self.languages)))
            fresh = {w for words in documents for w in words}
        listed = sorted(fresh)
        self.known.update(zip(listed, range(len(self.known), len(self.known) + len(listed)), strict=True))
        self.logs = np.concatenate([self.logs, self.word_logs(listed)])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        if not self.languages:
            return [UNKNOWN_LANGUAGE] * len(texts), [0.0] * len(texts)
        names, scores = [], []
        for some in in_parts(texts):
            documents = [words_of(text) if text else [] for text in some]
            self._remember(documents)
            for words in documents:
                if not words:
                    names.append(UNKNOWN_LANGUAGE)
                    scores.append(0.0)
                    continue
                total = self.logs[[self.known[w] for w in words]].sum(0)
                best = int(total.argmax())
                names.append(self.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def in_parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of bounded total length; a longer text is a run of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > CHARS_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_words(docs: DataFrame, per_language: int = TRAINING_DOCS) -> DataFrame:
    """(lang, word, uses) over a sample of the labelled documents outside the held-out fold.

    A language's documents are sampled by a hash of the id, at the rate that makes
    ``per_language`` of them expected.
    """
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    rates = [F.lit(x) for row in sizes for x in (row["lang"], per_language / row["count"])]
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5
    sampled = labelled.where(place < F.try_element_at(F.create_map(*rates), F.col("lang"))) if rates else labelled

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    uses[lang, word] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in uses], pa.string()),
                    pa.array([k[1] for k in uses], pa.string()),
                    pa.array(list(uses.values()), pa.int64()),
                ],
                ["lang", "word", "uses"],
            )

    counted = sampled.select("lang", "text").mapInArrow(count, "lang string, word string, uses bigint")
    return counted.groupBy("lang", "word").agg(F.sum("uses").alias("uses"))


def fit(
    docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = TRAINING_DOCS, rounds: int = ROUNDS
) -> LanguageModel:
    """Fit on the driver, from the bounded word counts of the sample."""
    counted = training_words(docs, per_language).toPandas()
    languages = sorted(set(counted["lang"]))
    pieces = Pieces(piece_model.load(vocabulary).pieces)
    words = sorted(set(counted["word"]))
    size = len(pieces.pieces) + 2  # all unknown characters share a row; the last is of no piece
    table = np.full((size, len(languages)), 1.0 / (size - 1))
    table[-1] = 0.0
    if languages:
        row = {w: i for i, w in enumerate(words)}
        column = {lang: k for k, lang in enumerate(languages)}
        uses = np.zeros((len(words), len(languages)))
        uses[counted["word"].map(row), counted["lang"].map(column)] = counted["uses"]
        for _ in range(rounds):
            counts = expected_counts(pieces, words, uses, table)[:-1] + SMOOTHING
            table[:-1] = counts / counts.sum(0)
    return LanguageModel(pieces.pieces, languages, table)


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    known_as = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [key, "lang_pred", "score"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {known_as}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least the given posterior, columns unchanged."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.score(batch.column(at).to_pylist())
            kept = [n != UNKNOWN_LANGUAGE and s >= least for n, s in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
