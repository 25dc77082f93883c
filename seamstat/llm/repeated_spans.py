"""Substring deduplication over sliding spans of sentences.

A sentence ends with a word that ends in ``.``, ``!``, ``?`` or ``…``, at a line break, and at the end of the
text. One of over ``LONG`` words is cut again after every word whose hash is divisible by ``CUT``, so that
stretches without signs are cut by their content, alike wherever they stand.

At each sentence begins one span: the shortest run of sentences with at least ``SENTENCES`` sentences and
``WORDS`` words; the last of a text also counts extended to the end of the text. Spans are compared over all
documents by a 64-bit hash of their lower-cased words (A-Z). The first of equal ones, by document and place,
stays; every sentence that another of them covers is removed.

A repeated passage holds a whole span, wherever it begins, unless cuts are far apart at both of its ends: one
of 51 words without any sign is missed once in about 250 times, longer ones less often. What is left of
a passage are its first and last words up to the nearest cuts, about ``CUT`` words each.

Defined results
    A null text stays null and has no sentence. Blank stretches belong to the sentence before them.
    Repeated rows of one id and text are one document, so they do not remove each other; texts that
    differ are different documents, whatever their ids. A row with a null id is kept as it is. An empty table
    gives an empty result. Further columns are carried along by ``remove`` and may have any names that do
    not start with ``__span_``.

Scale
    One row goes through the shuffle for each sentence that begins a span. Hashes are reduced to the first
    place of each before a join, with a combine before the shuffle. A passage in a third of all documents is a
    skewed join key, which adaptive execution splits. Only the places inside one document meet in one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.llm.shingles import mixed, word_hashes
from seamstat.sources.scratch import stored

SENTENCES = 2
WORDS = 24
LONG = 8
CUT = 4
BYTES_AT_ONCE = 1 << 20

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


@dataclass
class Block:
    """Words and sentences of several texts."""

    starts: np.ndarray  # of the words, in the bytes of all texts
    hashes: np.ndarray
    bounds: np.ndarray  # of each text, the number of words before it; the last for the end
    offsets: np.ndarray  # of each text, the number of bytes before it
    first: np.ndarray  # word of each sentence, and the number of words at the end


def split(texts: list[bytes]) -> Block:
    data = b"".join([text.lower() + b"\n" for text in texts]) or b"\n"
    codes = np.frombuffer(data, np.uint8)
    starts, hashes = word_hashes(data)
    offsets = np.cumsum([0, *[len(text) + 1 for text in texts]])
    bounds = np.searchsorted(starts, offsets)
    n = len(starts)
    # The last byte of each word: the one before the first blank after its start.
    blank = np.flatnonzero(np.isin(codes, np.frombuffer(b" \t\n\v\f\r", np.uint8)))
    stops = blank[np.searchsorted(blank, starts)] if n else starts
    ends = _STOP[codes[stops - 1]]
    ellipsis = stops - 3 >= 0
    for back, byte in ((1, 0xA6), (2, 0x80), (3, 0xE2)):
        ellipsis &= codes[np.maximum(stops - back, 0)] == byte
    lines = np.cumsum(codes == 0x0A)  # each text ends with one
    after = np.append(starts[1:], len(data) - 1)
    ends |= ellipsis | (lines[after] - (codes[after] == 0x0A) > lines[stops] - (codes[stops] == 0x0A))
    if n:
        ends[-1] = True
    sentence = np.cumsum(ends) - ends
    long = np.bincount(sentence, minlength=1)[sentence] > LONG if n else ends
    cut = ends | long & (hashes % np.uint64(CUT) == 0)
    return Block(starts, hashes, bounds, offsets[:-1], np.concatenate([[0], np.flatnonzero(cut) + 1]))


def spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, run) of every span; a run holds its first word, within the text, in its upper half, and the
    word after its last in its lower."""
    n = len(block.hashes)
    first, stop = block.first[:-1], block.first[1:]
    text = np.searchsorted(block.bounds, first, "right") - 1
    last = np.maximum(np.arange(len(first)) + SENTENCES - 1, np.searchsorted(stop, first + WORDS))
    fits = last < len(first)
    fits &= text[np.minimum(last, max(len(first) - 1, 0))] == text if len(first) else fits
    begin, end, of = first[fits], stop[last[fits]], text[fits]
    # The last span of each text once more, to the end of the text.
    final = np.flatnonzero(np.append(of[1:] != of[:-1], True)[: len(of)])
    tail = block.bounds[of[final] + 1]
    more = tail > end[final]
    begin, end, of = (np.concatenate([a, b[more]]) for a, b in ((begin, begin[final]), (end, tail), (of, of[final])))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(block.hashes * _powers(_BASE, n), out=sums[1:])
    values = mixed((sums[end] - sums[begin]) * _powers(_INVERSE, n + 1)[begin] + (end - begin).astype(np.uint64))
    before = block.bounds[of]
    return of, values.view(np.int64), (begin - before) << 32 | (end - before)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded length as bytes, with the place of their first; a longer text is a run of its own."""
    at, part, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if part and size + len(data) > BYTES_AT_ONCE:
            yield at, part
            at, part, size = i, [], 0
        part.append(data)
        size += len(data)
    if part:
        yield at, part


def _digest(text: str) -> Column:
    """What tells different texts of one id apart."""
    return F.xxhash64(F.col(text))


def span_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(hash, doc_id, digest, run) of all spans."""
    known_as = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(2).to_pylist()):
                of, values, runs = spans(split(texts))
                rows = pa.array(of + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(runs)], ["hash", "doc_id", "digest", "run"]
                )

    known = docs.select(F.col(key).alias("doc_id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.mapInArrow(run, f"hash bigint, doc_id {known_as}, digest bigint, run bigint")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, spans): the words of every repeated span, and whether it is a later one of its kind."""
    every = stored(span_table(docs, key, text), "spans")
    place = F.struct("doc_id", "digest", "run")
    # Written, because a join with a grouped table itself could not split a frequent passage.
    several = stored(
        every.groupBy(F.col("hash").alias("of"))
        .agg(F.min(place).alias("earliest"), F.max(place).alias("latest"))
        .where("earliest < latest")
        .select("of", "earliest"),
        "several",
    )
    found = every.join(several, F.col("hash") == F.col("of"))
    marks = found.select("doc_id", "digest", F.struct("run", (place != F.col("earliest")).alias("later")).alias("span"))
    return marks.groupBy("doc_id", "digest").agg(F.collect_set("span").alias("spans"))


def _covered(found: list[dict] | None, size: int) -> np.ndarray:
    """(2, words): what any span covers, and what a later one does."""
    steps = np.zeros((2, size + 1), np.int64)
    for s in found or ():
        first, after = s["run"] >> 32, s["run"] & 0xFFFFFFFF
        steps[: 1 + s["later"], first] += 1
        steps[: 1 + s["later"], after] -= 1
    return np.cumsum(steps, 1)[:, :size] > 0


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with the text that stays, and three counts after the other columns.

    n_sentences counts the sentences, n_repeated those in any repeated span, n_removed those in one that is
    not the first of its kind.
    """
    marks = stored(repeated(docs, key, text), "repeated").select(
        F.col("doc_id").alias("__span_id"), F.col("digest").alias("__span_digest"), F.col("spans").alias("__span_found")
    )
    marked = docs.join(marks, (F.col(key) == F.col("__span_id")) & (_digest(text) == F.col("__span_digest")), "left")
    marked = marked.drop("__span_id", "__span_digest")
    at = marked.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column("__span_found").to_pylist()
            counts = np.zeros((3, len(texts)), np.int64)
            for start, part in blocks(texts):
                block = split(part)
                of = np.searchsorted(block.bounds, block.first[:-1], "right") - 1
                counts[0, start : start + len(part)] = np.bincount(of, minlength=len(part))
                for i in [i for i in range(len(part)) if found[start + i]]:
                    low, high = block.bounds[i], block.bounds[i + 1]
                    covered = _covered(found[start + i], int(high - low))
                    inner = block.first[:-1][of == i] - low
                    counts[1:, start + i] = covered[:, inner].sum(1)
                    if covered[1].any():
                        edges = np.append(block.starts[low:high] - block.offsets[i], len(part[i]))
                        edges[0] = 0
                        kept = [part[i][edges[w] : edges[w + 1]] for w in np.flatnonzero(~covered[1])]
                        texts[start + i] = b"".join(kept).decode("utf-8", "surrogatepass")
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(row) for row in counts]], [*batch.schema.names[:-1], "n_sentences", "n_repeated", "n_removed"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return marked.mapInArrow(run, ", ".join([*fields, "n_sentences bigint", "n_repeated bigint", "n_removed bigint"]))
