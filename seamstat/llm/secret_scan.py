"""Secret scans by fixed patterns and by character Markov models.

Three patterns find assignments of passwords and the like, access keys, and long hexadecimal
strings. Beyond them, every run of ``TOKEN`` characters is compared under two first-order Markov
models of its characters, one of random strings and one of ordinary words and identifiers; a run
whose log-likelihood ratio is at least ``THRESHOLD`` for each character is a secret too, if it
holds a letter and does not overlap a span of a pattern.

The models are trained from labelled samples: random are the values that the patterns find in a
bounded sample of the documents, and strings drawn with a fixed seed from the usual alphabets of
keys; ordinary are the words of the same sample outside of those values.

Defined results
    A null or empty text has no span. Spans count code points, with an exclusive end, and are
    ordered by start and then as assign, access, hex, markov. Repeated rows are scanned alike.
    An empty table gives an empty result. ``mask`` returns the columns as they are, whatever
    their names.

Scale
    One pass over the texts without a shuffle. Training reads ``SAMPLE_DOCS`` expected documents
    and brings at most one count for each pair of characters and label to the driver.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the check.
ASSIGN = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 16
HEX = r"[0-9a-f]+"
HEX_LENGTH = 32
KINDS = ("assign", "access", "hex", "markov")
# End of fixed values.

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 1.0
SAMPLE_DOCS = 2_000
DRAWN = 2_000
SEED = 11
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
ORDINARY_WORD = re.compile(r"[A-Za-z0-9+/_=.-]{3,}")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % ACCESS_LENGTH)  # holds every access key, hex string and token
_token = re.compile(TOKEN)
_codes = np.full(128, len(SYMBOLS), np.int64)
_codes[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))

Span = tuple[int, int, int]  # start, place of the kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(word in lower for word in ASSIGN_WORDS):
            spans += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for run in _run.finditer(text):
        at = run.start()
        spans += [(at + m.start(), 1, at + m.end()) for m in _access.finditer(run[0]) if len(m[0]) >= ACCESS_LENGTH]
        spans += [(at + m.start(), 2, at + m.end()) for m in _hex.finditer(run[0]) if len(m[0]) >= HEX_LENGTH]
    return sorted(spans)


def pairs(token: str) -> np.ndarray:
    """Places of a token's neighbouring characters in a flat table of pairs; the start counts as one."""
    codes = _codes[np.frombuffer(token.encode("ascii"), np.uint8)]
    return np.concatenate([[len(SYMBOLS)], codes[:-1]]) * (len(SYMBOLS) + 1) + codes


@dataclass
class SecretModel:
    """Log-likelihood ratios of pairs of characters, random against ordinary."""

    ratios: np.ndarray

    def ratio(self, token: str) -> float:
        return float(self.ratios[pairs(token)].mean())

    def spans(self, text: str) -> list[Span]:
        spans = base_spans(text)
        more, at, reach = [], 0, 0  # the spans before ``at`` begin before the token and end by ``reach``
        for m in _token.finditer(text):
            while at < len(spans) and spans[at][0] < m.end():
                reach = max(reach, spans[at][2])
                at += 1
            if reach <= m.start() and any(map(str.isalpha, m[0])) and self.ratio(m[0]) >= THRESHOLD:
                more.append((m.start(), 3, m.end()))
        return sorted(spans + more)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> SecretModel:
    """Count neighbouring characters of labelled strings in a sample of the documents."""
    size = docs.count()
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5
    sampled = docs.select("text").where(F.col("text").isNotNull() & (place < sample / max(size, 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text in batch.column(0).to_pylist():
                outside, last = [], 0
                for start, _, end in base_spans(text):
                    for token in ORDINARY_WORD.findall(text[start:end])[-1:]:
                        counts.update((True, int(p)) for p in pairs(token))
                    outside.append(text[last:start])
                    last = max(last, end)
                outside.append(text[last:])
                for part in outside:
                    for token in ORDINARY_WORD.findall(part):
                        counts.update((False, int(p)) for p in pairs(token))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in counts], pa.bool_()),
                    pa.array([k[1] for k in counts], pa.int64()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["random", "pair", "uses"],
            )

    counted = sampled.mapInArrow(count, "random boolean, pair bigint, uses bigint")
    side = len(SYMBOLS) + 1
    tables = {True: np.zeros(side * side), False: np.zeros(side * side)}
    for row in counted.groupBy("random", "pair").agg(F.sum("uses").alias("uses")).collect():
        tables[row["random"]][row["pair"]] = row["uses"]
    draw = random.Random(SEED)
    for alphabet in ALPHABETS.values():
        for _ in range(DRAWN):
            np.add.at(tables[True], pairs("".join(draw.choices(alphabet, k=32))), 1.0)
    logs = {}
    for label, table in tables.items():
        smooth = table.reshape(side, side) + 0.5
        logs[label] = np.log(smooth / smooth.sum(1, keepdims=True))
    return SecretModel((logs[True] - logs[False]).ravel())


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, model: SecretModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts of base spans, their digest, and all spans."""
    known_as = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.spans(t) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in spans if s[1] < 3] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string())],
                [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = f"`{key}` {known_as}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select(key, text).mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each union of overlapping spans replaced by the kind of its first."""
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind]}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame, model: SecretModel, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows with secrets masked in the text; ``length`` names a column that counts it."""
    at = docs.columns.index(text)
    length_at = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            old = columns[at].to_pylist()
            new = [masked(t, model.spans(t)) if t else t for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                counts = columns[length_at].to_pylist()
                counts = [n if a == b else len(b) for n, a, b in zip(counts, old, new, strict=True)]
                columns[length_at] = pa.array(counts, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
