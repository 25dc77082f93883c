"""Near-duplicate documents by MinHash.

A document's set holds its distinct shingles of five words. Two documents are linked if the
Jaccard similarity of their sets is at least 0.75, and groups are what links connect.

1. Each text gives its set's size, a digest of the whole set, ``BANDS`` keys of ``ROWS`` minima
   each under universal hash functions, and a mixed bit of each of ``MINIMA`` minima as a signature.
   Documents with equal digests have similarity 1; only the smallest of them goes on.
2. Documents that share a band key form a bucket, led by its smallest. Every member is compared
   with the leader it shares most bands with: by signature, which drops a pair only when 3.5
   standard deviations below the limit, then by the full sets. The links found are closed to
   components. Where two components meet, the pair of a leader and a member that shares most bands
   is compared, and after that every member with the leaders that it is still apart from.
3. In a bucket that still holds several components, every member outside its largest component is
   compared with all members of other components, in the same two steps. So each pair in a common
   bucket that could change a component is looked at, and pairs within one are not.

A pair at exactly 0.75 shares no bucket with probability 3e-4, and its signature drops it with 2e-4;
at 0.8 both are below 1e-5.

Defined results
    A null or blank text has an empty set, is linked with nothing and is its own component; so is
    a row with a null id, whose component is null and which is kept. Rows with one id and text that is
    not blank count as one document: what one of them is linked with, all are, and all of them are
    kept or none. Further
    columns are not read. An empty table gives an empty result.

Scale
    No pair within equal sets is formed, and within a component one for each member and band at most.
    Digests, bands and links stay in Spark tables. Full sets are read again from the texts, of the
    documents in pairs that pass the signature only. Large groups are skewed join keys, which
    adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.llm.components import components, merged
from seamstat.llm.shingles import mixed, shingle_sets
from seamstat.sources.scratch import stored

BANDS, ROWS = 42, 6
MINIMA = 1024  # hash functions; the bands use the first BANDS * ROWS
PERCENT = 75
DEVIATIONS = 3.5
ELEMENTS_AT_ONCE = 1 << 15
SETS_AT_ONCE = 512  # whose minima are held at one time

_random = np.random.default_rng(17)
_FACTORS = _random.integers(0, 2**31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, MINIMA, np.uint32)
_IN_BAND = _random.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, hash functions): the least hash of each set under each function; sets are not empty."""
    out = np.empty((len(sets), len(_FACTORS)), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= ELEMENTS_AT_ONCE):
            size += len(sets[last])
            last += 1
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        values = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
            hashed = values * factor
            hashed += shift
            out[first:last, k] = np.minimum.reduceat(hashed, starts)
        first = last
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    grouped = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = (grouped * _IN_BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mixed(keys).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, in 64-bit words.

    The bit comes from a mix of the whole minimum: its own lowest bit is the same for a shingle
    under every function, as the factors are odd.
    """
    bits = mixed(least.astype(np.uint64)) >> np.uint64(63)
    return np.packbits(bits.astype(bool), axis=1, bitorder="little").view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, bands and signature; the last three null for an empty set."""
    known_as = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SETS_AT_ONCE):
            sets = list(shingle_sets(batch.column(1).to_pylist()))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            digests, bands, signatures = ([None] * len(sets) for _ in range(3))
            least = minima([sets[i] for i in full])
            for i, keys, low in zip(full, band_keys(least), packed(least), strict=True):
                digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                bands[i] = keys
                signatures[i] = low
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signatures, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    schema = f"doc_id {known_as}, n_shingles bigint, digest binary, bands array<bigint>, signature array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def alike(left: Column, right: Column, percent: int = PERCENT) -> Column:
    """Whether two signatures do not rule the similarity out.

    A bit is equal if the minima are, and else by even chance. The number of bits that differ is
    compared with its expectation at the limit and ``DEVIATIONS`` standard deviations more.
    """
    equal = (1 + percent / 100.0) / 2
    most = MINIMA * (1 - equal) + DEVIATIONS * (MINIMA * equal * (1 - equal)) ** 0.5
    differing = F.lit(0)
    for word in range(MINIMA // 64):
        differing = differing + F.bit_count(left[word].bitwiseXOR(right[word]))
    return differing <= F.lit(int(most))


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids``, as sorted 64-bit hashes."""
    known_as = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SETS_AT_ONCE):
            packed = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])

    own = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return own.mapInArrow(run, f"id {known_as}, shingles binary")


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, ...) whose full sets have the similarity."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(full_sets(docs, stored(ids, "pair-ids")), "pair-sets")
    own = range(len(pairs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):  # without copies
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(list(own)).filter(pa.array(near, pa.bool_()))

    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .select(*pairs.columns, "left", "right")
        .mapInArrow(run, pairs.schema)
    )


def _root(component: DataFrame, node: str, name: str, df: DataFrame) -> DataFrame:
    """Add the component's smallest node, which is the node itself outside of all links."""
    known = component.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    joined = df.join(known, F.col(node) == F.col("__node"), "left")
    return joined.withColumn(name, F.coalesce("__root", node)).drop("__node", "__root")


def _apart(placed: DataFrame) -> DataFrame:
    """(key, id, root, head, head_root) of the buckets that hold several components, with their smallest member."""
    placed = stored(placed, "placed")
    spread = placed.groupBy(F.col("key").alias("of_key")).agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("head"), F.min_by("root", "id").alias("head_root")
    )
    # Written, because a join with a grouped table itself could not split a large bucket.
    open_ = stored(spread.where("low < high").select("of_key", "head", "head_root"), "open")
    return stored(placed.join(open_, F.col("key") == F.col("of_key")).drop("of_key"), "apart")


def _with_heads(apart: DataFrame) -> DataFrame:
    """(a, b, low, high): the leader of each bucket with each member of another component, and both components."""
    return apart.where("root != head_root").select(
        F.col("head").alias("a"),
        F.col("id").alias("b"),
        F.least("root", "head_root").alias("low"),
        F.greatest("root", "head_root").alias("high"),
    )


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    every = stored(signed(docs), "signed")
    # Texts with one digest have one set, and so the same bands and signature.
    firsts = stored(
        every.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "firsts",
    )
    one_of = firsts.select("digest", "id")
    marks = firsts.select("id", F.explode("bands").alias("key"))
    shared = marks.groupBy(F.col("key").alias("of_key")).agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    # Written, because a join with a grouped table itself could not split a large bucket.
    shared = stored(shared.where("leader < last").select("of_key", "leader"), "leaders")
    buckets = stored(marks.join(shared, F.col("key") == F.col("of_key")).select("key", "id", "leader"), "buckets")
    signatures = firsts.select("id", "signature")

    def linked(pairs: DataFrame) -> DataFrame:
        near = (
            pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("left")), "a")
            .join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("right")), "b")
            .where(alike(F.col("left"), F.col("right"), percent))
        )
        return confirmed(docs, stored(near.select(*pairs.columns), "pairs"), percent)

    def closed(links: DataFrame) -> DataFrame:
        """(node, root) of the components that the links join."""
        return components(stored(links.select(F.col("low").alias("a"), F.col("high").alias("b")), "links"))

    # Each member with the leader that it shares most bands with, then with those still apart from it.
    closest = buckets.where("id > leader").groupBy(F.col("id").alias("b")).agg(F.mode("leader", True).alias("a"))
    links, again = linked(closest.select("a", "b")), _same_id(every, one_of)
    component = components(stored(links if again is None else links.unionByName(again), "links"))
    # Of two components that meet in buckets, first the pair that shares most bands, then all pairs.
    apart = _apart(_root(component, "id", "root", buckets.select("key", "id")))
    meeting = _with_heads(apart).groupBy("a", "b", "low", "high").agg(F.count(F.lit(1)).alias("n"))
    best = meeting.groupBy("low", "high").agg(F.max_by(F.struct("a", "b"), F.struct("n", "a", "b")).alias("pair"))
    more = closed(linked(best.select("pair.*", "low", "high")))
    component = merged(component, more)
    apart = _apart(_root(more, "root", "root", apart.select("key", "id", "root")))
    more = closed(linked(_with_heads(apart).distinct()))
    component = merged(component, more)

    # What is left: buckets that still hold several components.
    apart = _apart(_root(more, "root", "root", apart.select("key", "id", "root")))
    counts = apart.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = stored(
        counts.groupBy(F.col("key").alias("of_key")).agg(F.max_by("root", F.struct("n", "root")).alias("largest")), "largest"
    )
    several = stored(
        apart.join(largest, F.col("key") == F.col("of_key"))
        .select("key", "id", "root", (F.col("root") == F.col("largest")).alias("bulk"))
        .join(apart.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")
        .join(signatures, "id"),
        "several",
    )
    few, rest = several.where("NOT bulk").alias("f"), several.alias("r")
    crossing = few.join(
        rest,
        (F.col("f.key") == F.col("r.key"))
        & (F.col("f.root") != F.col("r.root"))
        & (F.col("r.bulk") | (F.col("r.id") > F.col("f.id")))
        & alike(F.col("f.signature"), F.col("r.signature"), percent)
        # A pair in several buckets counts in one of them.
        & (F.array_min(F.array_intersect("f.keys", "r.keys")) == F.col("f.key")),
    )
    more = stored(
        crossing.select(
            F.col("f.id").alias("a"), F.col("r.id").alias("b"), F.col("f.root").alias("low"), F.col("r.root").alias("high")
        ),
        "crossing",
    )
    if not more.isEmpty():
        component = merged(component, closed(confirmed(docs, more, percent)))

    of_digest = stored(_root(component, "id", "component_id", one_of).select(F.col("digest").alias("of"), "component_id"), "roots")
    return (
        every.select("doc_id", "n_shingles", "digest")
        .join(of_digest, F.col("digest") == F.col("of"), "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _same_id(every: DataFrame, one_of: DataFrame) -> DataFrame | None:
    """Links (a, b) between the groups of copies that hold different texts of one id, if there are any."""
    texts = every.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("digest").alias("least"), F.max("digest").alias("most")
    )
    several = stored(texts.where(F.col("least") != F.col("most")).select("doc_id"), "several-texts")
    if several.isEmpty():
        return None
    own = every.join(several, "doc_id", "left_semi").select("doc_id", "digest").join(one_of, "digest")
    return own.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest of their group, columns unchanged."""
    dropped = stored(groups(docs, percent).where("NOT kept").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
