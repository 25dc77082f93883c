"""Web archive (WARC) files as a Spark data source, and page tables to and from archives.

Reading plans partitions of whole files, packed to about ``PACKED_BYTES`` each. A record's header is
parsed first and tested against the predicates Spark pushes down (record type and every other column
that is a header); only then, and only if a column needs it, its block is read. A payload that is not
asked for is passed over, by seeking in plain files. In compressed files, where each record is a
member of its own, it must be decompressed but is neither kept, parsed nor digested.

Writing gives each task files of its own in a work folder; the driver moves those of tasks that
succeeded, so that a lost executor or a repeated task leaves nothing behind in the archive.

``with_revisits`` writes pages whose payload another page has too as ``revisit`` records, which hold
the HTTP header but no payload.

Columns when read
    record_id, record_type, url, date, refers_to, payload_digest (bare base32 SHA-1): headers, null
    where a record has none. payload_bytes: length of the full payload, for a revisit from its HTTP
    header. payload: the payload's bytes, null for a revisit. intact: whether a payload's SHA-1 is the
    one stated, null if it has no payload or none is stated.

Defined results
    A null payload is written as an empty one. A null id is larger than all others; where a payload has
    null ids only, all are responses. Rows that repeat both id and payload of a response are responses
    as well. Control characters, and blanks at the ends, of a header are percent-encoded. An empty
    table gives an archive without files, which reads as an empty table. Further columns of pages are
    not read. A file that ends inside a record is an error.

Scale
    Equal payloads are found by a 256-bit digest with a combine before the shuffle; only digests that
    occur several times are joined back, and a very frequent one is a skewed join key at most. Pages
    themselves are shuffled only if that join is large. Files end after ``FILE_BYTES``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from seamstat.sources.scratch import shared_folder, stored

# Names of the published format.
VERSION = b"WARC/1.0"
HEADER_OF = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "url": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# End of fixed values.

SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in HEADER_OF])
SCHEMA.add("payload_bytes", T.LongType()).add("payload", T.BinaryType()).add("intact", T.BooleanType())
EPOCH = "1970-01-01T00:00:00Z"
PACKED_BYTES = 64 << 20
FILE_BYTES = 1 << 30
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
CHUNK = 1 << 16
COMPRESSION = 1  # level of the compressed records
PAGE = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing ------------------------------------------------------------------------------


def header_value(value: str) -> str:
    """A value that stands in one header line and is read back without its ends trimmed."""
    ends = len(value) - len(value.lstrip(" ")), len(value.rstrip(" "))
    return "".join([f"%{ord(c):02X}" if c < " " or c == "\x7f" or not ends[0] <= i < ends[1] else c for i, c in enumerate(value)])


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{name}: {header_value(value)}" for name, value in headers if value is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + block + b"\r\n\r\n"


def page_record(record_id: str, kind: str, url: str | None, refers_to: str | None, payload: bytes, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Profile", SAME_PAYLOAD if kind == "revisit" else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(headers, http if kind == "revisit" else http + payload)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Records (record_id, record_type, url, refers_to, payload) as files of one archive folder."""

    def __init__(self, path: str, date: str, compressed: bool) -> None:
        self.path, self.date, self.compressed = path.rstrip("/"), date, compressed
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._folder()
        work = f"{folder}/_work-{self.job}"
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in ("record_id", "record_type", "url", "refers_to", "payload")]
            for row in zip(*columns, strict=True):
                record_id, kind, url, refers_to, payload = (cell.as_py() for cell in row)
                data = page_record(record_id, kind, url, refers_to, payload or b"", self.date)
                if out is not None and size >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    system.create_dir(work, recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.compressed}")
                    out, size = system.open_output_stream(f"{work}/{names[-1]}", compression=None), 0
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
                    size += self._put(out, record(info, b"format: WARC File Format 1.0\r\n"))
                size += self._put(out, data)
        if out is not None:
            out.close()
        return Written(names)

    def _put(self, out: pa.NativeFile, data: bytes) -> int:
        if self.compressed:
            packer = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)  # one gzip member for each record
            data = packer.compress(data) + packer.flush()
        out.write(data)
        return len(data)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        for name in [name for message in messages if message for name in message.names]:
            system.move(f"{folder}/_work-{self.job}/{name}", f"{folder}/{name}")
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        """Remove this job's own work folder."""
        work = f"{folder}/_work-{self.job}"
        if system.get_file_info(work).type == fs.FileType.Directory:
            system.delete_dir(work)


# -- reading ------------------------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def packed(sizes: dict[str, int], most: int) -> list[list[str]]:
    """The files in runs of about ``most`` bytes, by name."""
    runs: list[list[str]] = []
    held = most
    for path in sorted(sizes):
        if held + sizes[path] > most:
            runs.append([])
            held = 0
        runs[-1].append(path)
        held += sizes[path]
    return runs


def read_headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The header of the next record, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    return read_fields(stream)


def read_fields(stream: io.BufferedIOBase) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the file ends inside a header")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:  # a folded line
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip(" \t")
    return found


class Block:
    """What is left of a record's block: reads end with it, and ``leave`` passes over the rest."""

    def __init__(self, stream: io.BufferedIOBase, size: int, seeks: bool) -> None:
        self.stream, self.left, self.seeks = stream, size, seeks

    def readline(self, size: int = -1) -> bytes:
        line = self.stream.readline(self.left if size < 0 else min(size, self.left))
        self.left -= len(line)
        return line

    def read(self, size: int = -1) -> bytes:
        wanted = self.left if size < 0 else min(size, self.left)
        data = self.stream.read(wanted)
        if len(data) < wanted:
            raise ValueError("the file ends inside a block")
        self.left -= len(data)
        return data

    def leave(self) -> None:
        if self.seeks and self.left > CHUNK:
            self.stream.seek(self.left - 1, io.SEEK_CUR)
            self.left = 1
        while self.left:
            self.read(CHUNK)


def bare(value: str | None, name: str) -> str | None:
    """A header's value without the signs around it."""
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if name == "payload_digest" else value


def matches(tests: list[Filter], row: dict) -> bool:
    for test in tests:
        value = row[test.attribute[0]]
        if value is None:
            return False
        if isinstance(test, EqualTo) and value != test.value:
            return False
        if isinstance(test, In) and value not in test.value:
            return False
        if isinstance(test, StringStartsWith) and not value.startswith(test.value):
            return False
    return True


def payload_columns(block: Block, fields: dict[str, str], kind: str, stated: str | None, wanted: set[str]) -> dict:
    """payload_bytes, payload and intact, of which only the wanted ones are worked out."""
    length = None
    if fields.get("content-type", "").startswith("application/http"):
        block.readline()  # the status
        length = read_fields(block).get("content-length")
    if kind == "revisit":
        return {"payload_bytes": int(length) if length else None, "payload": None, "intact": None}
    size = block.left
    if not wanted & {"payload", "intact"}:
        return {"payload_bytes": size, "payload": None, "intact": None}
    payload = block.read()
    intact = payload_digest(payload) == stated if "intact" in wanted and stated else None
    return {"payload_bytes": size, "payload": payload, "intact": intact}


def records(stream: io.BufferedIOBase, seeks: bool, tests: list[Filter], wanted: set[str]) -> Iterator[dict]:
    """The records of one file that pass the tests, header first."""
    while (fields := read_headers(stream)) is not None:
        block = Block(stream, int(fields.get("content-length", "0")), seeks)
        row = {name: bare(fields.get(header.lower()), name) for name, header in HEADER_OF.items()}
        if matches(tests, row):
            if wanted & {"payload_bytes", "payload", "intact"}:
                row |= payload_columns(block, fields, row["record_type"] or "", row["payload_digest"], wanted)
            yield row
        block.leave()


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, packed_bytes: int) -> None:
        self.path, self.schema, self.packed_bytes = path, schema, packed_bytes
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the tests of one header column; Spark keeps the rest."""
        for test in filters:
            of_header = getattr(test, "attribute", ("",))[0] in HEADER_OF and len(test.attribute) == 1
            if of_header and isinstance(test, EqualTo | In | IsNotNull | StringStartsWith):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        system, at = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        sizes = {
            f.path: f.size
            for f in found
            if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path.removeprefix(at)
        }
        return [Files(run) for run in packed(sizes, self.packed_bytes)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        schema = to_arrow_schema(self.schema)
        wanted = set(names)
        rows: list[dict] = []
        held = 0
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths if partition else []:
            with system.open_input_file(path) as raw:
                zipped = path.endswith(".gz")
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw, CHUNK)
                for row in records(stream, not zipped, self.tests, wanted):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield self._batch(rows, names, schema)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, names, schema)

    @staticmethod
    def _batch(rows: list[dict], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[n] for row in rows], schema.field(n).type) for n in names], schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; a schema with fewer columns reads only what they need.

    Options: path; date of written records; compressed (true) for one gzip member a record; packedBytes,
    the bytes of files in one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        kinds = {f.name: f.dataType for f in SCHEMA.fields}
        for field in schema.fields:
            if kinds.get(field.name) != field.dataType:
                raise ValueError(f"not a column of web archives: {field.simpleString()}")
        return WarcReader(self.options["path"], schema, int(self.options.get("packedBytes", PACKED_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode append")
        return WarcWriter(self.options["path"], self.options.get("date", EPOCH), self.options.get("compressed", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let Spark push predicates to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive; only the given columns are read."""
    register(spark)
    reader = spark.read.format("warc")
    if columns:
        reader = reader.schema(T.StructType([SCHEMA[c] for c in columns]))
    return reader.load(path)


def write_archive(found: DataFrame, path: str, date: str = EPOCH, compressed: bool = True) -> None:
    """Add the records (record_id, record_type, url, refers_to, payload) to an archive."""
    register(found.sparkSession)
    chosen = found.select("record_id", "record_type", "url", "refers_to", "payload")
    chosen.write.format("warc").option("date", date).option("compressed", str(compressed).lower()).mode("append").save(path)


# -- pages --------------------------------------------------------------------------------


def record_id(key: Column) -> Column:
    return F.concat(F.lit(PAGE), F.coalesce(key.cast("string"), F.lit("")))


def key_of(record_id: Column, kind: T.DataType) -> Column:
    text = F.substring(record_id, len(PAGE) + 1, 1 << 30)
    return F.when(text != "", text).cast(kind)


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """A record for each page: of equal payloads of at least ``least_bytes``, the one with the smallest
    id is a response and the others revisit it."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    made = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    made = made.withColumn("digest", F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)))
    several = stored(
        made.where(F.col("digest").isNotNull())
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("of", "first"),
        "several-payloads",
    )
    joined = made.join(several, F.col("digest") == F.col("of"), "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select(
        record_id(F.col("key")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "url",
        F.when(again, record_id(F.col("first"))).alias("refers_to"),
        "payload",
    )


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", path: str | None = None) -> DataFrame:
    """Write the pages to an archive and read it back: key, payload_bytes, payload_digest, record_type,
    refers_to and intact of every page. The archive is a new folder of the shared one if none is given."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    write_archive(with_revisits(pages, key, url, html), path)
    found = read_archive(spark, path, ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])
    kind = pages.schema[key].dataType
    return found.where(F.col("record_type").isin("response", "revisit")).select(
        key_of(F.col("record_id"), kind).alias(key),
        "payload_bytes",
        "payload_digest",
        "record_type",
        key_of(F.col("refers_to"), kind).alias("refers_to"),
        "intact",
    )
