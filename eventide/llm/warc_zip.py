"""WARC records in ZIP packages, written and read back by byte ranges.

A package is a ZIP archive with stored (not deflated) members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdxj``, one line per record with its
offset and length in the archive member.  A reader finds the end of central directory
record (and the ZIP64 one that it may point to), parses the central directory, adds the
local header's size to locate a stored member, and then reads the index and single
records by range; nothing is extracted and no whole package is held in memory.

Packages live where ``spark.checkpoint.dir`` points, so all executors can reach them.
Every attempt of a task writes under names of its own, and the manifest that Spark commits names the packages of
the attempts that count: what another attempt left, wholly or in part, is never read.

Defined cases: a null payload is empty; a null URL leaves out the target header; a null id and an empty one are told
apart; records with equal payloads of at least ``revisit_bytes`` bytes revisit the one with the smallest
id, also if one payload has a third of the rows; rows that repeat an id are written as
records of their own; an empty table gives an empty result; columns other than those
named are ignored.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, looked_up, stored, text_or_empty, work_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Fixed values of the ZIP format: signatures and fixed-size parts of its structures.
END_OF_DIRECTORY = struct.Struct("<4s4H2LH")
ZIP64_LOCATOR = struct.Struct("<4sLQL")
ZIP64_END = struct.Struct("<4sQ2H2L4Q")
DIRECTORY_ENTRY = struct.Struct("<4s6H3L5H2L")
LOCAL_HEADER = struct.Struct("<4s5H3L2H")


# --- ZIP directories -------------------------------------------------------------

ReadRange = Callable[[int, int], bytes]


def zip_members(read: ReadRange, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the local header, stored size, method), from the directories alone."""
    tail_at = max(0, size - (1 << 16) - END_OF_DIRECTORY.size)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        # the comment must reach the end of the file; its text may hold the signature too
        if at + END_OF_DIRECTORY.size <= len(tail) and at + END_OF_DIRECTORY.size + END_OF_DIRECTORY.unpack_from(tail, at)[7] == len(tail):
            break
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    _, _, _, _, entries, length, offset, _ = END_OF_DIRECTORY.unpack_from(tail, at)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
        end_at = tail_at + at
        signature, _, where, _ = ZIP64_LOCATOR.unpack(read(end_at - ZIP64_LOCATOR.size, ZIP64_LOCATOR.size))
        if signature != b"PK\x06\x07":
            raise ValueError("the ZIP64 end of central directory is missing")
        fields = ZIP64_END.unpack(read(where, ZIP64_END.size))
        if fields[0] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of central directory is damaged")
        entries, length, offset = fields[7], fields[8], fields[9]
    directory, members, at = read(offset, length), {}, 0
    for _ in range(entries):
        f = DIRECTORY_ENTRY.unpack_from(directory, at)
        if f[0] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, unpacked, name_len, extra_len, comment_len, local = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        at += DIRECTORY_ENTRY.size
        name = directory[at : at + name_len].decode("utf-8", "replace")
        extra = directory[at + name_len : at + name_len + extra_len]
        at += name_len + extra_len + comment_len
        wide = _extra_field(extra, 1)
        for which in ("unpacked", "packed", "local"):
            if {"unpacked": unpacked, "packed": packed, "local": local}[which] == 0xFFFFFFFF:
                value, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
                unpacked, packed, local = (value if which == k else v for k, v in (("unpacked", unpacked), ("packed", packed), ("local", local)))
        members[name] = (local, packed, method)
    return members


def _extra_field(extra: bytes, wanted: int) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == wanted:
            return extra[at + 4 : at + 4 + length]
        at += 4 + length
    return b""


def stored_range(read: ReadRange, member: tuple[int, int, int]) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes."""
    local, length, method = member
    if method != 0:
        raise ValueError("the member is compressed: it cannot be read by range")
    f = LOCAL_HEADER.unpack(read(local, LOCAL_HEADER.size))
    if f[0] != b"PK\x03\x04":
        raise ValueError("the local header is damaged")
    return local + LOCAL_HEADER.size + f[9] + f[10], length


# --- records -------------------------------------------------------------------------


def record_name(record_id: str | None) -> str:
    """The name of a record in its header; a null id has one that no other id can have."""
    return "<urn:x-record-null>" if record_id is None else f"<urn:x-record:{quote(record_id)}>"


def record_id(name: str) -> str | None:
    return None if name == "<urn:x-record-null>" else unquote(name.removeprefix("<urn:x-record:").removesuffix(">"))


def warc_record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with headers only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (b"" if refers_to is not None else payload)
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(record_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # only what would break the header line is escaped
        fields.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    fields += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and HTTP payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def file_system(uri: str):  # noqa: ANN201
    """The Arrow file system of a URI, and the path in it; names that Hadoop has for object stores are known too."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    uri = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + colon + rest
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- Spark jobs ---------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the id to revisit, or null.

    The first id of each repeated payload is an aggregation over digests; only digests with
    several rows are joined back.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "first_id")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    # while repeated digests are few, payloads go from the scan to their package without a shuffle
    return joined(rows, stored(firsts, "warc-firsts"), "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes records (of ``with_revisits``) as packages into ``folder``: one or more a task.

    Returns (package, records, bytes), read from a manifest that is written with them.
    """
    spark = records.sparkSession
    rows = records.select(F.col("id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        done, package, part = [], None, 0
        for batch in batches:
            for id_, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if package is None:
                    package = _Package(system, f"{base}/part-{task:05d}-{attempt}-{part:04d}.wacz")
                record = gzip.compress(warc_record(id_, url, payload, digest, refers), 1, mtime=0)
                package.add(record, id_, url, digest)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package, part = None, part + 1
        if package is not None:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["package", "records", "bytes"])

    manifest = f"{folder}/manifest"
    rows.mapInArrow(run, "package string, records long, bytes long").write.parquet(manifest)
    return spark.read.schema("package string, records long, bytes long").parquet(manifest)


class _Package:
    """A ZIP package in the making."""

    def __init__(self, system, path: str):  # noqa: ANN001
        self.path = path
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Unseekable(self.stream), "w", zipfile.ZIP_STORED)
        info = zipfile.ZipInfo(ARCHIVE, (2024, 1, 1, 0, 0, 0))
        self.member = self.zip.open(info, "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, record: bytes, id_: str | None, url: str | None, digest: str) -> None:
        self.member.write(record)
        self.index.append(json.dumps({"id": id_, "url": url, "digest": digest, "offset": self.size, "length": len(record)}))
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "\n".join(self.index) + "\n")
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index), self.size


class _Unseekable:
    """What zipfile needs of a stream that can only be written on."""

    def __init__(self, stream):  # noqa: ANN001
        self.stream, self.at = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None: ...

    def close(self) -> None: ...


def package_index(packages: DataFrame, folder: str) -> DataFrame:
    """(package, offset, length): where each record lies in its package, from its directories and index member.

    Offsets count from the start of the package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as f:
                    read = lambda at, n, f=f: f.read_at(n, at)
                    members = zip_members(read, f.size())
                    data_at, _ = stored_range(read, members[ARCHIVE])
                    index_at, index_len = stored_range(read, members[INDEX])
                    for lines in _lines(read, index_at, index_len):
                        entries = [json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries)), pa.array([data_at + e["offset"] for e in entries], pa.int64()), pa.array([e["length"] for e in entries], pa.int64())], names=["package", "offset", "length"])

    return packages.select("package").mapInArrow(run, "package string, offset long, length long")


def _lines(read: ReadRange, at: int, length: int, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lines of a byte range, a block at a time."""
    rest, end = b"", at + length
    while at < end:
        data = rest + read(at, min(block, end - at))
        at += min(block, end - at)
        *lines, rest = data.split(b"\n")
        if lines:
            yield lines
    if rest:
        yield [rest]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, record_type, url, refers_to, digest, payload), each record read by its range."""
    # ranges of one stretch of a package stay together, and a large package is dealt over many tasks
    spread = index.repartition(F.col("package"), F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("package", "offset")
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        path, file = None, None
        for batch in batches:
            rows, held = [], 0
            for p, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != path:
                    if file is not None:
                        file.close()
                    path, file = p, system.open_input_file(p)
                fields, payload = parse_record(gzip.decompress(file.read_at(n, at)))
                name = lambda k, fields=fields: record_id(fields[k]) if k in fields else None
                rows.append((name("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), name("warc-refers-to"), fields["warc-payload-digest"].removeprefix("sha256:"), payload))
                held += len(payload)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        if file is not None:
            file.close()

    return spread.mapInArrow(run, "record_id string, record_type string, url string, refers_to string, digest string, payload binary")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes all pages as packages and reads them back: one row per record.

    Size and digest are taken from the payload bytes that were read; a revisit gets those
    of the record that it refers to, whose digest must be the one that it names.
    """
    folder = folder or work_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    packages = write_packages(with_revisits(pages, id_col, url_col, payload_col), folder)
    read = read_records(package_index(packages.repartition("package"), folder), folder)
    facts = read.select(F.col("record_id").cast(kind).alias(id_col), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url", F.col("digest").alias("named"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    facts = stored(facts, "warc-records")
    own = facts.where("record_type = 'response'").select(id_col, "payload_bytes", same(F.col("payload_digest"), F.col("named")).alias("payload_digest"), "record_type", "refers_to", "url")
    # a row that repeats an id may be a response with another payload, so a revisit looks for id and digest
    seen = own.groupBy(F.col(id_col).alias("_to"), F.col("payload_digest").alias("_digest")).agg(F.min("payload_bytes").alias("_bytes"))
    revisits = facts.where("record_type = 'revisit'").drop("payload_bytes")
    asked = revisits.groupBy("refers_to", "named").agg(F.count(F.lit(1)).alias("_n"))
    known = stored(asked.join(seen, (F.col("refers_to") == F.col("_to")) & (F.col("named") == F.col("_digest")), "left").drop("_to"), "warc-revisited")
    total, keys = known.agg(F.sum("_n"), F.count(F.lit(1))).head()
    again = looked_up(revisits, known, ["refers_to", "named"], "_n", total or 0, keys)
    again = again.select(id_col, F.col("_bytes").alias("payload_bytes"), same(F.col("_digest"), F.col("named")).alias("payload_digest"), "record_type", "refers_to", "url")
    return own.unionByName(again)


def same(digest: Column, named: Column) -> Column:
    """The digest; an error if it is not the one that the record names."""
    return F.when(digest == named, digest).otherwise(F.raise_error(F.concat(F.lit("a payload does not have the digest "), F.coalesce(named, F.lit("?")))))
