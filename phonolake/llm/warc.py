"""WARC archives with dictionary compression.

Records are dealt to tasks by a hash of their id, and a task writes archives of a bounded size.  Each archive is one file: a skippable Zstandard frame with a
dictionary built from a sample over all records of that archive, then every record as a frame of its own, compressed with the dictionary.
Any record can thus be read alone, given the file's first frame.

Equal payloads are found by digest: the digests are counted with partial sums, so a payload that a third of all pages
share is one row a task; digests and ids alone are joined with the counts, in an equi-join whose hot partitions Spark
splits, and the verdict joins the payloads by id.

Files are written by executors, under a name of their task attempt, and renamed into place; a task that runs again
writes the same bytes (records are sorted by id within an archive) under the same final name.  Where the shared
folder is in a store that is no file path, archives are rows of a table there.  Reading goes through the list of archives.

Defined results: null html is the empty payload; a null url is written as an empty target; rows that repeat an id are
records of their own (of equal payloads the smallest id is the response, and of equal ids and payloads the first row);
a null id gets a record without an id header and is read back as null; very long payloads are one record; an empty table gives
no archive and an empty result; columns other than id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import urlparse
from urllib.request import url2pathname

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Boxed, scratch_path, stored, tidy

#: First bytes of the skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 64 << 10
#: Bytes of the sample from which an archive's dictionary is built: pieces spread evenly over all of its records.
SAMPLE_BYTES = 4 << 20
SAMPLE_PIECE = 16 << 10
ARCHIVE_BYTES = 32 << 20
MIN_REVISIT_BYTES = 100
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL namespace
_CRLF = b"\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, n_bytes: int, kind: str, refers_to: int | None, date: str) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + _CRLF * 2 + block + _CRLF * 2


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary, or one of raw content where the samples are too few to train on."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def sample_of(records: list[bytes], sample_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """Pieces at equal steps over the whole archive: long records give many, and together they have about ``sample_bytes``."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    places = ((r, at) for r in records for at in range(0, len(r), SAMPLE_PIECE))
    return [r[at : at + SAMPLE_PIECE] for r, at in islice(places, 0, None, step)]


def write_stream(f: BinaryIO, records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES) -> int:
    """Writes one archive and returns its number of records.  They are held until the dictionary is built: an archive is of bounded size."""
    held = list(records)
    dictionary = build_dictionary(sample_of(held, sample_bytes))
    if dictionary is None:
        return 0
    # the dictionary is itself compressed, as its frame allows
    raw = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
    f.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    for r in held:
        f.write(packer.compress(r))
    return len(held)


def write_archive(path: str, records: Iterator[bytes], sample_bytes: int = SAMPLE_BYTES) -> int:
    """One archive as a file, which is there whole or not at all."""
    partial = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(partial, "wb") as f:
        n = write_stream(f, records, sample_bytes)
        f.flush()
        os.fsync(f.fileno())
    os.replace(partial, path)
    return n


def read_stream(f: BinaryIO, name: str = "archive") -> Iterator[bytes]:
    """The records of one archive, in order, one in memory at a time."""
    head = f.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise ValueError(f"{name}: no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(f.read(size))
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = b""
    while True:
        chunk = rest or f.read(1 << 18)
        if not chunk:
            return
        one, out = unpacker.decompressobj(), []
        while not one.eof:
            if not chunk:
                raise ValueError(f"{name}: a record is cut off")
            out.append(one.decompress(chunk))
            chunk = b"" if one.eof else f.read(1 << 18)
        rest = one.unused_data
        yield b"".join(out)


def read_archive(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        yield from read_stream(f, path)


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    fields["payload"] = block.partition(_CRLF * 2)[2]
    return fields


def local_path(path: str) -> str | None:
    """The file path of a folder named as a path or file URI; none for other stores."""
    u = urlparse(path)
    return url2pathname(u.path) if u.scheme in ("", "file") else None


def write_pages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the archives into ``folder`` and returns their list: (path, n_records, content).

    Archives are files where the folder is a file path that all executors share (content is null), and rows of a table in
    the folder where it is in a store that only Spark writes to.

    A task writes its pages in order of id, and begins another archive after ``archive_bytes`` of records."""
    box = Boxed(pages)
    base = box.df.select(
        box.col(id_col).cast("long").alias("page_id"), F.coalesce(box.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(box.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # rows without an id have no key to be dealt by but their digest
    base = base.withColumn("_k", F.coalesce("page_id", F.lit(-(2**63)))).withColumn("_n", F.when(F.col("page_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    slim = base.where(F.col("n_bytes") >= min_revisit_bytes).select("page_id", "_k", F.col("_n").alias("_nk"), F.unhex("digest").alias("_d"))
    groups = slim.groupBy("_d").agg(F.min("page_id").alias("_first"), F.count("*").alias("_same")).where("_same > 1").drop("_same")
    # stored, so that the join is of plain exchanges, of which Spark splits a hot digest's
    groups = stored(groups, "digests", few=True)
    again = slim.join(groups, "_d").where(~F.col("page_id").eqNullSafe(F.col("_first")))
    # for each id the responses that its payloads repeat: one entry, or a few where an id has several rows
    of_id = again.groupBy("_k", F.col("_nk").alias("_n")).agg(F.map_from_entries(F.collect_set(F.struct(F.lower(F.hex("_d")), "_first"))).alias("_firsts"))
    # payloads are shuffled once, by id; that is also how they are dealt to archives
    marked = base.repartition("_k", "_n").join(of_id, ["_k", "_n"], "left")
    first = F.try_element_at("_firsts", F.col("digest"))
    marked = marked.withColumn("_first", first).withColumn("_again", F.coalesce(F.map_contains_key("_firsts", F.col("digest")), F.lit(False)))
    marked = marked.withColumn("payload", F.when(F.col("_again"), F.lit(b"")).otherwise(F.col("payload")))
    ordered = marked.select("page_id", "url", "payload", "digest", "n_bytes", "_first", "_again").sortWithinPartitions("page_id", "digest", "url")
    target = local_path(folder)
    if target:
        os.makedirs(target, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if target:
            os.makedirs(target, exist_ok=True)
        last: list[tuple] = [()]

        def records() -> Iterator[bytes]:
            for b in batches:
                for page_id, url, payload, digest, n_bytes, first, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    twin = n_bytes >= min_revisit_bytes and not again and last[0] == (page_id, digest)
                    last[0] = (page_id, digest)
                    kind = "revisit" if again or twin else "response"
                    yield record(page_id, url, b"" if twin else payload, digest, n_bytes, kind, page_id if twin else first, date)

        source, n_done = records(), 0
        head = next(source, None)
        while head is not None:
            size = 0

            def some(first: bytes = head) -> Iterator[bytes]:
                nonlocal head, size
                one: bytes | None = first
                while one is not None:
                    yield one
                    size += len(one)
                    one = next(source, None)
                    if size >= archive_bytes:
                        head = one
                        return
                head = None

            name = f"pages-{TaskContext.get().partitionId():06d}-{n_done:04d}.warc.zst"
            n_done += 1
            if target:
                path, content = f"{target}/{name}", None
                n = write_archive(path, some())
            else:
                path, held = f"{folder}/{name}", io.BytesIO()
                n = write_stream(held, some())
                content = held.getvalue()
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64()), pa.array([content], pa.binary())], names=["path", "n_records", "content"])

    archives = ordered.mapInArrow(tidy(write), "path string, n_records long, content binary")
    if target:
        return stored(archives, "archives")
    archives.write.parquet(f"{folder}/archives")
    return pages.sparkSession.read.schema(archives.schema).parquet(f"{folder}/archives")


def read_pages(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of ``archives`` (path, content): page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload].

    A response's payload is hashed again and must have the digest that its header states."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if with_payload else "")

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        n = 7 if with_payload else 6
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(n)], names=names[:n])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for raw in read_stream(io.BytesIO(content.as_py()), path) if content.is_valid else read_archive(path):
                    f = parse_record(raw)
                    digest, kind = f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"]
                    if kind == "response" and (hashlib.sha256(f["payload"]).hexdigest() != digest or len(f["payload"]) != int(f["x-payload-length"])):
                        raise ValueError(f"{path}: a payload does not have its digest")
                    number = lambda k, f=f: int(f[k]) if f.get(k, "None") != "None" else None
                    rows.append((number("x-page-id"), int(f["x-payload-length"]), digest, kind, number("x-refers-to-page-id"), f["warc-target-uri"], f["payload"]))
                    size += len(raw)
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                yield flush(rows)

    # one archive a task: the list is short and its rows are whole files
    return archives.select("path", "content").repartition(max(1, min(archives.count(), 4096)), "path").mapInArrow(tidy(read), schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    spark = pages.sparkSession
    return read_pages(spark, write_pages(pages, folder or scratch_path(spark, "warc"), **options))
