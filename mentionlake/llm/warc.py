"""WARC archives (operator 7): records compressed one by one with a dictionary of their archive.

Each task writes its pages to archives of bounded size. An archive's dictionary is trained on
records spread over it, stands in a leading skippable frame, and every record is a Zstandard
frame of its own, so a reader can start at any record. Equal payloads are stored once: the
other records are revisits that refer to the stored one. Reading goes the same way back, archive
by archive.

A task that is lost and run again, or runs twice, writes archives of its own: names tell the
attempt. The list of archives, a small table in the folder, holds those of the attempts that
counted; readers open what it names and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import ship, table
from mentionlake.session import shared_path

LEAST_SHARED = 1_000
#: Bytes of records in one archive before compression; a larger record has one to itself.
ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLES_PER_DICTIONARY = 32_768, 600_000, 8
LEVEL = 3
#: The table of archives within their folder, and the pages a task unpacks at once.
LIST = "_archives"
PORTION = 64
# The frame of a WARC file's dictionary, and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_URI = "urn:x-page:"
HEAD_END = b"\r\n\r\n"


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + HEAD_END + block + HEAD_END


def page_record(key: str, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit (``refers_to``) with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": f"<{KEY_URI}{quote(key)}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": str(size),
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        return _record("response", headers, http + payload)
    return _record("revisit", headers | {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": f"<{KEY_URI}{quote(refers_to)}>"}, http)


def make_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on pieces of records spread evenly over the archive; too few give a plain one."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[:65_536] for r in records[::step]]
    if len(samples) >= SAMPLES_PER_DICTIONARY and sum(map(len, samples)) > 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:  # samples too much alike
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], date: str) -> bytes:
    """The bytes of an archive."""
    about = _record("warcinfo", {"WARC-Record-ID": "<urn:x-archive>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
    words = make_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
    frame = words.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(frame)), frame, *(packer.compress(r) for r in [about, *records])])


def unpack(archive: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, headers, block) of every record of an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    words = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(archive[8 + size :]), read_across_frames=True)
    data, at = reader.read(), 0
    while at < len(data):
        end = data.index(HEAD_END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + len(HEAD_END)
        stop = start + int(headers["Content-Length"])
        if first != "WARC/1.1" or data[stop : stop + 4] != HEAD_END:
            raise ValueError(f"broken record at {at}")
        yield headers["WARC-Type"], headers, data[start:stop]
        at = stop + len(HEAD_END)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", uri))


def _writer(folder: str, run_id: str, date: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fs, root = _filesystem(folder)
        held, size, files = [], 0, []

        def flush() -> None:
            """Write one archive under a name no other attempt has."""
            nonlocal size
            name = f"{run_id}-{attempt:08d}-{len(files):05d}.warc.zst"
            body = pack(held, date)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(body)
            files.append((name, len(held), len(body)))
            held.clear()
            size = 0

        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                for row in batch.slice(start, PORTION).to_pylist():
                    record = page_record(row["key"], row["url"], row["payload"], row["digest"], row["size"], row["refers_to"], date)
                    if held and size + len(record) > limit:
                        flush()
                    held.append(record)
                    size += len(record)
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    return run


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit("").cast("binary"))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST_SHARED,
    date: str = "2000-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder``, a place every executor can write to;
    returns (name, records, bytes) of the archives. Archives that were there before are replaced, and
    those of attempts that did not count are deleted.

    Columns of ``pages`` but for the three named take no part, whatever their names.
    Of equal payloads of at least ``least`` bytes the one with the largest key is a response, the
    others are revisits. Rows that share the largest key are responses all; a null key is
    smaller than any other. A null html is an empty payload, a null url about:blank.
    """
    ship(pages.sparkSession)
    payload = _payload(F.col(html))
    address = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).alias("id"), address.alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    largest = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = rows.join(largest, "digest", "left")
    again = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    records = met.select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key"), "url", F.when(~again, F.col("payload")).alias("payload"), "digest",
        F.col("size").cast("long").alias("size"), F.when(again, F.col("largest").cast("string")).alias("refers_to"),
    )
    fs, root = _filesystem(folder)
    fs.create_dir(root)
    written = records.mapInArrow(_writer(folder, uuid.uuid4().hex, date, limit), "name string, records long, bytes long")
    written.write.mode("overwrite").parquet(f"{folder}/{LIST}")
    delete_strays(pages.sparkSession, folder)
    return archives(pages.sparkSession, folder)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(name, records, bytes) of the archives of a folder."""
    return spark.read.schema("name string, records long, bytes long").parquet(f"{folder}/{LIST}")


def _in_folder(folder: str, act: Callable[[pyarrow.fs.FileSystem, str, str], Iterator[pa.RecordBatch]]):
    """Worker code that calls ``act`` for every name it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from act(fs, root, name)

    return run


def delete_strays(spark: SparkSession, folder: str) -> None:
    """Delete archives that the list does not name; only names are listed, and tasks delete."""

    def drop(fs: pyarrow.fs.FileSystem, root: str, name: str) -> Iterator[pa.RecordBatch]:
        if fs.get_file_info(f"{root}/{name}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_file(f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.string())})

    there = ship(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    there.join(archives(spark, folder), "name", "left_anti").mapInArrow(_in_folder(folder, drop), "name string").count()


def read_archives(spark: SparkSession, folder: str, key_type: str = "long", with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the records of the listed archives.

    The size and digest of a response are taken from its payload and must agree with its headers.
    """
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers", *(["payload"] if with_payload else [])]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def key_of(uri: str | None) -> str | None:
        found = uri and uri.strip("<>").removeprefix(KEY_URI)
        return None if found in (None, "null") else found

    def records(fs: pyarrow.fs.FileSystem, root: str, name: str) -> Iterator[pa.RecordBatch]:
        with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
            content = source.read()
        rows = []
        for kind, headers, block in unpack(content):
            if kind == "warcinfo":
                continue
            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            size, payload = int(headers["X-Payload-Length"]), None
            if kind == "response":
                payload = block[block.index(HEAD_END) + len(HEAD_END) :]
                if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
            rows.append((key_of(headers["WARC-Record-ID"]), size, digest, kind, key_of(headers.get("WARC-Refers-To")), payload if with_payload else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    schema = "key string, payload_bytes long, payload_digest string, record_type string, refers string" + (", payload binary" if with_payload else "")
    # A list is small and its archives are large: its names are dealt to the tasks of a shuffle.
    spread = archives(ship(spark), folder).select("name").repartition(spark.sparkContext.defaultParallelism * 4, "name")
    out = spread.mapInArrow(_in_folder(folder, records), schema)
    return out.select(
        F.col("key").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(key_type).alias("refers_to"), *names[5:]
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back from them."""
    folder = shared_path(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, folder)
    return read_archives(spark, folder, pages.schema["page_id"].dataType.simpleString())


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS largest FROM p WHERE strlen(h) >= {LEAST_SHARED} GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h
"""
