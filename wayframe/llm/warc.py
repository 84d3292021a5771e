"""Deterministic sharded WARC archives, written by Spark and read back.

Records are sorted by id in ranges, rolled into files by compressed size, given headers and digests, and written
below a temporary name. A manifest lists the files; then the folder gets its final name.

Each record is one gzip member (several if it has 16 MB or more), so that a member always ends with a zero byte: the
top byte of its length. Spark's text sink writes a member without that byte as a row, and the zero byte as row end.
So the archive goes through Spark's own commit, to any store that Spark reaches, and retried or lost tasks leave
nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Steps, id_ranges

#: A file is closed once its compressed records reach this size.
ROLL_BYTES = 16 << 20
#: Rows in a range of ids; ranges are the units of sorting and writing.
RANGE_ROWS = 5_000
MEMBER_BYTES = (1 << 24) - 1
#: Numbers of files that a range of ids can have.
FILES = 1_000_000
#: Compressed bytes that the reader takes at a time.
PIECE = 1 << 14
WRITTEN_AT = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("5f0c2e0a-7a51-4d5c-9b39-0d3f7f1f6a10")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{digest}/{nth}')}>"


def clean_header(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: int) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page, digest, nth), "WARC-Date": WRITTEN_AT,
        "WARC-Target-URI": None if url is None else clean_header(url), "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": record_id(refers_to, digest, 0) if revisit else None,
        "X-Page": "" if page is None else str(page), "X-Refers-To-Page": "" if refers_to is None else str(refers_to),
        "X-Payload-Length": str(len(payload)), "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> list[bytes]:
    """gzip members of less than 16 MB of data each, without time stamps."""
    out = []
    for lo in range(0, len(data), MEMBER_BYTES):
        piece = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(piece.compress(data[lo : lo + MEMBER_BYTES]) + piece.flush())
    return out


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; broken digests and lengths raise.

    Every byte is looked at once, however long a record is.
    """
    view, at, plain, begin = memoryview(data), 0, bytearray(), 0
    unzip = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, unzip
        if at >= len(view):
            return False
        piece = view[at : at + PIECE]
        plain.extend(unzip.decompress(piece))
        at += len(piece) - len(unzip.unused_data)
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        return True

    while True:
        looked = begin
        while (end := plain.find(b"\r\n\r\n", looked)) < 0:
            looked = max(begin, len(plain) - 3)
            if not more():
                if len(plain) > begin:
                    raise ValueError("the archive ends within a record")
                return
        head = dict(line.split(": ", 1) for line in plain[begin:end].decode().split("\r\n")[1:])
        size = end + 4 + int(head["Content-Length"]) + 4
        while len(plain) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        block = bytes(plain[end + 4 : size - 4])
        if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"the digest of {head['WARC-Record-ID']} does not fit")
        yield head, block
        begin = size
        if begin > PIECE:
            del plain[:begin]
            begin = 0


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["file", "place", "member"])


def _archive(roll_bytes: int):
    """Rows come sorted by (range, id, digest), a link to the page that stays before the pages; numbers files within a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, place, last, nth, kept = None, 0, 0, 0, None, 0, None
        for batch in batches:
            out = []
            for at, page, digest, link, stays, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if link:
                    kept = stays
                    continue
                if at != part:
                    part, number, size, place = at, 0, 0, 0
                nth = nth + 1 if (page, digest) == last else 0
                last = (page, digest)
                revisit = page != kept or nth > 0
                if size >= roll_bytes:
                    number, size, place = number + 1, 0, 0
                for member in members(record(page, url, html, kept if revisit else None, revisit, nth)):
                    out.append((part * FILES + number, place, member[:-1]))
                    size, place = size + len(member), place + 1
                if len(out) >= 500:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for head, block in read_records(data.as_buffer().to_pybytes()):
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if len(payload) != size or base32_sha1(payload) != digest:
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not fit its headers")
                number = lambda x: int(x) if x else None
                rows.append((number(head["X-Page"]), size, digest, head["WARC-Type"], number(head["X-Refers-To-Page"])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, range_rows: int = RANGE_ROWS) -> list[str]:
    """Write one record per row of pages (page_id, url, html) and return the paths of the archives.

    Null html is an empty payload, a null url leaves its header out, a null page_id sorts first and stays null. Of
    equal payloads the largest page_id is the response and the others revisit it; of repeated rows of that page_id the
    first is. Same rows give the same files, byte for byte. ``folder`` must not exist. Other columns are not read. An
    empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    marked = rows.withColumn("digest", F.sha2("html", 256))
    part = id_ranges(rows, "page", range_rows)
    small = marked.select("page", "digest")
    groups = small.groupBy("digest").agg(F.max("page").alias("stays"))
    links = small.distinct().join(groups, "digest").select(
        part.alias("part"), "page", "digest", F.lit(True).alias("link"), "stays", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    # the links meet the pages in the sorted stream, so that the payloads move once
    whole = links.union(marked.select(part.alias("part"), "page", "digest", F.lit(False), F.lit(None).cast("long"), "url", "html"))
    packed = (
        whole.repartition("part").sortWithinPartitions("part", "page", "digest", F.desc("link"), "url")
        .mapInArrow(_archive(roll_bytes), "file long, place long, member binary")
        .sortWithinPartitions("file", "place")
    )
    temporary = f"{folder}.writing-{uuid.uuid4().hex}"
    packed = packed.select("file", F.col("member").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").partitionBy("file").text(temporary)
    return _commit(spark, temporary, folder)


def _commit(spark: SparkSession, temporary: str, folder: str) -> list[str]:
    """Give the parts their names, write the manifest, then rename the folder: readers see all or nothing."""
    Path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    store = Path(temporary).getFileSystem(conf)
    listed = []
    for entry in sorted((e.getPath() for e in store.listStatus(Path(temporary)) if e.isDirectory()), key=lambda p: int(p.getName().removeprefix("file="))):
        parts = [e for e in store.listStatus(entry) if e.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{entry.getName()} came from {len(parts)} tasks")
        number = int(entry.getName().removeprefix("file="))
        name = f"records-{number // FILES:06d}-{number % FILES:06d}.warc.gz"
        listed.append({"name": name, "bytes": parts[0].getLen()})
        if not store.rename(parts[0].getPath(), Path(f"{temporary}/{name}")):
            raise RuntimeError(f"{name} could not be renamed")
        store.delete(entry, True)
    lines = spark.createDataFrame([(json.dumps(x),) for x in listed], "value string").coalesce(1)
    lines.write.text(f"{temporary}/manifest")
    if store.exists(Path(folder)) or not store.rename(Path(temporary), Path(folder)):
        raise RuntimeError(f"{folder} is there already or could not be made")
    return [f"{folder}/{x['name']}" for x in listed]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record that the manifest's files hold."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    sizes = [F.count("*").alias("files"), F.sum("bytes").alias("bytes")]
    listed = spark.read.schema("name string, bytes long").json(f"{folder}/manifest").agg(*sizes).first()
    if not listed["files"]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    if files.select(F.col("length").alias("bytes")).agg(*sizes).first() != listed:
        raise RuntimeError(f"{folder} does not hold what its manifest lists")
    return files.select("content").mapInArrow(_reader, schema)


def archived_pages(pages: DataFrame, roll_bytes: int = ROLL_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the pages to archives in a new shared folder and read them back."""
    spark = pages.sparkSession
    steps = Steps(spark, "warc")
    folder = f"{steps.folder}/archives"
    write_archives(pages, folder, roll_bytes, range_rows)
    return read_archives(spark, folder)
