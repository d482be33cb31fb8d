"""WARC archives of Zstandard frames that share a dictionary.

The dictionary is trained on archived records. Each archive starts with a skippable
frame that holds it, and every record is a frame of its own, so a reader can start at
any record. Spark's own text writer commits the files: a row is a frame, and the
"line end" is an empty skippable frame, which every reader of Zstandard passes over.
The writer begins a new file after a fixed number of rows; an archive that has its
bytes before that is filled up with empty rows, so that archives are of bounded size
and each has its dictionary, however many pages a task has.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicewatch.llm.arrow_rows import slices, texts_of
from sluicewatch.llm.scratch import counted, stored

#: Skippable frames: magic number, then size. The first is that of dictionaries in WARC files.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
BETWEEN = "P*M\x18\0\0\0\0"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"

#: Dictionary: its size, about how many different payloads it is trained on, and bytes of
#: each, in so many pieces spread over it.
DICTIONARY_BYTES = 110 << 10
TRAINING_RECORDS = 1000
TRAINING_BYTES, TRAINING_PIECES = 16 << 10, 4
#: Frames and bytes of an archive: it ends with the record that reaches either.
ARCHIVE_FRAMES, ARCHIVE_BYTES = 10_000, 64 << 20
#: Bytes of a repeated payload's row, for the choice to broadcast them.
FIRST_BYTES = 256
LEVEL = 6
LEAST_REVISITED = 100
DATE = "2024-01-01T00:00:00Z"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id, url, payload: bytes, digest: str, first, first_url) -> bytes:
    """A response record, or a revisit record of page ``first`` if that is given."""
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    block = _HTTP % len(payload)
    if first is None:
        block += payload
    else:
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(first)), ("WARC-Refers-To-Page-ID", str(first))]
        if first_url is not None:
            head.append(("WARC-Refers-To-Target-URI", quote(first_url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"software: sluicewatch\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None)}\r\nWARC-Date: {DATE}\r\n"
    head += f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n"
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; refuses a broken one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(headers["content-length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    return headers, rest[:size]


def prepared(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with payload, digest, and of revisits the page they refer to.

    Payloads stay where they are read: only narrow (digest, least page) rows of those that
    occur twice or more are joined to them, and broadcast up to a counted size. Pages of a
    null id are never the one referred to, and null pages are empty payloads. Of a page id
    that occurs twice with one payload, both rows are responses. Payloads of any length are
    one record; an empty table makes no records. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    long_ = rows.where((F.octet_length("payload") >= LEAST_REVISITED) & F.col("page_id").isNotNull())
    firsts = (
        long_.groupBy("digest")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    )
    # Rows of no id refer to the first one too, though they are not counted.
    met_twice = (F.col("n") > 1) | F.col("by_others")
    nameless = rows.where(F.col("page_id").isNull()).select("digest").distinct()
    firsts = firsts.join(nameless.withColumn("by_others", F.lit(True)), "digest", "left")
    firsts = stored(
        firsts.where(met_twice).select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")),
        "firsts",
    )
    joined = rows.join(counted(firsts, FIRST_BYTES), "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(~own, F.col("first")).alias("first"),
        F.when(~own, F.col("first_url")).alias("first_url"),
    )


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary of records drawn by hash, trained in one task.

    Of about ``TRAINING_RECORDS`` different payloads, copies counting once, pieces of
    ``TRAINING_BYTES`` in all at most: the whole payload, or parts of it from beginning to
    end. Too few or too uniform ones become a dictionary of plain content.
    """
    total = pages.agg(F.approx_count_distinct(html)).first()[0]
    share = min(1.0, TRAINING_RECORDS / total) if total else 1.0
    drawn = pages.where(F.col(html).isNotNull()).where(
        F.pmod(F.xxhash64(html), F.lit(1 << 30)) < int(share * (1 << 30))
    )
    payload, piece = F.col("payload"), TRAINING_BYTES // TRAINING_PIECES
    apart = (F.octet_length(payload) - piece) / (TRAINING_PIECES - 1)
    pieces = (F.substring(payload, F.floor(apart * k).cast("int") + 1, F.lit(piece)) for k in range(TRAINING_PIECES))
    cut = F.when(F.octet_length(payload) <= TRAINING_BYTES, payload).otherwise(F.concat(*pieces))
    # Cut first: what is shuffled to drop copies is bounded by row.
    sample = drawn.select(F.col(html).cast("binary").alias("payload")).select(cut.alias("payload")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [
            record(0, "https://www.example.com/", p, hashlib.sha256(p).hexdigest(), None, None)
            for batch in batches
            for p in texts_of(batch.column(0))
        ]
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
        except zstandard.ZstdError:
            data = (b"".join(records) + _info())[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([data])], names=["dictionary"])

    row = sample.repartition(1).sortWithinPartitions("payload").mapInArrow(run, "dictionary binary").first()
    return row.dictionary if row else _info()


def write_archives(prepared_pages: DataFrame, dictionary: bytes, folder: str) -> None:
    """Archives of bounded size, a record per page, to any file system Spark writes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        head = [DICTIONARY_MAGIC + struct.pack("<I", len(dictionary)) + dictionary, packer.compress(_info())]
        frames, rows, size = [], 0, 0  # rows and bytes of the archive at hand
        for batch in batches:
            for part in slices(batch, 2):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if not rows:
                        frames += head
                        rows, size = len(head), len(head[0])
                    frames.append(packer.compress(record(*row)))
                    rows, size = rows + 1, size + len(frames[-1])
                    if size >= ARCHIVE_BYTES:
                        frames += [b""] * (ARCHIVE_FRAMES - rows)
                        rows = ARCHIVE_FRAMES
                    if rows == ARCHIVE_FRAMES:
                        rows = 0
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["value"])
                frames = []

    frames = prepared_pages.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    frames.write.option("lineSep", BETWEEN).option("maxRecordsPerFile", ARCHIVE_FRAMES).text(folder)


def frames_of(archive: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive, one by one."""
    size = struct.unpack_from("<I", archive, 4)[0]
    if archive[:4] != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    at, view = 8 + size, memoryview(archive)
    while at < len(archive):
        if archive[at : at + 4] != FRAME_MAGIC:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        reader = unpacker.decompressobj()
        parts, step = [], 1 << 16
        start = at
        while not reader.eof:
            if start >= len(archive):
                raise ValueError("an archive ends within a record")
            parts.append(reader.decompress(view[start : start + step]))
            start += step
        at = min(start, len(archive)) - len(reader.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, ``payload``) of every record; a payload that doesn't match its digest
    stops the read. A revisit has no payload of its own. An archive is read as one value,
    and written within ``ARCHIVE_BYTES`` and one record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in frames_of(content.as_py()):
                    headers, block = parse_record(data)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
                    size = len(payload) if payload is not None else int(headers["warc-payload-length"])
                    page, first = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
                    rows.append((page and int(page), headers.get("warc-target-uri"), size, digest, headers["warc-type"], first and int(first), payload))
                    held += len(data)
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.select("content").mapInArrow(
        run,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary",
    )
