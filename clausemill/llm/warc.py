"""WARC archives as tables of chunks: large payloads are rows of a record and a chunk number, never one piece of memory.

A payload is cut into chunks of bounded size, and each chunk is a WARC record
of its own: the first a ``response``, the others its ``continuation`` segments.
Spark's text writer writes such records one after the other and its text reader
finds them again by the line that opens a record. A chunk never holds that
line: it is cut in the middle of it. Archives are compressed as a whole unless
they shall be read in splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import work_dir

#: A chunk has so many bytes of payload at most.
CHUNK_BYTES = 1 << 18
#: Payloads of fewer bytes are stored again and again rather than referred to.
MIN_BYTES = 1000
#: An archive holds so many chunks at most.
MAX_RECORDS = 1 << 17
#: A frame between Python and Spark holds about so many bytes.
_FRAME_BYTES = 1 << 22
_VERSION = b"WARC/1.1\r\n"
#: Two line ends close a record, the version opens the next.
SEPARATOR = b"\r\n\r\n" + _VERSION
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = (
    "record_id string, chunk int, last boolean, record_type string, page_id long, url string, refers_to long, "
    "stated_bytes long, stated_digest string, payload binary"
)


def _sha1(hex_digest: str) -> str:
    """A digest as WARC headers show it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _uri(url: str | None) -> str:
    """An address in one line: blanks and control characters as %xx."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url or "")


def cut(head: bytes, payload: memoryview, size: int) -> Iterator[tuple[bytes, int, int]]:
    """``(block, start, stop)``: chunks of ``payload``, the first behind ``head``; no block, nor its end, opens a record."""
    at, first = 0, True
    while first or at < len(payload):
        stop = min(at + size, len(payload))
        block = head * first + bytes(payload[at:stop])
        found = (block + SEPARATOR).find(SEPARATOR)
        if found < len(block):
            kept = found + len(SEPARATOR) // 2
            stop -= len(block) - kept
            block = block[:kept]
        yield block, at, stop
        at, first = stop, False


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the last of the two line ends that close it; the writer adds that one."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return _VERSION + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _response(name: str, row, payload: bytes, size: int, date: str) -> Iterator[bytes]:
    """The records of one page: its chunks in order, each with its own digest, the first with that of the whole."""
    whole, view = hashlib.sha1(), memoryview(payload)
    for at in range(0, len(view), size):
        whole.update(view[at : at + size])
    head, number = _http(len(view)), 0
    for block, _, stop in cut(head, view, size):
        number += 1
        own, last = hashlib.sha1(block).hexdigest(), stop >= len(view)
        if number == 1:
            fields = [
                ("WARC-Type", "response"),
                ("WARC-Record-ID", f"<{name}>"),
                ("WARC-Date", date),
                ("WARC-Target-URI", _uri(row.url)),
                ("WARC-Payload-Digest", _sha1(whole.hexdigest())),
                ("X-Page-ID", row.page),
                ("Content-Type", "application/http; msgtype=response"),
                ("WARC-Segment-Number", None if last else 1),
            ]
        else:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<{name}.{number}>"),
                ("WARC-Date", date),
                ("WARC-Target-URI", _uri(row.url)),
                ("WARC-Segment-Origin-ID", f"<{name}>"),
                ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", len(head) + len(view) if last else None),
            ]
        yield _record([*fields, ("WARC-Block-Digest", _sha1(own))], block)


def _revisit(name: str, row, date: str) -> bytes:
    fields = [
        ("WARC-Type", "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row.url)),
        ("WARC-Payload-Digest", _sha1(row.sha1)),
        ("WARC-Profile", _PROFILE),
        ("WARC-Refers-To-Target-URI", _uri(row.seen_url)),
        ("X-Page-ID", row.page),
        ("X-Refers-To-Page-ID", row.seen),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, _http(int(row.bytes)))


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The pages that repeat another's payload, by ``_id``, ``_none`` and ``sha1``, with the ``seen`` page they refer to.

    Equal payloads are told by their length and two digests. A group of copies
    is one row after the partial aggregates; texts are not moved.
    """
    same = ["bytes", "sha1", "sha2"]
    told = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha1("html").alias("sha1"),
        F.sha2("html", 256).alias("sha2"),
    ).where(F.col("bytes") >= min_bytes)
    last = F.max(F.struct("page_id", "url")).alias("last")
    groups = told.groupBy(*same).agg(last, F.count(F.lit(1)).alias("n")).where("n > 1")
    members = told.select("page_id", *same).distinct()
    found = members.join(groups, same).where("last.page_id is not null and not page_id <=> last.page_id")
    return found.select(*_key(), "sha1", F.col("last.page_id").alias("seen"), F.col("last.url").alias("seen_url"))


def _key() -> list:
    return [F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none")]


def write_warc(
    pages: DataFrame,
    path: str | None = None,
    *,
    min_bytes: int = MIN_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    max_records: int = MAX_RECORDS,
    compression: str = "gzip",
    date: str = "2024-01-01T00:00:00Z",
) -> str:
    """Writes a record per row of ``pages`` (``page_id, url, html``) below ``path`` (by default a fresh shared folder), and returns it.

    A payload is the html in UTF-8; a null one is empty. Of the rows of equal
    payloads of ``min_bytes`` or more, that with the largest id is a response
    and the others are revisits of it, without payload; rows that share that
    largest id are responses each, as are all where no row has an id. A null
    id or address is left out. Other columns are not read. Every task writes an
    archive, whose first record is a ``warcinfo``; Spark's writer commits the
    files, so a task that is run again leaves nothing twice. An empty table
    gives an empty folder. A gzip archive is read by one task, from front to
    back, and holds at most ``max_records`` chunks; with ``compression="none"``
    archives are read in splits. ``date`` stands in all records, as pages have none.
    """
    path = path or work_dir(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = plain.select(*_key(), "page_id", "url", "html", F.sha1("html").alias("sha1"))
    told = keyed.join(revisits(plain, min_bytes), ["_id", "_none", "sha1"], "left")
    rows = told.select(
        F.col("page_id").cast("string").alias("page"),
        "url",
        F.col("seen").cast("string").alias("seen"),
        "seen_url",
        "sha1",
        F.octet_length("html").alias("bytes"),
        F.when(F.col("seen").isNull(), F.col("html").cast("binary")).alias("payload"),
    )

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, size, count = uuid.UUID(int=TaskContext.get().taskAttemptId() | uuid.uuid4().int >> 64 << 64), [], 0, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if not count:
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{task}>"), ("WARC-Date", date)]
                    held.append(_record([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                count += 1
                name = f"urn:uuid:{uuid.uuid5(task, str(count))}"
                records = [_revisit(name, row, date)] if row.payload is None else _response(name, row, row.payload, chunk_bytes, date)
                for record in records:
                    held.append(record)
                    size += len(record)
                    if size >= _FRAME_BYTES:
                        yield pd.DataFrame({"value": held})
                        held, size = [], 0
        if held:
            yield pd.DataFrame({"value": held})

    records = rows.mapInPandas(archive, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", max_records).text(path)
    return path


def parse(row: bytes) -> tuple | None:
    """One chunk from a record, with or without its version line; None for records that hold no page."""
    row = row.removeprefix(_VERSION)
    head, _, rest = row.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    kind, length = fields["WARC-Type"], int(fields["Content-Length"])
    if kind == "warcinfo":
        return None
    if len(rest) < length:
        raise ValueError(f"record {fields['WARC-Record-ID']} ends after {len(rest)} of {length} bytes")
    block, total, digest = rest[:length], None, None
    if kind == "continuation":
        name, number = fields["WARC-Segment-Origin-ID"], int(fields["WARC-Segment-Number"])
        last = "WARC-Segment-Total-Length" in fields
    else:
        name, number, last = fields["WARC-Record-ID"], 1, "WARC-Segment-Number" not in fields
        http, _, block = block.partition(b"\r\n\r\n")
        total = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page, seen = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return name[1:-1], number, last, kind, page and int(page), fields["WARC-Target-URI"], seen and int(seen), total, digest, block


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' chunks: ``record_id, chunk`` (from 1), whether it is the ``last``, its ``payload``, and what the headers say.

    Archives are read like any text, a record at a time, in splits unless compressed. A record that
    ends too early raises an error.
    """
    lines = spark.read.schema("value string").option("lineSep", SEPARATOR.decode()).text(path)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _CHUNK.split(", ")]
        for frame in frames:
            rows = [r for r in map(parse, frame["value"]) if r is not None]
            out = pd.DataFrame(rows, columns=columns)
            for name in ("page_id", "refers_to", "stated_bytes"):
                out[name] = out[name].astype("Int64")
            yield out

    return lines.select(F.col("value").cast("binary").alias("value")).mapInPandas(split, _CHUNK)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of ``read_chunks``: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact``.

    Digests are computed anew from the chunks. Records of one chunk are digested
    where they are; the chunks of larger ones come in order through a task that
    carries the digest on from chunk to chunk, so no payload is ever put
    together. A revisit has the size and digest that it states. ``intact`` is
    false if chunks are missing or the digest is not the stated one.
    """
    kept = ["record_id", "page_id", "url", "record_type", "refers_to"]
    only = (F.col("chunk") == 1) & F.col("last")
    told = F.col("record_type") == "revisit"
    small = chunks.where(only).select(
        *kept,
        F.when(told, F.col("stated_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(told, F.col("stated_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "stated_bytes",
        "stated_digest",
        F.lit(True).alias("whole"),
    )
    columns, told_columns = [c.split()[0] for c in _CHUNK.split(", ")], small.columns

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, head, digest, size, number, last = None, None, None, 0, 0, False

        def row():
            whole = bool(last) and head.chunk == 1
            return [*(getattr(head, c) for c in kept), size, digest.hexdigest(), head.stated_bytes, head.stated_digest, whole]

        def told_rows(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=told_columns)
            for name in ("page_id", "refers_to", "stated_bytes"):
                out[name] = out[name].map(lambda v: None if pd.isna(v) else int(v)).astype("Int64")
            return out

        for frame in frames:
            done = []
            for chunk in frame[columns].itertuples(index=False):
                if chunk.record_id != now:
                    if now is not None:
                        done.append(row())
                    now, digest, size, number = chunk.record_id, hashlib.sha1(), 0, 0
                    head = chunk._replace(payload=None)
                number += 1
                digest.update(chunk.payload)
                size, last = size + len(chunk.payload), chunk.last and chunk.chunk == number
            if done:
                yield told_rows(done)
        if now is not None:
            yield told_rows([row()])

    ordered = chunks.where(~only).repartition("record_id").sortWithinPartitions("record_id", "chunk")
    large = ordered.mapInPandas(carry, small.schema)
    intact = F.col("whole") & (F.col("payload_bytes") == F.col("stated_bytes")) & (F.col("payload_digest") == F.col("stated_digest"))
    return small.unionByName(large).select(*kept, "payload_bytes", "payload_digest", F.coalesce(intact, F.lit(False)).alias("intact"))
