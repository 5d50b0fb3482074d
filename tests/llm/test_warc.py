from __future__ import annotations

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from clausemill.llm.warc import SEPARATOR, cut, parse, read_chunks, records, write_warc

PAGES = "page_id long, url string, html string, record_id string, Bytes int, sha1 string"


def brute(pages, min_bytes=1000):
    raw = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, p in raw:
        ids = [j for j, q in raw if q == p and j is not None]
        seen = max(ids) if ids and len(p) >= min_bytes else None
        seen = None if seen == i else seen
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if seen is not None else "response", seen, True))
    return sorted(out, key=repr)


def table(spark, pages):
    return spark.createDataFrame([(*p, "x", 7, "y") for p in pages], PAGES)


def told(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=repr)


def odd_pages():
    sep, rng = SEPARATOR.decode(), random.Random(3)
    long = "".join(rng.choice("abc é€😀\r\n") for _ in range(30_000))
    hard = [sep, sep * 50, "\r\n\r\nWARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" + sep, "\r\n" * 900 + sep + "x" * 2000, "\r\n\r\n", "\n"]
    pages = [(i, f"http://a/{i}", h) for i, h in enumerate([*hard, long, long + "x", "", None, "é" * 499, "é" * 500, "é" * 500])]
    pages += [(100 + i, None, long) for i in range(9)] + [(100, "http://b/ c\r\nX: y", long), (108, "u", long), (None, "u", long), (None, None, None)]
    return pages + [(None, "u", "n" * 1200), (None, "v", "n" * 1200), (300, "u", "short"), (301, "u", "short"), (301, "u", "short")]


def test_cut_never_opens_a_record():
    rng = random.Random(5)
    for _ in range(2000):
        payload = "".join(rng.choice(["\r\n", "\r\n\r\n", "WARC/1.1", "W", SEPARATOR.decode(), "x" * 9]) for _ in range(rng.randrange(14))).encode()
        head = b"HTTP/1.1 200 OK\r\n\r\n"
        got = list(cut(head, memoryview(payload), rng.choice([1, 5, 13, 14, 15, 40, 1000])))
        assert b"".join(b for b, _, _ in got) == head + payload
        assert all((b + SEPARATOR).find(SEPARATOR) == len(b) for b, _, _ in got)
        assert [a for _, a, _ in got][1:] == [z for _, _, z in got][:-1] and got[-1][2] == len(payload)


@pytest.mark.parametrize("chunk_bytes", [16, 1000, 1 << 18])
def test_equal_to_brute_force_however_the_archives_are_split(spark, chunk_bytes):
    pages = odd_pages()
    frame = table(spark, pages).repartition(3)
    assert told(records(read_chunks(spark, write_warc(frame, chunk_bytes=chunk_bytes, max_records=40)))) == brute(pages)
    path = write_warc(frame, chunk_bytes=chunk_bytes, compression="none")
    for split in ("128m", "9k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if split == "9k" else "4m")
        try:
            if chunk_bytes > 16 or split != "9k":
                assert told(records(read_chunks(spark, path))) == brute(pages)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_come_back_in_bounded_chunks(spark):
    pages = odd_pages()
    chunks = read_chunks(spark, write_warc(table(spark, pages), chunk_bytes=5000))
    assert chunks.agg(F.max(F.octet_length("payload"))).first()[0] <= 5000
    whole = {}
    for r in sorted(chunks.where("record_type <> 'revisit'").collect(), key=lambda r: (r.record_id, r.chunk)):
        whole[r.record_id] = whole.get(r.record_id, b"") + bytes(r.payload)
    stay = [(h or "").encode() for (i, _, h), (_, kind) in zip(pages, [(i, "response" if seen(pages, i, h) is None else "") for i, _, h in pages], strict=True) if kind]
    assert sorted(whole.values()) == sorted(stay)


def seen(pages, i, html):
    ids = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
    return max(ids) if ids and len((html or "").encode()) >= 1000 and max(ids) != i else None


def test_an_archive_follows_the_format(spark):
    """Read front to back by Content-Length alone, as any reader of the format does."""
    path = write_warc(table(spark, odd_pages()).coalesce(1), chunk_bytes=3000, compression="none")
    names, kinds = set(), {}
    for file in glob.glob(os.path.join(path, "part-*")):
        raw, at = open(file, "rb").read(), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            body = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
            at = end + 4 + len(body)
            assert lines[0] == "WARC/1.1" and raw[at : at + 4] == b"\r\n\r\n" and fields["WARC-Record-ID"] not in names
            at += 4
            names.add(fields["WARC-Record-ID"])
            kinds[fields["WARC-Type"]] = kinds.get(fields["WARC-Type"], 0) + 1
    assert kinds["warcinfo"] == 1 and kinds["continuation"] > 50 and kinds["revisit"] == sum(r[3] == "revisit" for r in brute(odd_pages()))


def test_lost_and_cut_chunks_are_seen(spark):
    chunks = read_chunks(spark, write_warc(table(spark, [(1, "u", "ab" * 4000), (2, "u", "c" * 10)]), chunk_bytes=1000))
    for lost in (1, 3, 8):
        got = {r.intact for r in records(chunks.where(F.col("chunk") != lost)).where("payload_bytes > 10").collect()}
        assert got == {False}
    assert [r.intact for r in records(chunks).collect()] == [True, True]
    with pytest.raises(ValueError, match="ends after"):
        parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nabc")


def test_empty_tables_and_single_rows(spark):
    frame = table(spark, [(1, "u", "x")])
    assert records(read_chunks(spark, write_warc(frame.limit(0)))).isEmpty()
    for page in [(None, None, None), (1, "u", ""), (2, None, "z" * 5000)]:
        assert told(records(read_chunks(spark, write_warc(table(spark, [page]), chunk_bytes=2000)))) == brute([page])
