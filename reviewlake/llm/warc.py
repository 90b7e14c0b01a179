"""WARC records as a table of chunks.

A record is a run of rows (row, chunk): chunk 0 has the WARC and HTTP headers, the following ones have at most
`chunk_bytes` of payload each with the SHA-1 of the payload up to there, the last one the closing line ends. The
chunks of a record joined in order are the record's bytes in a WARC file. Writing makes one chunk at a time, and
reading hashes chunks as they come, so a record is never built whole; a payload that recurs is stored once, and the
other pages point to the record of the smallest page_id by a revisit record.

Defined results: null html is an empty payload; a page without page_id is always a response; rows that repeat the
page_id of the response are responses too; line ends in a url become spaces; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import DataFrame, functions as F

from reviewlake.llm.batches import map_rows
from reviewlake.session import materialize

CHUNK_BYTES = 256 << 10
DATE = "2026-01-01T00:00:00Z"
CHUNKS = "row long, page_id long, chunk int, data binary, sha1_so_far string"


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record_id(page_id: int | None, digest: str, row: int) -> str:
    """By page and payload; by row too where a page has no id. Rows that repeat both page_id and payload are one record twice."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}' if page_id is not None else f'{row}:{digest}')}>"


def slices(payload: str, chunk_bytes: int):
    """UTF-8 parts of at most chunk_bytes, encoding a bounded part of the text at a time."""
    step = max(1, chunk_bytes // 4)
    for at in range(0, len(payload), step):
        yield payload[at : at + step].encode()


def payload_digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes and payload_digest of every page."""

    def make():
        def one(page_id, html):
            sha1, n = hashlib.sha1(), 0
            for part in slices(html or "", CHUNK_BYTES):
                sha1.update(part)
                n += len(part)
            yield page_id, n, base32(sha1)

        return one

    return map_rows(pages.select(F.col("page_id").cast("long"), "html"), make, "page_id long, payload_bytes long, payload_digest string")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, firsts: payload digest -> the page that holds it), for pages whose payload another page holds."""
    digests = materialize(payload_digests(pages).where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)), "warc-digests")
    firsts = digests.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id")
    again = digests.join(firsts, "payload_digest").where("page_id > first_id")
    entry = F.struct("payload_digest", "first_id")
    return materialize(again.groupBy("page_id").agg(F.map_from_entries(F.collect_set(entry)).alias("firsts")), "warc-revisits")


def write_records(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> DataFrame:
    """Chunk rows of a record for each page. Pages are not shuffled unless the table of revisits is too large to broadcast."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.join(revisits(pages, min_bytes), "page_id", "left").select("row", "page_id", "url", "html", "firsts")

    def make():
        def one(row, page_id, url, html, firsts):
            sha1, n = hashlib.sha1(), 0
            for part in slices(html or "", chunk_bytes):
                sha1.update(part)
                n += len(part)
            digest = base32(sha1)
            first = dict(firsts or ()).get(digest)
            http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {n}\r\n\r\n"
            block = len(http) + (n if first is None else 0)
            head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, row)}", f"WARC-Date: {date}"]
            if url:
                head.append("WARC-Target-URI: " + " ".join(url.split("\n")).replace("\r", " "))
            head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
            if first is not None:
                head += [f"WARC-Refers-To: {record_id(first, digest, row)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            yield row, page_id, 0, ("\r\n".join(head) + "\r\n\r\n" + http).encode(), None
            k, sha1 = 0, hashlib.sha1()
            if first is None:
                for part in slices(html or "", chunk_bytes):
                    sha1.update(part)
                    k += 1
                    yield row, page_id, k, part, base32(sha1)
            yield row, page_id, k + 1, b"\r\n\r\n", None

        return one

    return map_rows(rows, make, CHUNKS)


def read_records(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, record_id, type, refers_to_id, payload_bytes and payload_digest as read.

    The chunks of a record meet sorted in one task and pass one by one. A payload whose length, digest or running
    digests differ from what the record says raises ValueError.
    """
    together = chunks.select("row", "page_id", "chunk", "data", "sha1_so_far").repartition("row").sortWithinPartitions("row", "chunk")

    def make():
        now: dict = {}

        def one(row, page_id, chunk, data, sha1_so_far):
            if chunk == 0:
                lines, http = bytes(data).split(b"\r\n\r\n", 1)
                fields = dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])
                now.update(row=row, fields=fields, left=int(fields["Content-Length"]) - len(http), n=0, sha1=hashlib.sha1())
            elif now.get("row") != row:
                raise ValueError(f"record {row} has no header")
            elif now["left"] > 0:
                now["sha1"].update(data)
                now["left"] -= len(data)
                now["n"] += len(data)
                if base32(now["sha1"]) != sha1_so_far:
                    raise ValueError(f"record {row}, chunk {chunk}: digests differ")
            else:
                fields, said = now["fields"], now["fields"]["WARC-Payload-Digest"].removeprefix("sha1:")
                whole = fields["WARC-Type"] == "response"
                if now["left"] or bytes(data) != b"\r\n\r\n" or whole and base32(now["sha1"]) != said:
                    raise ValueError(f"record {row} is damaged")
                yield page_id, fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), now["n"] if whole else None, said

        return one

    schema = "page_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string"
    return map_rows(together, make, schema)


def archive_report(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the archives, read them back, and give each page's record; a revisit's payload is that of the record it points to."""
    records = materialize(read_records(materialize(write_records(pages, min_bytes, chunk_bytes), "warc-archives")), "warc-records")
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest"))
    held = held.join(records.where("record_type = 'revisit'").select("refers_to_id").distinct(), "refers_to_id", "left_semi").distinct()
    return records.join(held, ["refers_to_id", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
