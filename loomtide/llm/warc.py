"""WARC archives written and read by Spark, and captures assembled from their records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.llm.ranks import column, stored

CRLF = "\r\n"
#: What ends a record in an archive; the text writer puts it behind each row.
RECORD_END = CRLF + CRLF
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 12_000
CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, date string, page_id long, "
    "payload_bytes long, payload_digest string, digest_ok boolean, block string, payload binary"
)


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line breaks in values become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def _record(kind: Column, record_id: Column, url: Column, date: str, fields: list[Column], mime: str, block: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url), *fields, _header("Content-Type", F.lit(mime)),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write compressed WARC 1.1 files: per page a request, a response or revisit, and a metadata record.

    The payload is the page in UTF-8, a null page an empty one. Of pages with equal payloads of at least
    ``min_revisit_bytes`` bytes the one with the smallest id is a response, the others are revisits without payload
    that carry its digest and length; ids that tie for the smallest are all responses. A page without an id is a
    revisit if another with an id has its payload, else a response. Repeated rows are captures of their own. Request and
    metadata records name the response in WARC-Concurrent-To. Record ids are new in each run. An empty table gives an
    archive without records.
    """
    html = F.coalesce(column(html_col), F.lit(""))
    rows = pages.select(
        column(id_col).cast("long").alias("_id"), column(url_col).alias("_url"), html.alias("_html"),
        F.octet_length(html).cast("long").alias("_bytes"), F.sha2(html.cast("binary"), 256).alias("_digest"),
    )
    same = rows.filter(F.col("_bytes") >= min_revisit_bytes).groupBy(F.col("_digest").alias("_same")).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    ).filter("_n > 1").select("_same", "_first")
    rows = rows.join(stored(same, "equal-payloads"), F.col("_digest") == F.col("_same"), "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    new_id = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    rows = rows.select("*", again.alias("_again"), *[new_id.alias(f"_{k}") for k in ("request", "main", "meta")])

    path_of = F.regexp_extract("_url", r"^[a-zA-Z]+://[^/]*(/[^\r\n ]*)", 1)
    host = F.regexp_extract("_url", r"^[a-zA-Z]+://([^/\r\n ]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(F.nullif(path_of, F.lit("")), F.lit("/")), F.lit(" HTTP/1.1" + CRLF), _header("Host", host), F.lit(CRLF))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF), _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.col("_bytes").cast("string")), F.lit(CRLF),
    )
    about = F.concat(F.lit("via: crawl" + CRLF), _header("page-id", F.col("_id").cast("string")))
    url, beside = F.col("_url"), [_header("WARC-Concurrent-To", F.col("_main"))]
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest")))
    profile = _header("WARC-Profile", F.when(F.col("_again"), F.lit(REVISIT_PROFILE)))
    records = F.array(
        _record(F.lit("request"), F.col("_request"), url, date, beside, "application/http;msgtype=request", asked),
        _record(F.when(F.col("_again"), "revisit").otherwise("response"), F.col("_main"), url, date, [digest, profile],
                "application/http;msgtype=response", F.concat(http, F.when(F.col("_again"), "").otherwise(F.col("_html")))),
        _record(F.lit("metadata"), F.col("_meta"), url, date, beside, "application/warc-fields", about),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _fields(head: bytes) -> list[tuple[str, str]]:
    lines = head.decode("utf-8", "replace").split(CRLF)
    return [(k.strip().lower(), v.strip()) for k, sep, v in (x.partition(":") for x in lines) if sep]


def raw_records(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a file, compressed or not, unpacked piece by piece."""
    packed = content[:2] == b"\x1f\x8b"
    buffer, at, unpack = bytearray(), 0, zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, unpack
        if at >= len(content):
            return False
        piece = content[at : at + CHUNK]
        at += len(piece)
        while packed and piece:
            buffer.extend(unpack.decompress(piece))
            piece = unpack.unused_data
            if unpack.eof:  # records may be members of their own
                unpack = zlib.decompressobj(31)
        buffer.extend(piece if not packed else b"")
        return True

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not more():
                return
            end = buffer.find(b"\r\n\r\n")
        head = bytes(buffer[:end])
        size = int(dict(_fields(head)).get("content-length", "0"))
        while len(buffer) < end + 8 + size and more():
            pass
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]


def parsed(head: bytes, block: bytes, keep_payload: bool) -> dict:
    """A record as a row of ``RECORDS``."""
    fields = _fields(head)
    of = dict(fields)
    kind = of.get("warc-type", "")
    row = {
        "record_id": of.get("warc-record-id"), "type": kind, "target_uri": of.get("warc-target-uri"), "date": of.get("warc-date"),
        "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"], "page_id": None, "payload_bytes": None,
        "payload_digest": None, "digest_ok": None, "block": None, "payload": None,
    }
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        named = of.get("warc-payload-digest", "").removeprefix("sha256:") or None
        row["block"] = http.decode("utf-8", "replace")
        if kind == "response":
            row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
            row["digest_ok"] = named in (None, row["payload_digest"])
            row["payload"] = payload if keep_payload else None
        else:
            size = dict(_fields(http)).get("content-length", "")
            row["payload_bytes"], row["payload_digest"] = (int(size) if size.isdigit() else None), named
    else:
        row["block"] = block.decode("utf-8", "replace")
        if kind == "metadata":
            page = dict(_fields(block)).get("page-id", "")
            row["page_id"] = int(page) if page.removeprefix("-").isdigit() else None
    return row


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of all archives below a path, one row each (``RECORDS``); several rows are made at a time."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for head, block in raw_records(content):
                    rows.append(parsed(head, block, keep_payload))
                    held += len(block)
                    if held > 8 * CHUNK or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(records, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, struct ``main`` (response or revisit), ``requests``, ``metadata``.

    Requests and metadata records are joined to the response or revisit that they name in WARC-Concurrent-To, in
    whatever file it is; one that names several belongs to each. Those whose response is not there make a capture
    without ``main``; those that name nothing, a capture each. A response without others has empty arrays.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])
    main = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("_own"), whole.alias("main"))
    beside = records.filter(F.col("type").isin("request", "metadata"))
    named = F.when(F.size("concurrent_to") > 0, F.array_distinct("concurrent_to")).otherwise(F.array("record_id"))
    parts = beside.select(F.explode(named).alias("_of"), "type", whole.alias("_r")).groupBy("_of").agg(
        F.collect_list(F.when(F.col("type") == "request", F.col("_r"))).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", F.col("_r"))).alias("metadata"),
    )
    empty = F.array().cast(parts.schema["requests"].dataType)
    return main.join(parts, F.col("_own") == F.col("_of"), "full_outer").select(
        F.coalesce("_own", "_of").alias("capture_id"), "main",
        F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"),
    )


def page_captures(captures: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Per capture with a response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``refers_to`` is the smallest page id of a response with the revisit's digest; null if there is none.
    """
    rows = stored(captures.filter("main is not null").select(
        F.get(F.col("metadata"), F.lit(0))["page_id"].alias("page_id"),
        *[F.col("main")[c].alias(c) for c in ("payload_bytes", "payload_digest")], F.col("main")["type"].alias("record_type"),
    ), "captures")
    again = rows.filter("record_type = 'revisit'")
    first = rows.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_revisit_bytes)).groupBy(
        F.col("payload_digest").alias("_digest")
    ).agg(F.min("page_id").alias("refers_to"))
    first = stored(first.join(again.select("payload_digest").distinct(), F.col("_digest") == F.col("payload_digest"), "left_semi"), "responses")
    return again.join(first, F.col("payload_digest") == F.col("_digest"), "left").drop("_digest").unionByName(
        rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    )
