"""WARC archives with revisit resolution.

``write_archive`` turns pages into response records; ``read_archive`` parses archives back. ``deduplicate`` shuffles the headers of the
records (never their payloads) by payload digest, picks the record with the smallest page id as the original of each digest, and writes new archives with
fresh headers in which the others are revisit records (no payload; the HTTP header keeps its length).

Archives are gzip files of whole records written by Spark's text writer, with the record terminator as line separator, so they
go to any file system Spark knows; they are read as binary files and cut by Content-Length, never by searching for a terminator.

* null html: empty payload; null url: no target header; null page id: no id header, sorts last. Control characters in a url are escaped.
* repeated rows are records of their own: the first by (page id, record id) is the response. Equal payloads of any number pre-aggregate before
  the shuffle; the decisions then join by record id, which is even. Extra columns are ignored; an empty table gives an archive without records.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

END = "\r\n\r\n"
FIELDS = "record_id string, page_id long, url string, record_type string, digest string, payload_bytes long, refers_to string, refers_to_page long"
FILE_BYTES = 16 << 20


def _record(kind: str, record_id: str, page, url, digest: str, n: int, payload: str | None, date: str, refers: str | None = None, refers_page=None) -> str:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if not pd.isna(url):
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if not pd.isna(page):
        head.append(f"X-Page-Id: {int(page)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
        if not pd.isna(refers_page):
            head.append(f"X-Refers-To-Page-Id: {int(refers_page)}")
    size = len(http) + (n if payload is not None else 0)
    return "\r\n".join([*head, f"Content-Length: {size}"]) + "\r\n\r\n" + http + (payload or "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(records: DataFrame, path: str) -> None:
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """One response record per page. Record ids are made of the place of the row, so they are unique."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for uid, page, url, html in zip(pdf["uid"], pdf["page"], pdf["url"], pdf["html"]):
                data = (html or "").encode("utf-8")
                out.append(_record("response", f"urn:x-row:{uid}", page, url, digest_of(data), len(data), html or "", date))
            yield pd.DataFrame({"value": out})

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # files hold about the input split; Int64 keeps ids whole beside nulls
    rows = rows.withColumn("page", F.col("page").cast("string"))
    _write(rows.mapInPandas(build, "value string"), path)


def _parse(data: bytes) -> Iterator[tuple[dict, bytes, int]]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[stop + 4:stop + 4 + size]
        cut = block.index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in block[:cut - 4].decode("utf-8").split("\r\n")[1:])
        yield head, block[cut:], int(http["Content-Length"])
        at = stop + 4 + size
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record does not end at byte {at}")
        at += 4


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record: id, page, url, type, digest, payload length, what it refers to, and on request the payload."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                out, held = [], 0
                for head, body, n in _parse(gzip.decompress(content)):
                    if payload and head["WARC-Type"] == "response" and digest_of(body) != head["WARC-Payload-Digest"][5:]:
                        raise ValueError("payload and digest differ")
                    page, to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                    refers = head.get("WARC-Refers-To")
                    row = (head["WARC-Record-ID"][1:-1], page, head.get("WARC-Target-URI"), head["WARC-Type"], head["WARC-Payload-Digest"][5:], n, refers and refers[1:-1], to)
                    out.append((*row, body.decode("utf-8")) if payload else row)
                    held += len(body) if payload else 200
                    if held > 8 << 20:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payload
    text = FIELDS.replace(" long", " string") + (", payload string" if payload else "")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(rows, text.replace("payload_bytes string", "payload_bytes long"))
    return found.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to_page", F.col("refers_to_page").cast("long"))


def decisions(headers: DataFrame, least: int = 0) -> DataFrame:
    """(record_id, refers_to, refers_to_page) of the records that revisit another: equal digest and length, at least ``least`` bytes."""
    rank = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_id")
    sized = headers.where(F.col("payload_bytes") >= least)
    first = settle(sized.groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("digest", "payload_bytes", "first"), "originals")
    return sized.join(first, ["digest", "payload_bytes"]).where(F.col("record_id") != F.col("first.record_id")).select(
        "record_id", F.col("first.record_id").alias("refers_to"), F.col("first.page_id").alias("refers_to_page"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = 0, date: str = "2024-01-02T00:00:00Z") -> None:
    """Rewrite the archives below ``source`` with revisit records."""
    again = decisions(settle(read_archive(spark, source), "headers"), least).withColumnsRenamed({"refers_to": "to", "refers_to_page": "to_page"})
    rows = read_archive(spark, source, payload=True).join(again, "record_id", "left")
    rows = rows.select("record_id", F.col("page_id").cast("string").alias("page"), "url", "digest", "payload_bytes", "to", F.col("to_page").cast("string").alias("to_page"),
                       F.when(F.col("to").isNull(), F.col("payload")).alias("payload"))

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"value": [_record("response" if pd.isna(r.to) else "revisit", r.record_id, r.page, r.url, r.digest, r.payload_bytes, r.payload if pd.isna(r.to) else None, date,
                                                  None if pd.isna(r.to) else r.to, r.to_page) for r in pdf.itertuples()]}, dtype=object)

    _write(rows.mapInPandas(build, "value string"), target)


def resolve(records: DataFrame) -> DataFrame:
    """Payloads of revisit records from the responses they refer to; responses keep theirs."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("original"))
    return records.join(originals, "refers_to", "left").withColumn("payload", F.coalesce("original", "payload")).drop("original")
