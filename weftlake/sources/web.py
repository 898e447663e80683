"""Fetching pages: bounded bodies, no redirects followed, every failure a status."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host as host_of
from ..session import ship_package

#: Bytes of a body that are read; seconds a request may take; status of a request that failed.
MAX_BYTES, TIMEOUT, FAILED = 500_000, 5.0, 599
AGENT = "weftlake"
SCHEMA = "url string, responsecode int, contenttype string, length int, page binary, location string"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):  # noqa: ANN002, ANN003
        return None


def fetch(url: str, method: str = "GET", agent: str = AGENT) -> tuple[int, str | None, int | None, bytes | None, str | None]:
    """Status, content type, declared length, body (GET and 200 only) and redirect target of one request."""
    opener = urllib.request.build_opener(_Stay)
    try:
        request = urllib.request.Request(url, method=method, headers={"User-Agent": agent})
        try:
            reply = opener.open(request, timeout=TIMEOUT)
        except urllib.error.HTTPError as e:
            reply = e
        with reply:
            size = reply.headers.get("Content-Length", "")
            body = reply.read(MAX_BYTES) if method == "GET" and reply.status == 200 else None
            return reply.status, reply.headers.get("Content-Type"), int(size) if size.isdigit() else None, body, reply.headers.get("Location")
    except (OSError, ValueError):
        return FAILED, None, None, None, None


#: Answers, and bytes of pages, that are handed on together.
BATCH_ROWS, BATCH_BYTES = 100, 8_000_000


def fetch_pages(urls: DataFrame, agent: str = AGENT, delay_ms: int = 0) -> DataFrame:
    """A row of :data:`SCHEMA` for each of ``urls (url)``: HEAD first, GET where it is HTML with status 200.

    The urls of a host are one task's, which waits between two of them until
    ``delay_ms`` have gone by.
    """
    ship_package(urls.sparkSession)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string()]
    names = ["url", "responsecode", "contenttype", "length", "page", "location"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last, ready = 0, None, 0.0
        for batch in batches:
            for url, host in zip(batch.column("url").to_pylist(), batch.column("host").to_pylist()):
                if host == last:
                    time.sleep(max(0.0, ready - time.monotonic()))
                answer = fetch(url, "HEAD", agent)
                if answer[0] == 200 and (answer[1] or "").split(";")[0].strip().lower() == "text/html":
                    answer = fetch(url, "GET", agent)
                last, ready = host, time.monotonic() + delay_ms / 1000
                rows.append((url, *answer))
                size += len(answer[3] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    named = urls.select("url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")).where("url is not null")
    return named.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, SCHEMA)
