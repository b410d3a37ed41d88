"""Fetching as an operator: urls go in, bodies and failures come out. What fetches is a function, so that any
connector, or a recorded one as here, can stand behind it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.settings import DEFAULTS
from lithic.sources.tables import truncate_body


class Connector(Protocol):
    """Gets a url: its status and body; any exception is a failed fetch."""

    def __call__(self, url: str) -> tuple[int, bytes]: ...


def recorded(url: str) -> tuple[int, bytes]:
    """A connector without a network: what a url answers follows from its hash."""
    h = hashlib.md5(url.encode()).hexdigest()
    if h[0] == "0":
        raise TimeoutError("no answer")
    return (404 if h[0] == "1" else 503 if h[0] == "2" else 200), f"<html>{url} {h}</html>".encode()


def fetch(urls: DataFrame, connector: Callable[[str], tuple[int, bytes]] = recorded, most_bytes: int = DEFAULTS.max_page_mb * 1024 * 1024) -> DataFrame:
    """(url, status, html, error) per url: a status of 400 and more is an error and has no body, a body is cut at
    the page limit. A failure is a row, never a failed task."""

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                try:
                    status, body = connector(url)
                    rows.append((status, body if status < 400 else None, f"HTTP {status}" if status >= 400 else None))
                except Exception as wrong:  # noqa: BLE001  a connector may raise anything
                    rows.append((None, None, type(wrong).__name__))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("url"), *columns], ["url", "status", "body", "error"])

    got = urls.select("url").mapInArrow(run, "url string, status int, body binary, error string")
    return got.select("url", "status", truncate_body(F.col("body"), most_bytes).alias("html"), "error")
