"""p6: lines repeated across the pages of one host, and their removal.

The lines of a host are nodes of a graph, weighted by the number of distinct
urls whose pages hold them; lines that follow each other on a page are joined
by an edge, weighted in the same way.  Nodes and edges of high support stay;
the connected components of what stays are the host's boilerplate blocks.
p6_found lists every occurrence of their lines, p6_cleaned gives the pages
without them.

Lines are equal when equal in lower case with each run of the digits 0-9
replaced by ``#``.  Rows with a null url or crawl_id, or without page, take no
part; a url without authority belongs to the host ``''``; repeated rows count
once for support, as they have one url.  Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_by_key
from ..session import cut_lineage
from ..sources.tables import table
from .components import components
from .scan import map_batches, parsed

#: Distinct urls of a host that must hold a line, or two lines in a row.
SUPPORT = 5

_DIGITS = re.compile(r"[0-9]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", re.I)


def host_of(url: str) -> str:
    """Authority of a url in lower case, without port; '' when it has none."""
    found = _HOST.match(url)
    return re.sub(r":\d*$", "", found[1].lower()) if found else ""


def line_key(text: str) -> str:
    """What equal lines have in common."""
    return _DIGITS.sub("#", text.lower())


def _long(text: str) -> int:
    n = xxhash.xxh3_64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


def _page_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, pages = parsed(batch)
    urls = batch.column("url").to_pylist()
    ids: dict[str, int] = {}
    flat = []
    for blocks in pages:
        for b in blocks:
            n = ids.get(b.text)
            if n is None:
                n = ids[b.text] = _long(line_key(b.text))
            flat.append(n)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in pages])]).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("crawl_id"),
            pa.array([_long(u) for u in urls], pa.int64()),
            pa.array([_long(host_of(u)) for u in urls], pa.int64()),
            lines,
        ],
        ["crawl_id", "url_id", "host_id", "lines"],
    )


def page_lines(crawl: DataFrame) -> DataFrame:
    """One row for each page: ``crawl_id, url_id, host_id`` and ``lines``, an id for each block.

    The ids are 64-bit hashes; lines are told apart by host and line together.
    """
    named = crawl.where("crawl_id is not null and url is not null")
    return map_batches(
        named,
        ["crawl_id", "url", "page"],
        _page_lines,
        "crawl_id bigint, url_id bigint, host_id bigint, lines array<bigint>",
    )


def _supported(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys``, number of urls ``urls`` and of rows ``n`` for keys on SUPPORT urls or more."""
    return (
        rows.groupBy(*keys, "url_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("urls"), F.sum("n").alias("n"))
        .where(F.col("urls") >= SUPPORT)
    )


def line_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(host_id, line, urls, n)`` and edges ``(host_id, a, b, urls, n)`` of high support."""
    nodes = _supported(pages.select("host_id", "url_id", F.explode("lines").alias("line")), "host_id", "line")
    pair = F.arrays_zip(
        F.slice("lines", 1, F.size("lines") - 1).alias("a"), F.slice("lines", 2, F.size("lines") - 1).alias("b")
    )
    pairs = pages.where(F.size("lines") > 1).select("host_id", "url_id", F.inline(pair).alias("a", "b"))
    return nodes, _supported(pairs, "host_id", "a", "b")


def boilerplate_blocks(pages: DataFrame) -> DataFrame:
    """Lines of high support with the block they belong to: ``host_id, line, urls, n, block``.

    ``block`` is the id of the component of the line's host and line.
    """
    nodes, edges = line_graph(pages)
    nodes = cut_lineage(nodes)
    key = lambda line: F.xxhash64("host_id", line)
    blocks = components(edges.select(key("a").alias("a"), key("b").alias("b")))
    named = nodes.withColumn("node", key("line"))
    return named.join(blocks, "node", "left").select(
        "host_id", "line", "urls", "n", F.coalesce("component", "node").alias("block")
    )


def _page_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, pages = parsed(batch)
    texts = pa.array([[b.text for b in blocks] for blocks in pages], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*_page_lines(batch).columns, texts], ["crawl_id", "url_id", "host_id", "lines", "texts"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for texts, cut in zip(batch.column("texts").to_pylist(), batch.column("cut").to_pylist()):
            gone = set(cut or ())
            kept.append("\n".join(t for i, t in enumerate(texts) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("crawl_id"), pa.array(kept, pa.string())], ["crawl_id", "text"])


def cleaned_pages(crawl: DataFrame) -> DataFrame:
    """Each page without its boilerplate lines: ``crawl_id, text``, the blocks that remain joined by line breaks."""
    page = F.xxhash64("url_id", "lines").alias("page_id")  # rows of one crawl_id may differ
    found = _occurrences(cut_lineage(page_lines(crawl)), "crawl_id", page)
    cut = found.groupBy("crawl_id", "page_id").agg(F.collect_set("block_no").alias("cut"))
    named = crawl.where("crawl_id is not null and url is not null")
    texts = map_batches(
        named,
        ["crawl_id", "url", "page"],
        _page_texts,
        "crawl_id bigint, url_id bigint, host_id bigint, lines array<bigint>, texts array<string>",
    )
    both = texts.select("crawl_id", page, "texts").join(cut, ["crawl_id", "page_id"], "left")
    return both.select("crawl_id", "texts", "cut").mapInArrow(_without, "crawl_id bigint, text string")


def repeated_blocks(crawl: DataFrame) -> DataFrame:
    """Occurrences of boilerplate lines: ``crawl_id, block_no, block``."""
    return _occurrences(cut_lineage(page_lines(crawl)), "crawl_id")


def _occurrences(pages: DataFrame, *keys: Column | str) -> DataFrame:
    """Occurrences of boilerplate lines in ``pages``, which is read several times: ``keys, block_no, block``."""
    lines = cut_lineage(boilerplate_blocks(pages))
    occurrences = pages.select(
        *keys, "host_id", F.posexplode("lines").alias("block_no", "line")
    ).withColumn("block_no", F.col("block_no").cast("bigint"))
    found = join_by_key(
        occurrences,
        lines.select("host_id", "line", "block"),
        lines.select("host_id", "line", "n"),
        "host_id",
        "line",
    )
    return found.drop("host_id", "line")


def p6_found(spark, sf):
    return repeated_blocks(table(spark, sf, "pt_crawl")).select("crawl_id", "block_no")


def p6_cleaned(spark, sf):
    return cleaned_pages(table(spark, sf, "pt_crawl"))


QUERIES = {"p6_found": p6_found, "p6_cleaned": p6_cleaned}
SQL: dict[str, str] = {}
