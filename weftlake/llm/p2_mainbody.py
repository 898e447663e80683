"""p2: the main body of each page; p7: pages of keywords, links and tags.

Both look at one page at a time, so they are a single pass without shuffle.
Rows with a null or empty page, or a page without any text, have no blocks;
rows with a null ``crawl_id`` cannot be named and are left out; a row repeated
in full comes out as often as it stands in the table.  Further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.tables import table
from .mainbody import Judged, main_blocks
from .scan import map_batches, parsed


def _main(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, pages = parsed(batch)
    kept = main_blocks(pages)
    sizes = [len(k) for k in kept]
    ids = np.repeat(batch.column("crawl_id").to_numpy(zero_copy_only=False), sizes)
    texts = [b[i].text for b, k in zip(pages, kept) for i in k]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.concatenate(kept), pa.int64()), pa.array(texts, pa.string())],
        ["crawl_id", "block_no", "text"],
    )


def main_body(crawl: DataFrame) -> DataFrame:
    """Main-body blocks of ``crawl (crawl_id, page)``: ``crawl_id, block_no, text``."""
    named = crawl.where("crawl_id is not null")
    return map_batches(named, ["crawl_id", "page"], _main, "crawl_id bigint, block_no bigint, text string")


def _numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, pages = parsed(batch)
    kept = main_blocks(pages)
    ids = np.repeat(batch.column("crawl_id").to_numpy(zero_copy_only=False), [len(k) for k in kept])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.concatenate(kept), pa.int64())], ["crawl_id", "block_no"]
    )


def main_body_numbers(crawl: DataFrame) -> DataFrame:
    """As :func:`main_body` without the text, which then never leaves the workers."""
    named = crawl.where("crawl_id is not null")
    return map_batches(named, ["crawl_id", "page"], _numbers, "crawl_id bigint, block_no bigint")


def _stuffed(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, pages = parsed(batch)
    return batch.select(["crawl_id"]).filter(pa.array(Judged(pages).stuffed(), pa.bool_()))


def stuffed_pages(crawl: DataFrame) -> DataFrame:
    """``crawl_id`` of pages dominated by few non-sentence shapes."""
    named = crawl.where("crawl_id is not null")
    return map_batches(named, ["crawl_id", "page"], _stuffed, "crawl_id bigint")


def p2_found(spark, sf):
    return main_body_numbers(table(spark, sf, "pt_crawl"))


def p7_found(spark, sf):
    return stuffed_pages(table(spark, sf, "pt_crawl"))


QUERIES = {"p2_found": p2_found, "p7_found": p7_found}
SQL: dict[str, str] = {}
