"""Streaming queries, each run until its input is used up; their results as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import shared_folder
from ..sources.kvstore import KvStore
from ..sources.tables import table
from ..streaming.upserts import counts_over_time, upsert_stream
from ..streaming.waits import turns


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(rows: DataFrame, folder: str) -> DataFrame:
    """A stream of the rows of a table, which are written down for it."""
    rows.write.parquet(f"{folder}/in")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")


def stream_waits(spark, sf):
    """When each fetch of the crawl could be made with an hour between two of one host."""
    crawl = table(spark, sf, "pt_crawl").where("url is not null and fetched_at is not null")
    fetches = crawl.select(
        U.host(F.col("url")).alias("host"), F.concat_ws(" ", "url", "crawl_id").alias("url"), F.unix_millis(F.col("fetched_at").cast("timestamp")).alias("at")
    )
    folder = _folder(spark)
    out = turns(_streamed(fetches, folder), 3_600_000).writeStream.option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_upserts(spark, sf):
    """The last event of each user, put into a store."""
    events = table(spark, sf, "events").where("user_id is not null and event_type is not null")
    cells = F.create_map(F.lit("event_type"), F.encode("event_type", "utf-8"))
    rows = events.select(F.col("user_id").cast("string").alias("key"), cells.alias("cols"), F.col("event_id").alias("at"))
    folder = _folder(spark)
    store = KvStore(spark, f"{folder}/store")
    out = upsert_stream(_streamed(rows, folder), store, "last").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return store.read("last").select("key", F.col("cols")["event_type"].cast("string").alias("event_type"))


def stream_counts(spark, sf):
    """Events by type and hour of their time."""
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").where("ts is not null")
    folder, name = _folder(spark), f"counts_{uuid.uuid4().hex}"
    counts = counts_over_time(_streamed(events, folder), "ts", "event_type", "1 hour", "10 minutes")
    out = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").format("memory").queryName(name)
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_waits, stream_upserts, stream_counts)}
SQL = {
    "stream_waits": r"""with p as (select lower(regexp_replace(regexp_extract(url, '(?s)^.*?.//([^/]*)', 1), ':.*$', '')) as host, url || ' ' || crawl_id as url, epoch_ms(fetched_at) as ms
  from pt_crawl where url is not null and fetched_at is not null),
r as (select *, row_number() over (partition by host order by ms, url) as i from p where host is not null)
select host, url, ms as "at", max(ms - i * 3600000) over (partition by host order by i rows unbounded preceding) + i * 3600000 as due from r""",
    "stream_upserts": "select user_id::varchar as key, arg_max(event_type, event_id) as event_type from events where user_id is not null and event_type is not null group by user_id",
    "stream_counts": """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*)::bigint as n from events where ts is not null group by all""",
}
