"""Web source, streams and command line."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from weftlake import cli
from weftlake.sources import web
from weftlake.sources.kvstore import SCHEMA, KvStore
from weftlake.streaming.upserts import counts_over_time, upsert_stream


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/to":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        kind = "text/html; charset=utf-8" if self.path == "/page" else "image/png"
        body = b"x" * 600_000
        self.send_response(200 if self.path != "/none" else 404)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command == "GET":
            try:
                self.wfile.write(body)
            except OSError:
                pass

    do_HEAD = do_GET

    def log_message(self, *args):
        pass


def test_fetch(spark):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        urls = spark.createDataFrame([(f"{root}{p}",) for p in ("/page", "/pic", "/to", "/none")] + [("http://127.0.0.1:1/x",), ("no url",), (None,)], "url string")
        rows = {r.url.rsplit("/", 1)[-1]: r for r in web.fetch_pages(urls.coalesce(1)).collect()}
    finally:
        server.shutdown()
    assert rows["page"].responsecode == 200 and len(rows["page"].page) == web.MAX_BYTES and rows["page"].length == 600_000
    assert rows["pic"].page is None and rows["to"].responsecode == 302 and rows["to"].location == "/page"
    assert rows["none"].responsecode == 404 and rows["x"].responsecode == rows["no url"].responsecode == web.FAILED


def test_upsert_stream(spark, tmp_path):
    store = KvStore(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    cells = lambda v: {"c": bytearray(v)}
    spark.createDataFrame([("a", cells(b"1"), 1), ("a", cells(b"2"), 2), ("b", cells(b"3"), 1)], SCHEMA + ", at int").write.parquet(source)
    stream = spark.readStream.schema(SCHEMA + ", at int").parquet(source)
    for _ in range(2):  # the second run goes on from the first and finds nothing new
        q = upsert_stream(stream, store, "t").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert store.get("t", "a") == {"c": b"2"} and store.count("t") == 2


def test_counts_over_time(spark, tmp_path):
    from datetime import datetime

    source = str(tmp_path / "events")
    rows = [(datetime(2024, 1, 1, 0, m), "k") for m in (0, 1, 7)]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, k string").parquet(source)
    q = counts_over_time(stream, "ts", "k", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]


def test_cli(spark, tmp_path):
    run = lambda *a: cli.main([a[0], str(tmp_path), *a[1:]], spark)
    assert run("put", "t", "k", "c", "v") == ["ok"] and run("put", "t", "k", "d", "w") == ["ok"]
    assert run("get", "t", "k", "c") == ["v"] and run("get", "t", "k", "x") == ["no value"] and run("get-row", "t", "k") == ["c=v d=w"]
    assert run("scan", "t", "--start", "a") == ["k c=v d=w"] and run("count", "t") == ["1"] and run("tables") == ["t"]
    assert run("rename", "t", "u") == ["ok"] and run("rename", "t", "u") == ["failed"] and run("drop", "u") == ["ok"] and run("get-row", "u", "k") == ["no row"]


def test_flatmap_pair_takes_all_words(tmp_path, spark):
    from weftlake.plans.datasets import rdd_flatmap_pair

    spark.createDataFrame([("a b c d e F g F",), (None,), ("",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.key, r.value): r.n for r in rdd_flatmap_pair(spark, str(tmp_path)).collect()}
    assert got == {(w, "1"): 1 for w in "abcdeg"} | {("f", "1"): 2, ("", "0"): 1}


def say(spark, args, output):
    if not args:
        raise ValueError("no words")
    output.write(" ".join(args))


def test_submit(spark):
    assert cli.main(["submit", "test_edges:say", "a", "b"], spark) == ["a b"]
    assert cli.submit(spark, "test_edges:say", []) == "failed: ValueError: no words"
    assert cli.submit(spark, "no_such_module", []).startswith("failed: ModuleNotFoundError")


def test_turns(spark, tmp_path):
    from weftlake.streaming.waits import turns

    schema = "host string, url string, at bigint"
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(source)
    for batch in ([("a", "u1", 0), ("a", "u2", 10), ("b", "u3", 10), (None, "u4", 1)], [("a", "u5", 2500), ("a", "u6", 2600)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        q = turns(stream, 1000).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
    assert {(r.url, r.due) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("u1", 0), ("u2", 1000), ("u3", 10), ("u5", 2500), ("u6", 3500)}
