"""Queries over the row store's operators, on columns of ordinary tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import kvstore as K
from ..sources.tables import table

COLUMNS = ["name", "segment", "balance"]


def _base(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("string").alias("balance"),
    )


def _delta(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_custkey") % 3 == 0)
    return c.select(
        (F.col("c_custkey") * 2).cast("string").alias("key"), F.concat(F.lit("new "), "c_custkey").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "MOVED").alias("segment"), F.lit(None).cast("string").alias("balance"),
    )


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of named columns as rows of the store; null cells are none."""
    cells = F.map_from_arrays(F.array(*map(F.lit, COLUMNS)), F.array(*(F.encode(c, "utf-8") for c in COLUMNS)))
    return rows.select("key", F.map_filter(cells, lambda _, v: v.isNotNull()).alias("cols"))


def _columns(rows: DataFrame) -> DataFrame:
    """Rows of the store as rows of named columns."""
    return rows.select("key", *(F.try_element_at("cols", F.lit(c)).cast("string").alias(c) for c in COLUMNS))


def _store(spark, sf) -> K.KvStore:
    """A store of its own with the customers as the table ``c``."""
    store = K.KvStore(spark, f"{shared_folder(spark)}/kv-{uuid.uuid4().hex}")
    store.write("c", _cells(_base(spark, sf)))
    return store


def kv_put_cell(spark, sf):
    store = _store(spark, sf)
    store.put("c", _cells(_delta(spark, sf)))
    return _columns(store.read("c"))


def kv_put_row(spark, sf):
    store = _store(spark, sf)
    store.put_rows("c", _cells(_delta(spark, sf)))
    return _columns(store.read("c"))


def kv_compacted(spark, sf):
    """Cells, then whole rows, then cells again, in one base."""
    store = _store(spark, sf)
    for put, rows in ((store.put, _delta(spark, sf)), (store.put_rows, _delta(spark, sf).where("key like '1%'")), (store.put, _delta(spark, sf).where("key like '%4'"))):
        put("c", _cells(rows))
    store.compact("c")
    return _columns(store.read("c"))


def kv_range_scan(spark, sf):
    return _columns(_store(spark, sf).scan("c", "12", "2"))


def kv_key_ranges(spark, sf):
    rows = _base(spark, sf)
    counts = [
        K.key_range(rows, "key", lo, hi).agg(F.lit(lo or "").alias("low"), F.count(F.lit(1)).alias("n")) for lo, hi in K.key_ranges(["3", "12", "7"])
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def _dicts(spark, rows: list[dict]) -> DataFrame:
    data = [[r["key"], *((bytes(r[c]).decode() if c in r else None) for c in COLUMNS)] for r in rows]
    return spark.createDataFrame(data, "key string, name string, segment string, balance string")


def kv_get_row(spark, sf):
    cells = _store(spark, sf).get("c", "17")
    return _dicts(spark, [] if cells is None else [{"key": "17"} | cells])


def kv_get_cell(spark, sf):
    cell = _store(spark, sf).get("c", "17", "segment")
    return spark.createDataFrame([(None if cell is None else cell.decode(),)], "segment string")


def kv_exists(spark, sf):
    store = _store(spark, sf)
    return spark.createDataFrame([(k, store.exists("c", k)) for k in ("1", "17", "no such key", "")], "key string, there boolean")


def kv_exists_all(spark, sf):
    """Keys of a table that another one has, in one pass."""
    return _delta(spark, sf).select("key").join(_base(spark, sf).select("key"), "key", "left_semi")


def kv_count(spark, sf):
    return spark.createDataFrame([(_store(spark, sf).count("c"),)], "n bigint")


def kv_page_view(spark, sf):
    rows, _, _ = _store(spark, sf).page("c", "14")
    return _dicts(spark, [{"key": r.key} | dict(r.cols) for r in rows])


def kv_pages(spark, sf):
    """Where each of the first four pages of ten starts and how many rows there are in all."""
    store, start, out = _store(spark, sf), None, []
    for number in range(4):
        rows, after, total = store.page("c", start)
        out.append((number, rows[0].key, len(rows), after, total))
        start = after
    return spark.createDataFrame(out, "page int, first string, rows int, next string, total bigint")


def kv_tables(spark, sf):
    """Names of tables after some were made, renamed and dropped, with their rows."""
    store = _store(spark, sf)
    for name in ("a", "b"):
        store.put(name, _cells(_delta(spark, sf)))
    done = [("rename c to d", store.rename("c", "d")), ("rename d to a", store.rename("d", "a")), ("rename x to y", store.rename("x", "y"))]
    store.drop("b")
    rows = [(n, True, store.count(n)) for n in store.tables()] + [(n, ok, None) for n, ok in done]
    return spark.createDataFrame(rows, "name string, ok boolean, n bigint")


def _orders(spark, sf):
    from ..operators.dataset import Pairs

    orders = table(spark, sf, "orders")
    return Pairs(orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value")))


def kv_wide_pairs(spark, sf):
    return _orders(spark, sf).wide(3, "more").withColumn("more", F.array_join("more", " "))


def kv_replica_diff(spark, sf):
    mine = _base(spark, sf).where("cast(key as bigint) % 10 <> 1")
    return K.to_repair(mine, kv_put_cell(spark, sf), "key", COLUMNS)


def kv_digest(spark, sf):
    return _base(spark, sf).select("key", K.row_digest(COLUMNS).alias("digest"))


def kv_probe(spark, sf):
    c = table(spark, sf, "pt_crawl")
    return c.agg(
        F.count(F.lit(1)).alias("n"), F.count("url").alias("with_url"), F.count("page").alias("with_page"), F.count("title").alias("with_title")
    )


def kv_key_order(spark, sf):
    return _columns(_store(spark, sf).scan("c")).limit(25)


def golden_comparison(spark, sf):
    """Rows that two versions of a table hold for a key: equal, differing, extra, missing."""
    one = _base(spark, sf).select("key", K.row_digest(COLUMNS).alias("a"))
    two = kv_put_row(spark, sf).select("key", K.row_digest(COLUMNS).alias("b"))
    both = one.join(two, "key", "full_outer")
    kind = (
        F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "differs").otherwise("equal")
    )
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_B = "b as (select c_custkey::varchar as key, c_name as name, c_mktsegment as segment, c_acctbal::varchar as balance from customer)"
_D = """d as (select (c_custkey * 2)::varchar as key, 'new ' || c_custkey as name, case when c_custkey % 2 = 0 then 'MOVED' end as segment, null::varchar as balance
  from customer where c_custkey % 3 = 0)"""
_M = """m as (select coalesce(d.key, b.key) as key, coalesce(d.name, b.name) as name, coalesce(d.segment, b.segment) as segment, coalesce(d.balance, b.balance) as balance
  from b full join d on b.key = d.key)"""
_R = "r as (select * from b where key not in (select key from d) union all select * from d)"
_DIG = "sha1(concat_ws('&', 'balance=' || balance, 'name=' || name, 'segment=' || segment))"
QUERIES = {
    f.__name__: f
    for f in (
        kv_put_cell, kv_put_row, kv_range_scan, kv_key_ranges, kv_get_row, kv_get_cell, kv_exists, kv_count, kv_page_view, kv_wide_pairs,
        kv_compacted, kv_exists_all, kv_pages, kv_tables, kv_replica_diff, kv_digest, kv_probe, kv_key_order, golden_comparison,
    )
}
SQL = {
    "kv_put_cell": f"with {_B}, {_D}, {_M} select * from m",
    "kv_put_row": f"with {_B}, {_D}, {_R} select * from r",
    "kv_range_scan": f"with {_B} select * from b where key >= '12' and key < '2'",
    "kv_key_ranges": f"""with {_B} select case when key < '12' then '' when key < '3' then '12' when key < '7' then '3' else '7' end as low, count(*)::bigint as n from b group by all""",
    "kv_get_row": f"with {_B} select * from b where key = '17'",
    "kv_get_cell": f"with {_B} select segment from b where key = '17'",
    "kv_compacted": f"""with {_B}, {_D}, {_M}, r as (select * from m where key not in (select key from d where key like '1%') union all select * from d where key like '1%'),
e as (select * from d where key like '%4')
select coalesce(e.key, r.key) as key, coalesce(e.name, r.name) as name, coalesce(e.segment, r.segment) as segment, coalesce(e.balance, r.balance) as balance from r full join e on r.key = e.key""",
    "kv_exists": f"with {_B} select k as key, k in (select key from b) as there from (select unnest(['1', '17', 'no such key', '']) as k)",
    "kv_exists_all": f"with {_B}, {_D} select key from d where key in (select key from b)",
    "kv_pages": f"""with {_B}, o as (select key, row_number() over (order by key) - 1 as i, count(*) over () as total from b)
select (x.i // 10)::int as page, x.key as first, 10::int as rows, (select key from o y where y.i = x.i + 10) as next, total::bigint as total from o x where i in (0, 10, 20, 30)""",
    "kv_tables": f"""with {_B}, {_D} select 'a' as name, true as ok, (select count(*) from d)::bigint as n union all select 'd', true, (select count(*) from b)::bigint
union all select 'rename c to d', true, null union all select 'rename d to a', false, null union all select 'rename x to y', false, null""",
    "kv_count": "select count(*)::bigint as n from customer",
    "kv_page_view": f"with {_B} select * from b where key >= '14' order by key limit 10",
    "kv_wide_pairs": """with o as (select o_custkey::varchar as key, list(o_orderkey::varchar order by o_orderkey::varchar) as l from orders group by all)
select key, l[1] as v0, l[2] as v1, l[3] as v2, coalesce(array_to_string(l[4:], ' '), '') as more from o""",
    "kv_replica_diff": f"""with {_B}, {_D}, {_M}, x as (select key, {_DIG} as h from b where key::bigint % 10 <> 1), y as (select key, {_DIG} as h from m)
select y.key, case when x.key is null then 'missing' else 'differs' end as reason from y left join x on x.key = y.key where x.key is null or x.h <> y.h""",
    "kv_digest": f"with {_B} select key, {_DIG} as digest from b",
    "kv_probe": "select count(*)::bigint as n, count(url)::bigint as with_url, count(page)::bigint as with_page, count(title)::bigint as with_title from pt_crawl",
    "kv_key_order": f"with {_B} select * from b order by key limit 25",
    "golden_comparison": f"""with {_B}, {_D}, {_R}, x as (select key, {_DIG} as h from b), y as (select key, {_DIG} as h from r)
select case when x.key is null then 'extra' when y.key is null then 'missing' when x.h <> y.h then 'differs' else 'equal' end as kind, count(*)::bigint as n
from x full join y on x.key = y.key group by all""",
}
