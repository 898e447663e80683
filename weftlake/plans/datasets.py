"""Queries over the dataset layer: maps, filters, joins, folds, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as D
from ..sources.tables import table

S = D.Strings


def _words(spark, sf) -> D.Strings:
    docs = table(spark, sf, "documents").where("text is not null")
    return S.from_table(docs, F.col("text"))


def _events(spark, sf) -> D.Strings:
    return S.from_table(table(spark, sf, "events"), F.col("event_type"))


def _counted(data, *by):
    return data.df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rdd_from_table(spark, sf):
    return S.from_table(table(spark, sf, "customer"), F.when(F.col("c_acctbal") > 0, F.col("c_name"))).df


def rdd_parallelize(spark, sf):
    return S.parallelize(spark, ["pear", "apple", "pear", "fig"]).df


def rdd_flatmap(spark, sf):
    return _counted(_words(spark, sf).flat_map(lambda v: F.split(v, " ")), "value")


def _sized(words):
    return F.transform(words, lambda w: F.struct(F.lower(w).alias("key"), F.length(w).cast("string").alias("value")))


def rdd_flatmap_pair(spark, sf):
    pairs = _words(spark, sf).flat_map_to_pair(lambda v: _sized(F.split(v, " ")))
    return _counted(pairs, "key", "value")


def rdd_map_pair(spark, sf):
    source = S.from_table(table(spark, sf, "orders"), F.col("o_orderpriority"))
    pairs = source.map_to_pair(lambda v: (F.when(v != "5-LOW", F.substring(v, 1, 1)), F.lit("1")))
    return _counted(pairs, "key", "value")


def pair_flatmap(spark, sf):
    pairs = _events(spark, sf).map_to_pair(lambda v: (v, F.length(v).cast("string")))
    return _counted(pairs.flat_map(lambda k, v: F.array(k, v)), "value")


def pair_flatmap_pair(spark, sf):
    pairs = _events(spark, sf).map_to_pair(lambda v: (v, F.length(v).cast("string")))
    swapped = pairs.flat_map_to_pair(lambda k, v: F.array(F.struct(v.alias("key"), k.alias("value"))))
    return _counted(swapped, "key", "value")


def rdd_opaque_map(spark, sf):
    out = _events(spark, sf).flat_map(D.Opaque(lambda v: [v[::-1]] if v else None))
    return _counted(out, "value")


def rdd_filter(spark, sf):
    return S.from_table(table(spark, sf, "orders"), F.col("o_orderpriority")).filter(lambda v: v.startswith("1")).df


def rdd_map_partitions(spark, sf):
    shouted = _events(spark, sf).map_partitions(lambda vs: (v.upper() for v in vs))
    return _counted(shouted, "value")


def rdd_sample_bernoulli(spark, sf):
    return _events(spark, sf).sample(0.1, seed=7).df


def rdd_sample_systematic(spark, sf):
    return D.systematic_sample(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 100)


def rdd_distinct(spark, sf):
    return S.from_table(table(spark, sf, "customer"), F.col("c_mktsegment")).distinct().df


def rdd_intersection(spark, sf):
    left = S.from_table(table(spark, sf, "customer"), F.col("c_custkey"))
    right = S.from_table(table(spark, sf, "orders"), F.col("o_custkey"))
    return left.intersection(right).df


def rdd_union(spark, sf):
    names = S.from_table(table(spark, sf, "nation"), F.col("n_name"))
    return names.union(S.from_table(table(spark, sf, "region"), F.col("r_name"))).df


def rdd_group_by(spark, sf):
    return S.from_table(table(spark, sf, "nation"), F.col("n_name")).group_by(lambda v: F.substring(v, 1, 1)).df


def rdd_count(spark, sf):
    return _words(spark, sf).df.agg(F.count(F.lit(1)).alias("n"))


def rdd_take(spark, sf):
    first = S.from_table(table(spark, sf, "customer"), F.col("c_name")).take(10)
    return S.parallelize(spark, first).df


def rdd_fold(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey"), F.round(F.col("o_totalprice")).cast("bigint").alias("value"))
    return D.Strings(orders).fold(F.lit(0), lambda a, x: a + x, "o_orderkey", "bigint")


def pair_fold_by_key_sum(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("bigint").alias("value"))
    return D.Pairs(rows).aggregate_by_key(value=F.sum("value"))


def pair_fold_by_key_concat(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.substring("event_type", 1, 1).alias("value"), "event_id")
    folded = D.Pairs(rows).fold_by_key(F.lit(""), lambda a, x: F.concat(a, x), "event_id").df
    return folded.select("key", F.length("value").cast("bigint").alias("n"), F.md5("value").alias("digest"))


def pair_fold_by_key_any(spark, sf):
    """A fold whose step is not associative: each event type's checksum over its ids in order."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), "event_id")
    step = D.Opaque(lambda a, x: str((int(a) * 31 + int(x)) % 1_000_003))
    return D.Pairs(rows).fold_by_key_in_order("7", step, "event_id").df


def pair_fold_by_key_setunion(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value"))


def pair_fold_by_key_append(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value"))
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))


def pair_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("value"))
    return D.Pairs(c).join(D.Pairs(o)).df


def pair_cogroup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    return D.Pairs(c).cogroup(D.Pairs(s)).df


def rdd_count_distinct(spark, sf):
    return table(spark, sf, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


_STRINGS = "select {} as value from {} where {} is not null"
_EV = "select event_type as k, length(event_type)::varchar as v from events where event_type is not null"
QUERIES = {
    f.__name__: f
    for f in (
        rdd_from_table, rdd_parallelize, rdd_flatmap, rdd_flatmap_pair, rdd_map_pair, pair_flatmap, pair_flatmap_pair, rdd_opaque_map,
        rdd_filter, rdd_map_partitions, rdd_sample_bernoulli, rdd_sample_systematic, rdd_distinct, rdd_intersection, rdd_union,
        rdd_group_by, rdd_count, rdd_take, rdd_fold, pair_fold_by_key_sum, pair_fold_by_key_concat, pair_fold_by_key_any, pair_fold_by_key_setunion,
        pair_fold_by_key_append, pair_join, pair_cogroup, rdd_count_distinct,
    )
}
SQL = {
    "rdd_from_table": "select c_name as value from customer where c_acctbal > 0",
    "rdd_parallelize": "select unnest(['pear', 'apple', 'pear', 'fig']) as value",
    "rdd_flatmap": "select value, count(*)::bigint as n from (select unnest(string_split(text, ' ')) as value from documents) where value is not null group by value",
    "rdd_flatmap_pair": "select lower(w) as key, length(w)::varchar as value, count(*)::bigint as n from (select unnest(string_split(text, ' ')) as w from documents) group by all",
    "rdd_map_pair": "select left(o_orderpriority, 1) as key, '1' as value, count(*)::bigint as n from orders where o_orderpriority <> '5-LOW' group by all",
    "pair_flatmap": f"select value, count(*)::bigint as n from (select unnest([k, v]) as value from ({_EV})) group by value",
    "pair_flatmap_pair": f"select v as key, k as value, count(*)::bigint as n from ({_EV}) group by all",
    "rdd_opaque_map": "select reverse(event_type) as value, count(*)::bigint as n from events where event_type <> '' group by all",
    "rdd_filter": "select o_orderpriority as value from orders where starts_with(o_orderpriority, '1')",
    "rdd_map_partitions": "select upper(event_type) as value, count(*)::bigint as n from events where event_type is not null group by all",
    "rdd_sample_systematic": """with t as (select greatest(1, count(*) // 100) as step from events),
n as (select event_id, event_type, row_number() over (order by event_id) - 1 as i from events)
select event_id, event_type from n, t where i % step = 0 and i < step * 100""",
    "rdd_distinct": "select distinct c_mktsegment as value from customer where c_mktsegment is not null",
    "rdd_intersection": "select c_custkey::varchar as value from customer intersect select o_custkey::varchar from orders",
    "rdd_union": "select n_name as value from nation union all select r_name from region",
    "rdd_group_by": "select left(n_name, 1) as key, string_agg(n_name, ',' order by n_name) as value from nation group by all",
    "rdd_count": "select count(*)::bigint as n from documents where text is not null",
    "rdd_take": "select c_name as value from customer order by 1 limit 10",
    "rdd_fold": "select sum(round(o_totalprice)::bigint)::bigint as value from orders",
    "pair_fold_by_key_sum": "select l_returnflag as key, sum(l_quantity::bigint)::bigint as value from lineitem group by all",
    "pair_fold_by_key_concat": "select key, length(v)::bigint as n, md5(v) as digest from (select event_type as key, string_agg(left(event_type, 1), '' order by event_id) as v from events group by all)",
    "pair_fold_by_key_any": """select event_type as key, list_reduce(list_prepend(7::bigint, list(event_id order by event_id)), lambda a, x: (a * 31 + x) % 1000003)::varchar as value
from events group by event_type""",
    "pair_fold_by_key_setunion": "select o_custkey as key, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as value from orders group by all",
    "pair_fold_by_key_append": "select n_regionkey as key, string_agg(n_name, ',' order by n_name) as value from nation group by all",
    "pair_join": "select c_custkey::varchar as key, c_mktsegment || ',' || o_orderkey as value from customer join orders on c_custkey = o_custkey",
    "pair_cogroup": """with c as (select c_nationkey::varchar as key, string_agg(c_mktsegment, ',' order by c_mktsegment) as l from customer group by all),
s as (select s_nationkey::varchar as key, string_agg(s_name, ',' order by s_name) as r from supplier group by all)
select coalesce(c.key, s.key) as key, '[' || coalesce(l, '') || '],[' || coalesce(r, '') || ']' as value from c full join s on c.key = s.key""",
    "rdd_count_distinct": "select count(distinct user_id)::bigint as users, count(distinct event_type)::bigint as types from events",
}
