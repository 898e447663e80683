import pytest
from pyspark.sql import functions as F

from weftlake.operators.dataset import Opaque, Output, Pairs, Strings, folded, systematic_sample


def values(d):
    return sorted(d.collect())


def test_maps(spark):
    s = Strings.parallelize(spark, ["a b", "b", None])
    assert values(s.flat_map(lambda v: F.split(v, " "))) == ["a", "b", "b"]
    assert values(s.flat_map(Opaque(lambda v: v.split()))) == ["a", "b", "b"]
    assert values(s.flat_map(Opaque(lambda v: None))) == []
    keyed = s.map_to_pair(lambda v: (F.when(v != "b", v), F.lit("1")))
    assert values(keyed) == [("a b", "1")]
    assert values(s.map_to_pair(Opaque(lambda v: (v, "x") if v == "b" else None))) == [("b", "x")]
    pairs = s.flat_map_to_pair(lambda v: F.array(F.struct(v.alias("key"), F.length(v).cast("string").alias("value"))))
    assert values(pairs) == [("a b", "3"), ("b", "1")]
    assert values(pairs.flat_map(lambda k, v: F.array(k, v))) == ["1", "3", "a b", "b"]
    assert values(pairs.flat_map_to_pair(Opaque(lambda k, v: [(v, k)]))) == [("1", "b"), ("3", "a b")]


def test_filter_and_partitions(spark):
    s = Strings.parallelize(spark, list("abc"))
    assert values(s.filter(lambda v: v > "a")) == ["b", "c"]
    assert values(s.filter(Opaque(lambda v: v == "a"))) == ["a"]
    assert values(s.map_partitions(lambda it: (x * 2 for x in it))) == ["aa", "bb", "cc"]


def test_sets_counts_take(spark):
    s, t = Strings.parallelize(spark, list("xxy")), Strings.parallelize(spark, list("xzx"))
    assert values(s.intersection(t)) == ["x"]
    assert s.distinct().count() == 2 and s.count() == 3 and s.union(t).count() == 6
    assert s.take(5) == ["x", "x", "y"] and s.take(1) == ["x"]
    assert s.sample(0.0, 1).count() == 0 and s.sample(1.0, 1).count() == 3


def test_group_by(spark):
    s = Strings.parallelize(spark, ["ab", "b", "ac", ""])
    assert values(s.group_by(lambda v: F.nullif(F.substring(v, 1, 1), F.lit("")))) == [("a", "ab,ac"), ("b", "b")]


def test_join_and_cogroup(spark):
    left = Pairs.parallelize(spark, [("k", "a"), ("k", "b")])
    right = Pairs.parallelize(spark, [("k", "x"), ("k", "y"), ("z", "q")])
    assert values(left.join(right)) == [("k", "a,x"), ("k", "a,y"), ("k", "b,x"), ("k", "b,y")]
    fruit = Pairs.parallelize(spark, [("fruit", "apple"), ("fruit", "banana"), ("k", "a")])
    more = Pairs.parallelize(spark, [("fruit", "cherry"), ("fruit", "date"), ("fruit", "fig")])
    assert values(fruit.cogroup(more)) == [("fruit", "[apple,banana],[cherry,date,fig]"), ("k", "[a],[]")]


def test_folds(spark):
    none = spark.createDataFrame([], "value string, pos bigint")
    assert Strings(none).fold(F.lit("0"), lambda a, x: F.concat(a, x), "pos").first().value == "0"
    rows = spark.createDataFrame([("a", "1", 0), ("a", "2", 20_001), ("b", "5", 1), ("a", "3", 20_000)], "key string, value string, pos int")
    assert values(Pairs(rows).fold_by_key(F.lit(""), lambda a, x: F.concat(a, x), "pos")) == [("a", "132"), ("b", "5")]
    sums = folded(rows, ["key"], "value", F.lit(0), lambda a, x: a + x, "pos", "bigint").collect()
    assert {(r.key, r.value) for r in sums} == {("a", 6), ("b", 5)}


def test_wide_save_and_destroy(spark, tmp_path):
    p = Pairs.parallelize(spark, [("k", "b"), ("k", "a"), ("l", "c")])
    assert {tuple(r) for r in p.wide(2).collect()} == {("k", "a", "b"), ("l", "c", None)}
    p.save(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    s = Strings.parallelize(spark, ["x", "x"])
    s.save(str(tmp_path / "s"))
    saved = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len({r.key for r in saved}) == 2
    s.destroy()
    with pytest.raises(RuntimeError):
        s.count()


def test_output():
    out = Output()
    assert out.text() == Output.EMPTY
    out.write("a")
    out.write("b")
    assert out.text() == "a\nb"


def test_systematic_sample(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert sorted(r.k for r in systematic_sample(rows, "k", 10).collect()) == list(range(0, 1000, 100))
    assert systematic_sample(rows, "k", 0).count() == 1000 and systematic_sample(rows, "k", 2000).count() == 1000
    assert systematic_sample(rows, "k", 300).count() == 300


def test_wide_keeps_what_goes_beyond_its_columns(spark):
    pairs = Pairs(spark.createDataFrame([("a", v) for v in "51342"] + [("b", "1")], "key string, value string"))
    assert sorted(tuple(r) for r in pairs.wide(3, "more").collect()) == [("a", "1", "2", "3", ["4", "5"]), ("b", "1", None, None, [])]


def test_wide_has_room_for_all_values(spark, monkeypatch):
    from weftlake.operators import dataset

    pairs = Pairs(spark.createDataFrame([("a", v) for v in "51342"] + [("b", "1")], "key string, value string"))
    assert sorted(tuple(r) for r in pairs.wide().collect()) == [("a", "1", "2", "3", "4", "5"), ("b", "1", None, None, None, None)]
    with pytest.raises(ValueError):
        pairs.wide(3)
    monkeypatch.setattr(dataset, "MOST_COLUMNS", 4)
    with pytest.raises(ValueError):
        pairs.wide()
    assert Pairs(pairs.df.limit(0)).wide().columns == ["key"]


def test_folds_with_any_step(spark):
    from weftlake.operators.dataset import Opaque

    rows = spark.createDataFrame([("a", str(i), i) for i in range(50)] + [("b", "7", 3), (None, "1", 1), (None, "2", 0)], "key string, value string, at int")
    step = Opaque(lambda a, x: str(int(a) * 3 % 1009 - int(x)))
    got = {r.key: r.value for r in Pairs(rows.repartition(5)).fold_by_key_in_order("1", step, "at").df.collect()}
    want = "1"
    for i in range(50):
        want = step.fn(want, str(i))
    assert got == {"a": want, "b": step.fn("1", "7"), None: step.fn(step.fn("1", "2"), "1")}
    assert Strings(rows.where("key = 'a'").repartition(5)).fold_in_order("1", step, "at") == want
    assert Strings(rows.limit(0)).fold_in_order("z", step, "at") == "z"


def test_opaque_groups_text_and_partitions(spark, tmp_path):
    from weftlake.operators.dataset import Opaque

    s = Strings.parallelize(spark, ["ab", "ac", "b"])
    assert sorted(s.group_by(Opaque(lambda v: v[0])).collect()) == [("a", "ab,ac"), ("b", "b")]
    assert s.spread_over(3).df.rdd.getNumPartitions() == 3
    s.append_text(str(tmp_path / "t"))
    s.append_text(str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 6
