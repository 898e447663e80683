import pytest
from pyspark.errors import PySparkException

from weftlake.sources import kvstore as K
from weftlake.sources import rowfiles as R


def rows(spark, data):
    return spark.createDataFrame([(k, {c: bytearray(v) for c, v in cells.items()}) for k, cells in data.items()], K.SCHEMA)


def test_upserts(spark, tmp_path):
    s = K.KvStore(spark, str(tmp_path))
    s.put("t", rows(spark, {"r": {"a": b"1"}}))
    s.put("t", rows(spark, {"r": {"b": b"2"}, "q": {"a": b"3"}}))
    assert s.get("t", "r") == {"a": b"1", "b": b"2"} and s.get("t", "r", "b") == b"2"
    s.put_rows("t", rows(spark, {"r": {"a": b"9"}}))
    assert s.get("t", "r") == {"a": b"9"} and s.get("t", "x") is None and s.get("t", "r", "zz") is None
    assert s.count("t") == 2 and s.exists("t", "q") and not s.exists("t", "zz")
    assert [r.key for r in s.scan("t", "q", "r").collect()] == ["q"] and s.scan("t").count() == 2


def test_names(spark, tmp_path):
    s = K.KvStore(spark, str(tmp_path))
    s.put("a", rows(spark, {"r": {"c": b"1"}}))
    s.put("b", rows(spark, {"r": {"c": b"1"}}))
    assert s.tables() == ["a", "b"] and not s.rename("a", "b") and not s.rename("x", "y")
    assert s.rename("a", "c") and s.tables() == ["b", "c"] and s.count("c") == 1
    s.drop("c")
    s.drop("c")
    assert s.tables() == ["b"] and s.count("c") == 0
    with pytest.raises(PySparkException):
        s.put("b", rows(spark, {"": {"c": b"1"}}))


def test_ranges_and_pages(spark):
    df = spark.createDataFrame([(k, 1) for k in "abcdef"], "key string, v int")
    ranges = K.key_ranges(["c", "e", "c"])
    assert ranges == [(None, "c"), ("c", "e"), ("e", None)]
    assert [K.key_range(df, "key", *r).count() for r in ranges] == [2, 2, 2]
    assert [r.key for r in K.page_view(df, "key", "b", 3).collect()] == ["b", "c", "d"]


def test_row_files(spark, tmp_path):
    cells = {"url": b"http://a.b/", "page": b"x y 3 z\n", "none": b""}
    raw = R.serialize_row("some key".replace(" ", "-"), cells)
    assert R.parse_row(raw) == ("some-key", cells)
    assert R.parse_row(raw[:-3])[1] == {k: cells[k] for k in ("url", "page")} or R.parse_row(raw[:-3])[1].keys() <= cells.keys()
    assert R.parse_row(b"") is None and R.parse_row(b"key ") == ("key", {})
    assert R.decode_key(R.encode_key("a/b_c:é")) == "a/b_c:é" and R.encode_key("ab-9") == "ab-9"
    (tmp_path / "__ab").mkdir()
    (tmp_path / "__ab" / "abcdef").write_bytes(raw)
    (tmp_path / "k").write_bytes(R.serialize_row("k", {}))
    (tmp_path / "empty").write_bytes(b"")
    found = {r.key: {c: bytes(v) for c, v in r.cols.items()} for r in R.read_row_files(spark, str(tmp_path)).collect()}
    assert found == {"some-key": cells, "k": {}}


def test_digest_all_takes_every_row_and_column(tmp_path, spark):
    from weftlake.plans.tables import kv_digest

    rows = [(1, "a", "s", 1.5), (2, "a", "s", 2.5), (3, "a", "s", None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.key: r.digest for r in kv_digest(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3"} and len(set(got.values())) == 3


def test_versions_deltas_and_writers(spark, tmp_path, monkeypatch):
    s = K.KvStore(spark, str(tmp_path))
    s.write("t", rows(spark, {f"k{i}": {"a": b"0", "b": b"0"} for i in range(20)}))
    before = s.read("t")
    s.put("t", rows(spark, {"k1": {"a": b"1"}, "new": {"c": b"2"}}))
    s.put_rows("t", rows(spark, {"k2": {"z": b"3"}}))
    s.put("t", rows(spark, {"k2": {"y": b"4"}}))
    assert s.get("t", "k1") == {"a": b"1", "b": b"0"} and s.get("t", "k2") == {"z": b"3", "y": b"4"} and s.get("t", "new", "c") == b"2"
    assert before.count() == 20 and s.count("t") == 21
    version = s._version("t")
    s.compact("t")
    assert s._version("t").deltas == () and s.get("t", "k2") == {"z": b"3", "y": b"4"} and s.count("t") == 21 and before.count() == 20
    assert not s._commit("t", version)  # its number is taken, as by another writer
    taken = s._version
    once = iter([version])
    monkeypatch.setattr(s, "_version", lambda name: next(once, None) or taken(name))
    s.put("t", rows(spark, {"k3": {"a": b"5"}}))  # began with an old version
    monkeypatch.undo()
    assert s.get("t", "k3") == {"a": b"5", "b": b"0"} and s.get("t", "k2") == {"z": b"3", "y": b"4"}
    monkeypatch.setattr(K, "DELTAS", 2)
    for i in range(6):
        s.put("t", rows(spark, {"k4": {f"c{i}": b"x"}}))
    assert len(s._manifests("t")) <= K.VERSIONS + 2 and len(s.get("t", "k4")) == 8
    page, after, total = s.page("t", "k18", 2)
    assert [r.key for r in page] == ["k18", "k19"] and after == "k2" and total == 21 and s.page("t", "zz")[1] is None


def test_row_files_of_all_names(spark, tmp_path):
    keys = ["_hidden", ".dot", "a/b", "é!", "plain", "a long key with blanks".replace(" ", "_"), "_"]
    data = {k: {"c": k.encode(), "d": b"1 2 3"} for k in keys}
    assert R.write_row_files(rows(spark, data), str(tmp_path / "t")) == len(keys)
    found = {r.key: {c: bytes(v) for c, v in r.cols.items()} for r in R.read_row_files(spark, str(tmp_path / "t")).collect()}
    assert found == data
    assert [r.key for r in R.row_paths(spark, str(tmp_path / "t")).collect()] == sorted(keys)
    assert R.file_of("ab") == "ab" and R.file_of("abcdef") == "__ab/abcdef"
