import numpy as np
import pyarrow as pa

from weftlake.llm import p1_forest as P


def expected(key, rest, ids):
    """Regions by plain recursion over prefixes."""
    out = set()

    def split(rows, depth):
        if len(rows) > P.REGION and depth < P.DEEPER:
            groups = {}
            for r in rows:
                groups.setdefault(int(P._prefix(rest[r : r + 1], depth + 1)[0]), []).append(r)
            for g in groups.values():
                split(g, depth + 1)
            return
        out.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for n, i in enumerate(rows) for j in rows[n + 1 :] if ids[i] != ids[j])

    for k in np.unique(key):
        split(np.flatnonzero(key == k).tolist(), 0)
    return out


def entries(seed, n=3000, keys=5):
    rng = np.random.default_rng(seed)
    key = rng.choice([-7, 3, 9, 11, 12], n, p=[0.6, 0.2, 0.1, 0.05, 0.05])
    parts = [rng.choice(size, n, p=np.arange(size, 0, -1) / np.arange(size, 0, -1).sum()) for size in (3, 4, 6, 9)]
    rest = np.zeros(n, np.int64)
    for p in parts:
        rest = (rest << 16) | (p * 9000)
    ids = rng.integers(0, 2000, n)
    order = np.lexsort((ids, rest, key))
    return key[order].astype(np.int64), rest[order], ids[order].astype(np.int64)


def run(key, rest, ids, size, most):
    batches = (
        pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in (key, rest, ids)], ["key", "rest", "id"])
        for i in range(0, len(key), size)
    )
    return {pair for b in P._candidates(batches, most) for pair in zip(*(c.to_pylist() for c in b.columns))}


def test_batches_and_cuts_change_no_region():
    for seed in range(3):
        key, rest, ids = entries(seed)
        want = expected(key, rest, ids)
        for size, most in ((5000, 10**6), (37, 10**6), (50, 100), (500, 200)):
            assert run(key, rest, ids, size, most) == want


def test_no_entries():
    assert list(P._candidates(iter(()))) == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:450], rng.integers(0, 1 << 63, 150, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((P.signature(a) == P.signature(b)).mean() - true) < 0.15
    assert len(P.shingles("one two", 3, {})) == 0 and len(P.shingles("one Two three, one two THREE", 3, {})) == 3


def versions(n, shared, own, seed=0):
    """Sets with ``shared`` hashes in common and ``own`` of their own: all pairs are as similar."""
    rng = np.random.default_rng(seed)
    core = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
    return [np.unique(np.concatenate([core, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(n)]


def classes(spark, sets):
    rows = [(i, f"u{i}", i, 0, bytearray(h.astype("<u8").tobytes()), bytearray(P.signature(h).tobytes())) for i, h in enumerate(sets)]
    return spark.createDataFrame(rows, "crawl_id bigint, url string, hi bigint, lo bigint, words binary, signs binary")


def test_many_versions_of_one_article(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 50, raising=False)
    n = 500
    pairs = [tuple(r) for r in P.similar_classes(classes(spark, versions(n, 90, 30)))[1].collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert len(pairs) >= 0.99 * n * (n - 1) / 2


def test_crowded_regions_go_whole(monkeypatch):
    key, rest, ids = entries(0)
    monkeypatch.setattr(P, "REGION", 400)
    sizes = dict(zip(*(x.tolist() for x in np.unique(key, return_counts=True))))
    sparse = np.isin(key, [k for k, n in sizes.items() if n <= P.REGION])
    want = expected(key[sparse], rest[sparse], ids[sparse])
    rows = sorted(zip(key[~sparse].tolist(), ids[~sparse].tolist()))
    for size, most in ((5000, 10**6), (37, 10**6), (50, 100), (500, 200)):
        batches = (
            pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in (key, rest, ids)], ["key", "rest", "id"])
            for i in range(0, len(key), size)
        )
        found = [r for b in P._regions(batches, most) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in found if r["key"] is None} == want
        assert sorted((r["key"], r["a"]) for r in found if r["key"] is not None) == rows


def test_copies_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(P, "COPIES", 7)
    rows = [(i, f"u{i % 50}", 0) for i in range(100)] + [(200, "a", 200), (201, "b", 200), (202, "b", 200), (203, "c", 203)]
    got = [tuple(r) for r in P.copy_pairs(spark.createDataFrame(rows, "crawl_id bigint, url string, id bigint")).collect()]
    want = {(a, b) for a, u, i in rows for b, v, j in rows if a < b and u != v and i == j}
    assert len(got) == len(set(got)) and set(got) == want
    assert P.copy_pairs(spark.createDataFrame([], "crawl_id bigint, url string, id bigint")).count() == 0
