"""p1: pages that tell the same article with small edits, by an LSH forest.

The main bodies (p2) of all pages, p7's pages excepted, become sets of three
consecutive words.  Equal sets form one class, so copies cost nothing further.
Each class gets a pool of minhash values; every tree of the forest orders the
classes by a sequence of them.  In that order, classes that share a prefix are
neighbours: a region is a run of classes with a common first prefix, and all
its pairs are candidates, however large it is.  Small regions are paired where
they are sorted.  Crowded ones, as many versions of one article make, are dealt
into chunks, any two of which meet in a task of their own; a pair comes out of
the first tree only that it shares a prefix in.  Candidates pass a sketch
estimate with a wide margin and are then verified exactly on their word sets.

Rows with null ``crawl_id``, ``url`` or ``page``, pages without main body or
with fewer than three words in it take no part.  A row repeated in full pairs
with others once only.  Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_by_key
from ..session import cut_lineage, ship_package
from ..sources.tables import table
from .mainbody import main_blocks
from .scan import map_batches, parsed

#: Consecutive words of a shingle, and the least similarity of a pair.
WORDS, SIMILARITY = 3, 0.5
#: Minhash values of a class; trees; values in a tree's first prefix and beyond it.
POOL, TREES, PREFIX, DEEPER = 128, 64, 4, 4
#: A region of more classes than this is crowded and paired chunk by chunk.
REGION = 64
#: Classes of a chunk of a crowded region, on average.
CHUNK = 1000
#: Members of a chunk of a class of equal pages, on average.
COPIES = 1000
#: Entries of one key that a task holds before it cuts them at a longer prefix.
HELD = 1_000_000
#: Values compared by the sketch, and the agreement a candidate must reach: the
#: bound less more than three standard deviations of the estimate.
SKETCH, AGREEMENT = 64, SIMILARITY - 0.2
#: Classes whose ids may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, POOL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, POOL, dtype=np.uint64)
_ORDERS = np.stack([_RNG.permutation(POOL)[: PREFIX + DEEPER] for _ in range(TREES)])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int, ids: dict[str, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` words of a text; ``ids`` keeps word hashes."""
    found = []
    for w in _WORD.findall(text.lower()):
        n = ids.get(w)
        if n is None:
            n = ids[w] = xxhash.xxh3_64_intdigest(w)
        found.append(n)
    n = len(found) - words + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = np.array(found, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h = _mixed(h * _MIX[0] + x[i : n + i])
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The pool of minhash values of a set of hashes, 16 bits of each."""
    values = np.empty(POOL, np.uint64)
    values[:] = np.iinfo(np.uint64).max
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096, None] * _A + _B
        np.minimum(values, part.min(axis=0), out=values)
    return (_mixed(values) >> np.uint64(48)).astype("<u2")


def _bodies(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, pages = parsed(batch)
    kept = main_blocks(pages)
    ids: dict[str, int] = {}
    rows, hi, lo, sets, signs = [], [], [], [], []
    for i, (blocks, numbers) in enumerate(zip(pages, kept)):
        h = shingles(" ".join(blocks[k].text for k in numbers), WORDS, ids) if len(numbers) else ()
        if len(h):
            rows.append(i)
            digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), ">i8")
            hi.append(digest[0])
            lo.append(digest[1])
            sets.append(h.astype("<u8").tobytes())
            signs.append(signature(h).tobytes())
    chosen = batch.select(["crawl_id", "url"]).take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            *chosen.columns,
            pa.array(hi, pa.int64()),
            pa.array(lo, pa.int64()),
            pa.array(sets, pa.binary()),
            pa.array(signs, pa.binary()),
        ],
        ["crawl_id", "url", "hi", "lo", "words", "signs"],
    )


def page_sets(crawl: DataFrame) -> DataFrame:
    """Word sets of main bodies: ``crawl_id, url, hi, lo`` (the set's hash), ``words``, ``signs``."""
    named = crawl.where("crawl_id is not null and url is not null")
    return map_batches(
        named,
        ["crawl_id", "url", "page"],
        _bodies,
        "crawl_id bigint, url string, hi bigint, lo bigint, words binary, signs binary",
    )


def _tree_keys(signs: np.ndarray) -> np.ndarray:
    """Hashes of the first prefixes in each tree, one row for each row of ``signs``."""
    key = np.empty((len(signs), TREES), np.uint64)
    for t, order in enumerate(_ORDERS):
        h = np.full(len(signs), t + 1, np.uint64)
        for j in order[:PREFIX]:
            h = _mixed(h * _MIX[0] + signs[:, j].astype(np.uint64))
        key[:, t] = h
    return key


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            n = batch.num_rows
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), "<u2").reshape(n, POOL)
            key = _tree_keys(signs)
            rest = np.zeros((n, TREES), np.uint64)
            for t, order in enumerate(_ORDERS):
                for j in order[PREFIX:]:
                    rest[:, t] = rest[:, t] << np.uint64(16) | signs[:, j].astype(np.uint64)
            ids = np.repeat(batch.column("id").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)), pa.array(ids)],
                ["key", "rest", "id"],
            )


def _prefix(rest: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` of the values packed in ``rest``, in the order of ``rest``."""
    return rest >> np.int64(16 * (DEEPER - depth)) if depth else np.zeros(len(rest), np.int64)


def region_pairs(
    key: np.ndarray, rest: np.ndarray, ids: np.ndarray, least: np.ndarray | int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each region of a run of entries sorted by ``(key, rest)``, in slices.

    ``least`` is how many further values the prefix of an entry's region must have.
    """
    n = len(key)
    end = np.zeros(n, np.int64)
    settled = np.zeros(n, bool)
    for depth in range(DEEPER + 1):
        deep = _prefix(rest, depth)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (deep[1:] != deep[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        size = np.bincount(first, minlength=n)[first]
        now = ~settled & (depth >= least) & ((size <= REGION) | (depth == DEEPER))
        end[now] = (first + size)[now]
        settled |= now
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < end[at]]
        if not len(at):
            break
        a, b = ids[at], ids[at + step]
        differ = a != b
        yield np.minimum(a, b)[differ], np.maximum(a, b)[differ]


def _cut(key: np.ndarray, rest: np.ndarray, most: int) -> tuple[int, int]:
    """Where held entries may be cut, so that no region lies on both sides, and by how long a prefix.

    That is before the last key.  Of a key with ``most`` entries, more than a
    region takes, it is before the last change of a longer prefix.
    """
    if not len(key):
        return 0, 0
    at = int(np.searchsorted(key, key[-1]))
    if at or len(key) < most:
        return at, 0
    for depth in range(1, DEEPER + 1):
        deep = _prefix(rest, depth)
        at = int(np.searchsorted(deep, deep[-1]))
        if at:
            return at, depth
    return 0, 0


def _candidates(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted entries; only what the last region may still need is held between batches."""
    cuts: list[tuple[int, int, int]] = []  # key, rest and depth of cuts within the first key held

    def pairs(entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, rest, _ = entries
        least = np.zeros(len(key), np.int64)
        for k, r, depth in cuts:  # groups that were cut are too large for a region
            for d in range(depth):
                same = (key == k) & (_prefix(rest, d) == _prefix(np.array([r]), d)[0])
                least[same] = np.maximum(least[same], d + 1)
        for a, b in region_pairs(*entries, least):
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["a", "b"]
                )

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
        at, depth = _cut(held[0], held[1], most)
        if at:
            if depth:
                cuts.append((int(held[0][-1]), int(held[1][-1]), depth))
            yield from pairs([h[:at] for h in held])
            held = [h[at:] for h in held]
            cuts = [c for c in cuts if c[0] == held[0][0]]
    yield from pairs(held)


def _regions(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """``a, b`` of pairs of small regions, and ``a, key`` of entries of crowded ones, of sorted entries.

    Of a key whose entries have not ended, ``most`` are held, which is more than a small region has.
    """
    crowded: list[pa.RecordBatch] = []

    def sparse() -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        known = None  # a crowded key of which entries were passed on

        def routed(entries: list[np.ndarray]) -> pa.RecordBatch:
            _, number, sizes = np.unique(entries[0], return_inverse=True, return_counts=True)
            many = (sizes > REGION)[number] | (False if known is None else entries[0] == known)
            key, ids = entries[0][many], entries[2][many]
            for i in range(0, len(key), 100_000):
                crowded.append(_rows(ids[i : i + 100_000], None, key[i : i + 100_000]))
            return pa.RecordBatch.from_arrays([pa.array(c[~many]) for c in entries], ["key", "rest", "id"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            last = held[0][-1]
            at = int(np.searchsorted(held[0], last))
            if len(held[0]) - at > max(most, REGION):
                yield routed(held)
                held, known = [h[:0] for h in held], last
            elif at:
                yield routed([h[:at] for h in held])
                held = [h[at:] for h in held]
        if len(held[0]):
            yield routed(held)

    for pairs in _candidates(sparse()):
        yield from crowded
        crowded.clear()
        yield _rows(pairs.column("a"), pairs.column("b"), None)
    yield from crowded


def _rows(a, b, key) -> pa.RecordBatch:
    columns = [pa.nulls(len(a), pa.int64()) if c is None else c if isinstance(c, pa.Array) else pa.array(c) for c in (a, b, key)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "key"])


def _chunk_pairs(rows: pa.Table) -> pa.Table:
    """Pairs of two chunks of a crowded region (or of one) that the sketch lets pass and no earlier tree has."""
    key, x, y = (rows.column(c)[0].as_py() for c in ("key", "x", "y"))
    ids, chunk = rows.column("id").to_numpy(), rows.column("chunk").to_numpy()
    signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), "<u2").reshape(-1, POOL)
    sketch, keys = (signs[:, :SKETCH] & 0xFF).astype(np.uint8), _tree_keys(signs)
    tree = int(np.flatnonzero(keys[0].view(np.int64) == key)[0])
    left, right = np.flatnonzero(chunk == x), np.flatnonzero(chunk == y)
    found = []
    for n, i in enumerate(left):
        others = right[n + 1 :] if x == y else right
        others = others[(sketch[others] == sketch[i]).mean(axis=1) >= AGREEMENT]
        others = others[~(keys[others, :tree] == keys[i, :tree]).any(axis=1)]
        found.append(np.stack([np.minimum(ids[i], ids[others]), np.maximum(ids[i], ids[others])]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crowded_pairs(crowded: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of crowded regions, given as ``(key, id)``, that pass the sketch of ``signs (id, signs)``."""
    parts = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    chunk = F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = crowded.join(parts, "key").withColumn("chunk", chunk)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    met = dealt.select("key", "id", "chunk", other.alias("other")).select(
        "key", "id", "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y")
    )
    return met.join(signs, "id").groupBy("key", "x", "y").applyInArrow(_chunk_pairs, "a bigint, b bigint")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sa", "sb")
        )
        close = (left == right).mean(axis=1) >= AGREEMENT
        yield batch.select(["a", "b"]).filter(pa.array(close))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        close = []
        for a, b in zip(batch.column("wa"), batch.column("wb")):
            x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            close.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))


def similar_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(crawl_id, url, id)`` of the classes and the pairs ``(a, b)`` of similar classes.

    A class's ``id`` is its least ``crawl_id``.
    """
    ship_package(sets.sparkSession)
    ids = sets.groupBy("hi", "lo").agg(F.min("crawl_id").alias("id"))
    members = cut_lineage(sets.select("crawl_id", "url", "hi", "lo").join(ids, ["hi", "lo"]).drop("hi", "lo"))
    classes = members.where("crawl_id = id").select("id").distinct()
    chosen = sets.join(classes, sets.crawl_id == classes.id, "left_semi").dropDuplicates(["crawl_id"])
    signs = cut_lineage(chosen.select(F.col("crawl_id").alias("id"), "signs"))
    regions = (
        signs.mapInArrow(_entries, "key bigint, rest bigint, id bigint")
        .repartition("key")
        .sortWithinPartitions("key", "rest", "id")
        .mapInArrow(_regions, "a bigint, b bigint, key bigint")
        .distinct()
    )
    regions = cut_lineage(regions)  # read twice below
    candidates = regions.where("key is null").select("a", "b")
    crowded = regions.where("key is not null").select("key", F.col("a").alias("id"))
    low = signs.select("id", _low_bytes("signs").alias("sketch"))
    near = (
        candidates.join(low.toDF("a", "sa"), "a")
        .join(low.toDF("b", "sb"), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_alike, "a bigint, b bigint")
    )
    near = cut_lineage(near.union(crowded_pairs(crowded, signs)).distinct())
    named = near.select(F.explode(F.array("a", "b")).alias("crawl_id")).distinct()
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    texts = sets.select("crawl_id", "words").join(named, "crawl_id", "left_semi").dropDuplicates(["crawl_id"])
    pairs = (
        near.join(texts.toDF("a", "wa"), "a")
        .join(texts.toDF("b", "wb"), "b")
        .select("a", "b", "wa", "wb")
        .mapInArrow(_verified, "a bigint, b bigint")
    )
    return members, pairs


def _low_bytes(column: str):
    """Low bytes of the first SKETCH 16-bit values of a binary column."""
    even = [F.substring(column, 2 * i + 1, 1) for i in range(SKETCH)]
    return F.concat(*even)


def copy_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``crawl_a, crawl_b`` of members ``(crawl_id, url, id)`` of one class with different urls.

    A class is dealt into chunks of about COPIES members, any two of which meet
    under a key of their own, so that no task has all pairs of a large class.
    """
    sizes = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    named = join_by_key(members, sizes.select("id", F.ceil(F.col("n") / COPIES).alias("parts")), sizes, "id")
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("crawl_id"), F.col("parts")))
    upwards = F.explode(F.sequence("chunk", F.col("parts") - 1)).alias("y")
    downwards = F.explode(F.sequence(F.lit(0).cast("bigint"), "chunk")).alias("x")
    one = dealt.select("id", F.col("chunk").alias("x"), upwards, F.col("crawl_id").alias("crawl_a"), F.col("url").alias("url_a"))
    two = dealt.select("id", downwards, F.col("chunk").alias("y"), F.col("crawl_id").alias("crawl_b"), F.col("url").alias("url_b"))
    met = one.join(two, ["id", "x", "y"]).where("url_a <> url_b and (x < y or crawl_a < crawl_b) and crawl_a <> crawl_b")
    return met.select(F.least("crawl_a", "crawl_b").alias("crawl_a"), F.greatest("crawl_a", "crawl_b").alias("crawl_b"))


def similar_pages(crawl: DataFrame) -> DataFrame:
    """Pairs of rows with different urls and similar main bodies: ``crawl_a < crawl_b``."""
    sets = cut_lineage(page_sets(crawl))
    members, pairs = similar_classes(sets)
    pairs = cut_lineage(pairs)
    one = members.toDF("crawl_a", "url_a", "a")
    two = members.toDF("crawl_b", "url_b", "b")
    copies = copy_pairs(members)
    edited = pairs.join(one, "a").join(two, "b").where("url_a <> url_b and crawl_a <> crawl_b")
    return (
        copies.select("crawl_a", "crawl_b")
        .union(
            edited.select(F.least("crawl_a", "crawl_b").alias("crawl_a"), F.greatest("crawl_a", "crawl_b").alias("crawl_b"))
        )
        .distinct()
    )


def p1_found(spark, sf):
    return similar_pages(table(spark, sf, "pt_crawl"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
