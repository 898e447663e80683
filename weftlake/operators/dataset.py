"""Lazy collections of strings and of string pairs over DataFrames.

Functions given to an operator take and give Columns, so that whole chains stay
inside one Catalyst plan.  Code that cannot be written as an expression is
wrapped in :class:`Opaque` and runs in Python over Arrow batches.  Where the
order of elements matters (``take``, folds), a position column is named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

#: Elements of one key that a fold gathers at a time.
FOLD_CHUNK = 10_000
#: Columns of a wide table at most.
MOST_COLUMNS = 2_000
#: Keys of a sample that may be broadcast.
BROADCAST_ROWS = 1_000_000


class Opaque:
    """A Python function of one element (a string, or a pair) for the operators that take functions."""

    def __init__(self, fn: Callable) -> None:
        self.fn = fn


def _mapped(df: DataFrame, work: Callable[[tuple], list[tuple]], names: tuple[str, ...]) -> DataFrame:
    """Rows that ``work`` makes of each row of ``df``, as string columns ``names``."""
    ship_package(df.sparkSession)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in work(row)]
            columns = zip(*rows) if rows else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], list(names))

    return df.mapInArrow(run, schema)


class _Handle:
    """A DataFrame that can be given up; every use after that fails."""

    def __init__(self, df: DataFrame) -> None:
        self._df: DataFrame | None = df

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise RuntimeError("this dataset was destroyed")
        return self._df

    def destroy(self) -> None:
        """Give up the data; later calls raise."""
        self.df.unpersist()
        self._df = None


class Strings(_Handle):
    """A multiset of strings: column ``value``; nulls are no elements."""

    @classmethod
    def parallelize(cls, spark: SparkSession, values: list[str]) -> "Strings":
        """The values of a list."""
        return cls(spark.createDataFrame([(v,) for v in values], "value string").where("value is not null"))

    @classmethod
    def from_table(cls, df: DataFrame, value: Column) -> "Strings":
        """One string for each row of a table; rows where it is null give none."""
        return cls(df.select(value.cast("string").alias("value")).where("value is not null"))

    def count(self) -> int:
        """Number of elements, repeated ones included."""
        return self.df.count()

    def collect(self) -> list[str]:
        """All elements, on the driver."""
        return [r.value for r in self.df.collect()]

    def take(self, n: int, order: str | None = None) -> list[str]:
        """The first ``n`` elements by ``order``, by value without one."""
        rows = self.df.orderBy(order or "value").limit(n)
        return [r.value for r in rows.collect()]

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Write the elements as a Parquet table with a key for each, which tells copies apart."""
        key = F.concat(F.lit("k"), F.monotonically_increasing_id(), F.lit("-"), F.substring(F.sha1("value"), 1, 8))
        self.df.select(key.alias("key"), "value").write.mode(mode).parquet(path)

    def append_text(self, path: str) -> None:
        """Add the elements to a folder of text files, one line each."""
        self.df.select("value").write.mode("append").text(path)

    def spread_over(self, n: int) -> "Strings":
        """The same elements in ``n`` partitions, as many as tasks are to work on them."""
        return Strings(self.df.repartition(n))

    def distinct(self) -> "Strings":
        """Each element once."""
        return Strings(self.df.select("value").distinct())

    def intersection(self, other: "Strings") -> "Strings":
        """Elements of both, each once."""
        return Strings(self.df.select("value").intersect(other.df.select("value")))

    def union(self, other: "Strings") -> "Strings":
        """Elements of both, repeated ones included."""
        return Strings(self.df.select("value").unionByName(other.df.select("value")))

    def sample(self, fraction: float, seed: int | None = None) -> "Strings":
        """Each element with a probability, independent of the others."""
        return Strings(self.df.sample(False, fraction, seed))

    def filter(self, f: Callable[[Column], Column] | Opaque) -> "Strings":
        """Elements for which ``f`` is true."""
        if isinstance(f, Opaque):
            return Strings(_mapped(self.df.select("value"), lambda r, fn=f.fn: [r] if fn(r[0]) else [], ("value",)))
        return Strings(self.df.where(f(F.col("value"))))

    def flat_map(self, f: Callable[[Column], Column] | Opaque) -> "Strings":
        """The strings of the array ``f`` gives for each element; null gives none."""
        if isinstance(f, Opaque):
            out = _mapped(self.df.select("value"), lambda r, fn=f.fn: [(x,) for x in fn(r[0]) or ()], ("value",))
        else:
            out = self.df.select(F.explode(f(F.col("value"))).alias("value"))
        return Strings(out.where("value is not null"))

    def map_to_pair(self, f: Callable[[Column], tuple[Column, Column]] | Opaque) -> "Pairs":
        """The pair ``f`` gives for each element; a null key or result gives none."""
        if isinstance(f, Opaque):
            out = _mapped(self.df.select("value"), lambda r, fn=f.fn: [p] if (p := fn(r[0])) else [], ("key", "value"))
        else:
            key, value = f(F.col("value"))
            out = self.df.select(key.cast("string").alias("key"), value.cast("string").alias("value"))
        return Pairs(out.where("key is not null"))

    def flat_map_to_pair(self, f: Callable[[Column], Column] | Opaque) -> "Pairs":
        """The pairs of the array of structs (key, value) ``f`` gives for each element."""
        if isinstance(f, Opaque):
            out = _mapped(self.df.select("value"), lambda r, fn=f.fn: list(fn(r[0]) or ()), ("key", "value"))
        else:
            out = self.df.select(F.inline(f(F.col("value"))).alias("key", "value"))
        return Pairs(out.where("key is not null"))

    def group_by(self, f: Callable[[Column], Column] | Opaque) -> "Pairs":
        """Elements by ``f``, in order and joined by commas; elements with a null key are left out.

        For groups of any size use :meth:`keyed` and an aggregate instead.
        """
        keyed = self.keyed(f).df
        joined = F.array_join(F.array_sort(F.collect_list("value")), ",")
        return Pairs(keyed.groupBy("key").agg(joined.alias("value")))

    def keyed(self, f: Callable[[Column], Column] | Opaque) -> "Pairs":
        """Pairs of ``f`` and element, no grouping done."""
        if isinstance(f, Opaque):
            return self.map_to_pair(Opaque(lambda v, fn=f.fn: (fn(v), v)))
        return self.map_to_pair(lambda v: (f(v), v))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterator[str]]) -> "Strings":
        """``f`` once over the elements of each partition."""
        ship_package(self.df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[str] = []
            for v in f(x for b in batches for x in b.column(0).to_pylist()):
                out.append(v)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

        return Strings(self.df.select("value").mapInArrow(run, "value string"))

    def fold(self, zero: Column, step: Callable[[Column, Column], Column], order: str, kind: str = "string") -> Column:
        """Left fold by ``order`` (a whole number per element) as a one-row DataFrame ``value``; see :func:`folded`."""
        out = folded(self.df, [], "value", zero, step, order, kind)
        none = out.agg(F.max("value").alias("value"))  # one row, null when there is nothing to fold
        return none.select(F.coalesce("value", zero.cast(kind)).alias("value"))


    def fold_in_order(self, zero: str, step: Opaque, order: str) -> str:
        """Left fold by ``order`` with any step, see :func:`folded_in_order`; ``zero`` when there is nothing to fold."""
        row = folded_in_order(self.df, [], "value", zero, step, order).first()
        return zero if row is None else row.value


def folded_in_order(df: DataFrame, keys: list[str], value: str, zero: str, step: Opaque, order: str) -> DataFrame:
    """Left fold of ``value`` per key in order of ``order`` with any step, a function of two strings.

    Such a fold cannot be taken apart, so a key is one task's work.  It is
    sorted with spilling and read in batches: nothing but the state is held.
    Where the step is associative, :func:`folded` spreads a key over tasks.
    """
    ship_package(df.sparkSession)
    rows = df.select(*(F.col(k).cast("string").alias(k) for k in keys), F.col(value).cast("string").alias("value"), F.col(order).alias("_at"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_at") if keys else rows.orderBy("_at").coalesce(1)
    fn, names = step.fn, [*keys, "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        started = False
        out: list[tuple] = []
        for batch in batches:
            for *own, x in zip(*(batch.column(c).to_pylist() for c in names)):
                if not started or own != key:
                    if started:
                        out.append((*key, state))
                    key, state, started = own, zero, True
                state = fn(state, x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*out)], names)
                out = []
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (*key, state)], names)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return rows.select(*names).mapInArrow(run, schema)


def folded(
    df: DataFrame, keys: list[str], value: str, zero: Column, step: Callable[[Column, Column], Column], order: str,
    kind: str = "string",
) -> DataFrame:
    """Left fold of ``value`` per key in order of ``order``: the keys and ``value``.

    ``step`` must be associative and ``zero`` its neutral element: elements are
    folded by stretches of at most FOLD_CHUNK positions of ``order``, then the
    results by stretches of these, so no task gathers all elements of a key.
    Where a built-in aggregate does the same, that is faster.
    """
    fold = lambda xs: F.aggregate(xs, zero.cast(kind), lambda a, x: step(a, x).cast(kind))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"])
    rows = df.select(*keys, F.col(order).cast("bigint").alias("_at"), F.col(value).cast(kind).alias("value"))
    for _ in range(2):
        stretch = F.floor(F.col("_at") / FOLD_CHUNK)
        rows = rows.groupBy(*keys, stretch.alias("_to")).agg(fold(gathered).alias("value")).withColumnRenamed("_to", "_at")
    return rows.groupBy(*keys).agg(fold(gathered).alias("value"))


class Pairs(_Handle):
    """A multiset of string pairs: columns ``key, value``."""

    @classmethod
    def parallelize(cls, spark: SparkSession, pairs: list[tuple[str, str]]) -> "Pairs":
        """The pairs of a list."""
        return cls(spark.createDataFrame(pairs, "key string, value string"))

    def collect(self) -> list[tuple[str, str]]:
        """All pairs, on the driver."""
        return [(r.key, r.value) for r in self.df.collect()]

    def count(self) -> int:
        """Number of pairs."""
        return self.df.count()

    def flat_map(self, f: Callable[[Column, Column], Column] | Opaque) -> Strings:
        """The strings of the array ``f`` gives for each pair."""
        if isinstance(f, Opaque):
            out = _mapped(self.df.select("key", "value"), lambda r, fn=f.fn: [(x,) for x in fn(*r) or ()], ("value",))
        else:
            out = self.df.select(F.explode(f(F.col("key"), F.col("value"))).alias("value"))
        return Strings(out.where("value is not null"))

    def flat_map_to_pair(self, f: Callable[[Column, Column], Column] | Opaque) -> "Pairs":
        """The pairs of the array of structs (key, value) ``f`` gives for each pair."""
        if isinstance(f, Opaque):
            out = _mapped(self.df.select("key", "value"), lambda r, fn=f.fn: list(fn(*r) or ()), ("key", "value"))
        else:
            out = self.df.select(F.inline(f(F.col("key"), F.col("value"))).alias("key", "value"))
        return Pairs(out.where("key is not null"))

    def fold_by_key(
        self, zero: Column, step: Callable[[Column, Column], Column], order: str, kind: str = "string"
    ) -> "Pairs":
        """Left fold of each key's values by ``order``; see :func:`folded`."""
        return Pairs(folded(self.df, ["key"], "value", zero, step, order, kind))

    def fold_by_key_in_order(self, zero: str, step: Opaque, order: str) -> "Pairs":
        """Left fold of each key's values by ``order`` with any step; see :func:`folded_in_order`."""
        return Pairs(folded_in_order(self.df, ["key"], "value", zero, step, order))

    def aggregate_by_key(self, **aggregates: Column) -> DataFrame:
        """Built-in aggregates per key, folded on the map side first."""
        return self.df.groupBy("key").agg(*(c.alias(n) for n, c in aggregates.items()))

    def join(self, other: "Pairs") -> "Pairs":
        """All combinations of values of equal keys, joined by a comma."""
        right = other.df.select("key", F.col("value").alias("_right"))
        return Pairs(self.df.join(right, "key").select("key", F.concat_ws(",", "value", "_right").alias("value")))

    def cogroup(self, other: "Pairs") -> "Pairs":
        """Each key of either side with the sorted values of both: ``[a,b],[c]``."""
        listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.col("value"))))
        both = self.df.select("key", "value", F.lit(0).alias("_side")).union(
            other.df.select("key", "value", F.lit(1).alias("_side"))
        )
        text = F.concat(F.lit("["), F.array_join(listed(0), ","), F.lit("],["), F.array_join(listed(1), ","), F.lit("]"))
        return Pairs(both.groupBy("key").agg(text.alias("value")))

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Write the pairs as a Parquet table."""
        self.df.select("key", "value").write.mode(mode).parquet(path)

    def wide(self, columns: int | None = None, more: str | None = None) -> DataFrame:
        """One row per key with all its values, in order, as ``v0, v1, …``.

        There are as many columns as the longest key has values, or
        ``columns``, and then the values beyond them go into the array column
        ``more``.  Without a place for a key's values it fails.
        """
        counts = self.df.groupBy("key").agg(F.count("value").alias("n"))
        longest = counts.agg(F.max("n")).first()[0] or 0 if columns is None or more is None else 0
        width = longest if columns is None else columns
        if more is None and longest > width or width > MOST_COLUMNS:
            raise ValueError(f"a key has {max(longest, width)} values: name a column for those beyond {min(width, MOST_COLUMNS)}")
        rows = self.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("_all"))
        rest = [F.slice("_all", width + 1, F.size("_all")).alias(more)] if more else []
        return rows.select("key", *(F.get("_all", F.lit(i)).alias(f"v{i}") for i in range(width)), *rest)


class Output:
    """Lines a job writes for its caller."""

    EMPTY = "no output"

    def __init__(self) -> None:
        self.lines: list[str] = []

    def write(self, line: str) -> None:
        """Add a line."""
        self.lines.append(line)

    def text(self) -> str:
        """All lines, or a default when there are none."""
        return "\n".join(self.lines) or self.EMPTY


def systematic_sample(df: DataFrame, order: str, size: int) -> DataFrame:
    """Every so many-th row by the unique column ``order``, ``size`` rows at most; all rows for a size of 0 or of all rows.

    Only that column is sorted.  Its values are numbered by range partitions:
    counts per partition give each partition's first number, so no task sees
    them all.
    """
    total = df.count()
    if size <= 0 or size >= total:
        return df
    step = max(1, total // size)
    part, index = F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")
    keys = cut_lineage(df.select(order).repartitionByRange(F.col(order)).sortWithinPartitions(order).select(order, part, index))
    starts, n = [], 0
    for p, rows in sorted((r["_p"], r["count"]) for r in keys.groupBy("_p").count().collect()):
        starts.append((p, n))
        n += rows
    first = df.sparkSession.createDataFrame(starts, "_p int, _first bigint")
    number = F.col("_first") + F.col("_i")
    chosen = keys.join(F.broadcast(first), "_p").where((number % step == 0) & (number < F.lit(step) * size)).select(order)
    return df.join(F.broadcast(chosen) if size <= BROADCAST_ROWS else chosen, order, "left_semi")
