"""A keyed row store on Parquet: rows of a key and named cells.

A table is a folder.  Its rows, ``key string, cols map<string, binary>`` as
columns differ by row, lie in a base, Parquet files that are ranges of keys and
sorted by key, so that a look-up or a range reads few row groups; upserts add
small Parquet deltas, which a read merges in order, and once there are
:data:`DELTAS` of them the base is written anew.  Numbered manifests name the
base and deltas of each version.  A manifest is made only if there is none of
its number, so of two writers one comes second and takes the next number, and
neither update is lost.  Files of the last :data:`VERSIONS` versions stay, so a
DataFrame read from one of them goes on working.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, cols map<string,binary>"
#: Deltas after which the base is written anew; versions whose files are kept.
DELTAS, VERSIONS = 8, 4


def merge_cells(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells of ``delta`` that are not null put over those of ``base``; other cells stay."""
    new = delta.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    both = base.join(new, key, "full_outer")
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def replace_rows(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``delta`` in place of those of equal key in ``base``."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def key_range(df: DataFrame, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with ``start <= key < end``; null bounds are open."""
    rows = df if start is None else df.where(F.col(key) >= start)
    return rows if end is None else rows.where(F.col(key) < end)


def key_ranges(ids: list[str]) -> list[tuple[str | None, str | None]]:
    """Disjoint ranges that cover all keys, cut at ``ids``."""
    cuts = [None, *sorted(set(ids)), None]
    return list(zip(cuts, cuts[1:]))


def page_view(df: DataFrame, key: str, start: str | None = None, size: int = 10) -> DataFrame:
    """The ``size`` rows from ``start`` on in order of the key."""
    return key_range(df, key, start).orderBy(key).limit(size)


def row_digest(columns: list[str]) -> Column:
    """Digest of a row's named cells; null cells count as missing."""
    cells = [F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.sha1(F.concat_ws("&", *cells))


def to_repair(mine: DataFrame, theirs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose row is missing here or differs from the other copy's: ``key, reason``."""
    own = mine.select(F.col(key), row_digest(columns).alias("_mine"))
    other = theirs.select(F.col(key), row_digest(columns).alias("_theirs"))
    both = other.join(own, key, "left")
    reason = F.when(F.col("_mine").isNull(), "missing").when(F.col("_mine") != F.col("_theirs"), "differs")
    return both.select(key, reason.alias("reason")).where("reason is not null")


class Version(NamedTuple):
    """What a manifest says: its number, the base's folder (None for none) and the deltas' as (folder, whole rows), oldest first."""

    number: int
    base: str | None
    deltas: tuple[tuple[str, bool], ...]


class KvStore:
    """Tables under a folder; see the module's description."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self, name: str) -> list[str]:
        return [n for n in self._names(name) if n.startswith("_m-")]

    def _manifest(self, name: str, file: str) -> Version:
        stream = self._fs.open(self._path(name, file))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(int(file[3:]), found["base"], tuple((d, w) for d, w in found["deltas"]))

    def _version(self, name: str) -> Version | None:
        files = self._manifests(name)
        return self._manifest(name, files[-1]) if files else None

    def _commit(self, name: str, version: Version) -> bool:
        """Make a version the current one; False when its number is taken."""
        try:
            stream = self._fs.create(self._path(name, f"_m-{version.number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps({"base": version.base, "deltas": version.deltas}).encode()))
        finally:
            stream.close()
        return True

    def _sweep(self, name: str) -> None:
        """Remove manifests and files that none of the last versions names."""
        files = self._manifests(name)
        old, kept = files[:-VERSIONS], [self._manifest(name, f) for f in files[-VERSIONS:]]
        named = {v.base for v in kept} | {d for v in kept for d, _ in v.deltas}
        for file in old:
            gone = self._manifest(name, file)
            for folder in {gone.base, *(d for d, _ in gone.deltas)} - named - {None}:
                self._fs.delete(self._path(name, folder), True)
            self._fs.delete(self._path(name, file), False)

    def _written(self, name: str, rows: DataFrame, kind: str) -> str:
        """Write rows, ranged and sorted by key; their folder.  Rows with a null or empty key are refused."""
        key = F.when(F.coalesce(F.col("key"), F.lit("")) == "", F.raise_error(F.lit("empty key"))).otherwise(F.col("key"))
        folder = f"{kind}-{uuid.uuid4().hex}"
        checked = rows.select(key.cast("string").alias("key"), "cols")
        checked.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.folder}/{name}/{folder}")
        return folder

    def tables(self) -> list[str]:
        """Names of all tables, sorted."""
        return [n for n in self._names() if self._manifests(n)]

    def read(self, name: str) -> DataFrame:
        """All rows; a table that does not exist has none."""
        version = self._version(name)
        return self.spark.createDataFrame([], SCHEMA) if version is None else self._rows(name, version)

    def _rows(self, name: str, version: Version) -> DataFrame:
        parts = [(version.base, True)] if version.base else []
        parts += version.deltas
        read = lambda folder: self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{name}/{folder}")
        if len(parts) == 1:
            return read(parts[0][0])
        rows = None
        for at, (folder, whole) in enumerate(parts):
            own = read(folder).select("key", F.struct(F.lit(at).alias("at"), F.lit(whole).alias("whole"), "cols").alias("part"))
            rows = own if rows is None else rows.union(own)
        # a key has a row in each part at most, so as many as there are parts
        merged = F.aggregate(
            F.array_sort("parts", lambda a, b: a["at"] - b["at"]),
            F.create_map().cast("map<string,binary>"),
            lambda cells, part: F.when(part["whole"], part["cols"]).otherwise(
                F.map_concat(F.map_filter(cells, lambda k, _: ~F.map_contains_key(part["cols"], k)), part["cols"])
            ),
        )
        return rows.groupBy("key").agg(F.collect_list("part").alias("parts")).select("key", merged.alias("cols"))

    def write(self, name: str, rows: DataFrame) -> None:
        """Make ``rows`` the table's new version; rows with a null or empty key are refused."""
        folder = self._written(name, rows, "base")
        while True:
            version = self._version(name)
            if self._commit(name, Version(version.number + 1 if version else 1, folder, ())):
                break
        self._sweep(name)

    def _add(self, name: str, delta: DataFrame, whole: bool) -> None:
        folder = self._written(name, delta, "delta")
        while True:
            version = self._version(name) or Version(0, None, ())
            new = Version(version.number + 1, version.base, (*version.deltas, (folder, whole)))
            if self._commit(name, new):
                break
        if len(new.deltas) >= DELTAS:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Write the base anew with all deltas in it; what was added meanwhile stays a delta."""
        version = self._version(name)
        if version is None or not version.deltas:
            return
        folder = self._written(name, self._rows(name, version), "base")
        while True:
            now = self._version(name)
            if now.base != version.base or now.deltas[: len(version.deltas)] != version.deltas:
                self._fs.delete(self._path(name, folder), True)  # another writer was first
                return
            if self._commit(name, Version(now.number + 1, folder, now.deltas[len(version.deltas) :])):
                break
        self._sweep(name)

    def put(self, name: str, delta: DataFrame) -> None:
        """Upsert of cells, one row a key: those of ``delta`` are put over a row's others."""
        none = F.create_map().cast("map<string,binary>")
        self._add(name, delta.select("key", F.coalesce("cols", none).alias("cols")), False)

    def put_rows(self, name: str, delta: DataFrame) -> None:
        """Upsert of whole rows, one a key."""
        self._add(name, delta.select("key", "cols"), True)

    def get(self, name: str, key: str, column: str | None = None):
        """A row's cells as a dict, or one cell; None when missing."""
        row = self.read(name).where(F.col("key") == key).first()
        if row is None:
            return None
        cells = {k: bytes(v) for k, v in (row.cols or {}).items()}
        return cells if column is None else cells.get(column)

    def exists(self, name: str, key: str) -> bool:
        """True when there is a row of that key."""
        return not self.read(name).where(F.col("key") == key).isEmpty()

    def scan(self, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows with ``start <= key < end`` in order of the key."""
        return key_range(self.read(name), "key", start, end).orderBy("key")

    def page(self, name: str, start: str | None = None, size: int = 10) -> tuple[list, str | None, int]:
        """``size`` rows from ``start`` on, the key at which the next page starts (None for none), and the number of all rows."""
        rows = page_view(self.read(name), "key", start, size + 1).collect()
        return rows[:size], rows[size].key if len(rows) > size else None, self.count(name)

    def count(self, name: str) -> int:
        """Number of rows."""
        return self.read(name).count()

    def rename(self, old: str, new: str) -> bool:
        """Rename a table; False when there is none or the new name is taken."""
        if self._version(old) is None or self._version(new) is not None:
            return False
        return bool(self._fs.rename(self._path(old), self._path(new)))

    def drop(self, name: str) -> None:
        """Remove a table, if there is one."""
        self._fs.delete(self._path(name), True)
