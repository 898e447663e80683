"""Reader for row files: one row in each file, a key and length-prefixed cells.

A file holds ``key SP`` and then for each cell ``name SP length SP bytes SP``.
File names spell the key: every character outside letters, digits and ``-`` as
``_`` and its code in hex.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

_KEPT = re.compile(r"[A-Za-z0-9-]")


def encode_key(key: str) -> str:
    """File name of a key."""
    return "".join(c if _KEPT.match(c) else f"_{ord(c):02x}" for c in key)


def decode_key(name: str) -> str:
    """Key of a file name; characters above U+00FF do not survive the way there and back."""
    return re.sub("_([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), name)


def parse_row(raw: bytes) -> tuple[str, dict[str, bytes]] | None:
    """Key and cells of a file; a cut-off last cell is left out, None without a key."""
    key, space, rest = raw.partition(b" ")
    if not space or not key:
        return None
    cells: dict[str, bytes] = {}
    while True:
        head = rest.split(b" ", 2)
        if len(head) < 3 or not head[1].isdigit():
            break
        size = int(head[1])
        if len(head[2]) < size:
            break
        cells[head[0].decode()] = head[2][:size]
        rest = head[2][size + 1 :]
    return key.decode(), cells


def serialize_row(key: str, cells: dict[str, bytes]) -> bytes:
    """The file content of a row."""
    return key.encode() + b" " + b"".join(b"%s %d %s " % (n.encode(), len(v), v) for n, v in cells.items())


#: Keys whose file name is at least so long go into the sub-folder of its first two characters.
FOLDER_FROM = 6


def file_of(key: str) -> str:
    """Path of a key's file below its table's folder."""
    name = encode_key(key)
    return f"__{name[:2]}/{name}" if len(name) >= FOLDER_FROM else name


def row_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder and its sub-folders ``__xy``, hidden ones included, in order of their keys: ``key string, path string``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if s.isFile():
            found.append((decode_key(name), s.getPath().toString()))
        elif name.startswith("__"):
            found += [(decode_key(f.getPath().getName()), f.getPath().toString()) for f in fs.listStatus(s.getPath()) if f.isFile()]
    paths = spark.createDataFrame(found, "key string, path string")
    return paths.repartitionByRange(max(1, len(found) // 10_000 + 1), "key").sortWithinPartitions("key")


def read_row_files(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a folder and its sub-folders ``__xy``: ``key string, cols map<string, binary>``.

    Files that are no rows are left out.  The driver lists the folders; the
    files, whatever their names, are opened by the tasks, a batch at a time.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                for path in batch.column("path").slice(start, 500).to_pylist():
                    system, name = fs.FileSystem.from_uri(_uri(path))
                    with system.open_input_stream(name) as file:
                        rows.append(parse_row(file.read()))
                rows = [r for r in rows if r]
                cells = pa.array([list(c.items()) for _, c in rows], pa.map_(pa.string(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), cells], ["key", "cols"])

    return row_paths(spark, folder).mapInArrow(run, "key string, cols map<string,binary>")


def _uri(path: str) -> str:
    """A file's path as pyarrow takes it; ``file:/x`` means ``file:///x``."""
    if path.startswith("file:"):
        return "file://" + "/" + path[5:].lstrip("/")
    return path


def write_row_files(rows: DataFrame, folder: str) -> int:
    """Write ``rows (key, cols)`` as row files below ``folder``, each by the task that has it; how many were written."""
    ship_package(rows.sparkSession)
    root = _uri(str(rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/")).makeQualified(*_default(rows.sparkSession)).toString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        written = 0
        for batch in batches:
            for key, cells in zip(batch.column("key").to_pylist(), batch.column("cols").to_pylist()):
                path = f"{base}/{file_of(key)}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as file:
                    file.write(serialize_row(key, dict(cells or ())))
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    counts = rows.where("key <> ''").select("key", "cols").mapInArrow(run, "n bigint")
    return sum(r.n for r in counts.collect())


def _default(spark: SparkSession) -> tuple:
    """The file system that paths without a scheme belong to, and its working folder."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.FileSystem.get(spark._jsc.hadoopConfiguration())
    return fs.getUri(), fs.getWorkingDirectory()
