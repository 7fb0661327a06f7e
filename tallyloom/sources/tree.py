"""File trees: folders are listed by tasks, a level at a time, and left-out folders are never entered; files are opened by path."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.paths import VENDORED, base_name
from tallyloom.functions.scratch import materialize

#: Entries of a batch of a listing, and bytes of file contents in one.
ENTRIES, BATCH_BYTES = 10_000, 16 << 20


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI and the folder's path in it; a local path is taken as it stands."""
    if "://" in root and not root.startswith("file://"):
        return fs.FileSystem.from_uri(root.rstrip("/"))
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file://"))


def list_tree(spark: SparkSession, root: str, skip: tuple = VENDORED, tasks: int | None = None) -> DataFrame:
    """(path below the root, bytes) of the files in all folders but those named in `skip`.

    root: a folder or URI that executors reach (`pyarrow.fs`). A level of the tree is one Spark job, spread by folder; its
    entries are written, so a lost executor repeats only its folders. An empty folder gives nothing, a missing root raises.
    """
    schema = "path string, bytes long, folder boolean"

    def entries(batches):
        files, start = _open(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{start}/{folder}" if folder else start))
                found = [x for x in found if x.type in (fs.FileType.File, fs.FileType.Directory)]
                for i in range(0, len(found), ENTRIES):
                    some = found[i : i + ENTRIES]
                    names = [f"{folder}/{x.base_name}" if folder else x.base_name for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.size or 0 for x in some], pa.int64()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())], ["path", "bytes", "folder"])

    front, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        spread = front.repartition(tasks, "path") if tasks else front.repartition("path")
        level = materialize(spread.mapInArrow(entries, schema))
        here = level.filter("not folder").select("path", "bytes")
        out = here if out is None else out.unionByName(here)
        front = level.filter("folder").select("path")
        if skip:
            front = front.filter(~base_name(F.col("path")).isin(*skip))
        if not front.limit(1).count():
            return out


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files, read by the tasks that hold them. A file that went since it was listed raises."""
    def contents(batches):
        files, start = _open(root)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        for batch in batches:
            names, data, size = [], [], 0
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(f"{start}/{path}", compression=None) as f:
                    data.append(f.read())
                names.append(path)
                size += len(data[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], schema=schema)
                    names, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], schema=schema)

    return listed.select("path").repartition("path").mapInArrow(contents, "path string, content binary")


def write_files(df: DataFrame, root: str) -> None:
    """A file a row of (path, text), below the root, written by the tasks that hold the rows; a repeated task writes the same files again."""
    def put(batches):
        files, start = _open(root)
        for batch in batches:
            for folder in {p.rpartition("/")[0] for p in batch.column("path").to_pylist()}:
                files.create_dir(f"{start}/{folder}", recursive=True)
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                with files.open_output_stream(f"{start}/{path}", compression=None) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    df.select("path", "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()
