"""Arrays of vectors in NumPy's file format as a Spark data source, read by ranges of rows and written in two phases.

`spark.read.format("arrays").load(folder or file.npy)` gives index and vector.  A folder has a manifest with its files in order; a file that
other software made is read as it is.  Files are memory images, so a partition of `rows` rows (an option, 65,536 by default) reads just its
bytes by offset.  Writing takes index and vector, with rows in order inside partitions that do not overlap
(`repartitionByRange("index").sortWithinPartitions("index")`): each task writes a file of its own, and the commit names them all in the
manifest, once they join without gap; a job that fails leaves no manifest and removes its files.  Paths are those that Arrow's file systems
know (local, hdfs, s3, ...).
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"
ROWS = 1 << 16


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Header:
    """Where the numbers of a file begin, their type, and its shape."""

    offset: int
    dtype: np.dtype
    rows: int
    width: int


def read_header(where: fs.FileSystem, path: str) -> Header:
    with where.open_input_file(path) as f:
        start = io.BytesIO(f.read(min(f.size(), 1 << 16)))
    version = np.lib.format.read_magic(start)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if fortran or len(shape) != 2 or dtype.kind not in "fiu":
        raise ValueError(f"{path} is not a row-major table of numbers")
    return Header(start.tell(), dtype, *shape)


@dataclass
class Range(InputPartition):
    path: str
    offset: int
    dtype: str
    width: int
    rows: int
    first: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    first: int
    rows: int
    width: int


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "index long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema.fields] != ["index", "vector"]:
            raise ValueError("the columns are index and vector")
        return ArrayWriter(self.options["path"], self.options.get("dtype", "float32"), overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Range]:
        where, path = _located(self.path)
        names = [path]
        if where.get_file_info(path).type == fs.FileType.Directory:
            with where.open_input_file(f"{path}/{MANIFEST}") as f:
                names = [f"{path}/{n}" for n in json.loads(f.read())["files"]]
        out, first = [], 0
        for name in names:
            h = read_header(where, name)
            out += [Range(name, h.offset + at * h.width * h.dtype.itemsize, h.dtype.str, h.width, min(self.rows, h.rows - at), first + at) for at in range(0, h.rows, self.rows)]
            first += h.rows
        return out or [Range("", 0, "<f4", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        dtype = np.dtype(part.dtype)
        with _located(self.path)[0].open_input_file(part.path) as f:
            f.seek(part.offset)
            raw = f.read(part.rows * part.width * dtype.itemsize)
        numbers = np.frombuffer(raw, dtype).astype("<f4")
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * part.width), pa.array(numbers))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + part.rows)), vectors], names=["index", "vector"])


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, overwrite: bool):
        self.path, self.dtype, self.overwrite, self.job = path, dtype, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A file of this task's rows, streamed: its header is written again, in the same size, once the rows are counted."""
        where, path = _located(self.path)
        where.create_dir(path, recursive=True)
        name, rows, width, first, body = f"part-{self.job}-{uuid.uuid4().hex}.npy", 0, 0, 0, f"{path}/.{self.job}-{uuid.uuid4().hex}"
        with where.open_output_stream(body) as out:
            for b in batches:
                if not b.num_rows:
                    continue
                index, flat = b["index"].to_numpy(), b["vector"].flatten().to_numpy(zero_copy_only=False)
                if b["vector"].null_count or b["index"].null_count or len(flat) % b.num_rows or (width and len(flat) // b.num_rows != width) or (b["vector"].value_lengths().to_numpy() != len(flat) // b.num_rows).any():
                    raise ValueError("vectors must be of one length, none null")
                first = int(index[0]) if not rows else first
                if (index != np.arange(first + rows, first + rows + len(index))).any():
                    raise ValueError("rows are not in order of a gapless index")
                width = len(flat) // b.num_rows
                rows += b.num_rows
                out.write(np.ascontiguousarray(flat, self.dtype).tobytes())
        if not rows:
            where.delete_file(body)
            return Written(None, 0, 0, 0)
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(self.dtype).str, "fortran_order": False, "shape": (rows, width)})
        with where.open_output_stream(f"{path}/{name}") as out, where.open_input_stream(body) as numbers:
            out.write(head.getvalue())
            while part := numbers.read(1 << 22):
                out.write(part)
        where.delete_file(body)
        return Written(name, first, rows, width)

    def commit(self, messages: list[Written]) -> None:
        where, path = _located(self.path)
        where.create_dir(path, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.first)
        starts, at = [m.first for m in parts], 0
        for m in parts:
            if m.first != at or m.width != parts[0].width:
                self.abort(messages)
                raise ValueError(f"files start at {starts} and do not join without gap")
            at += m.rows
        target = f"{path}/{MANIFEST}"
        old = []
        if where.get_file_info(target).type == fs.FileType.File:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.path} is there already")
            with where.open_input_file(target) as f:
                old = json.loads(f.read())["files"]
        with where.open_output_stream(f"{target}.{self.job}") as out:
            out.write(json.dumps({"files": [m.name for m in parts], "rows": at}).encode())
        where.move(f"{target}.{self.job}", target)
        for n in old:
            where.delete_file(f"{path}/{n}")

    def abort(self, messages: list[Written]) -> None:
        where, path = _located(self.path)
        for m in messages:
            if m is not None and m.name and where.get_file_info(f"{path}/{m.name}").type == fs.FileType.File:
                where.delete_file(f"{path}/{m.name}")


def register(spark: SparkSession) -> None:
    """Makes the format "arrays" known to a session."""
    spark.dataSource.register(ArrayFiles)
