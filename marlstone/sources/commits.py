"""Restartable jobs over parts, published by atomic renames through Hadoop's file systems, and small texts written the same way.

A job has a folder for its fingerprint (of its source, model and settings).  A part is written under an attempt's name and published by
one rename that fails if the part is there already, so a part is whole or absent, whoever else runs; readers list published parts only.
A job that is started again does what is missing; one with another fingerprint starts from nothing beside it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """What is needed of the file system that a path lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self.path(folder))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def publish(self, source: str, target: str, replace: bool = False) -> bool:
        """Renames source to target in one step; False, with source removed, if target is there and not to be replaced."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        try:
            self.context.rename(self.path(source), self.path(target), how)
        except Exception as failed:
            if replace or "FileAlreadyExistsException" not in str(failed):
                raise
            self.remove(source)
            return False
        return True

    def write(self, name: str, text: str) -> None:
        """The file is the old one or the new one whole, never part of it."""
        folder, _, last = name.rpartition("/")
        self.make(folder)
        attempt = f"{folder}/.{last}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(attempt), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.publish(attempt, name, replace=True)

    def read(self, name: str) -> str:
        size = self.fs.getFileStatus(self.path(name)).getLen()
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode() if size else ""
        finally:
            stream.close()


def fingerprint(**of) -> str:
    """A digest of settings, whatever their order."""
    return hashlib.sha256(json.dumps(of, sort_keys=True, default=str).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Progress:
    done: int
    parts: int


class PartJob:
    """A job in `parts` parts of rows by a hash of their key."""

    def __init__(self, spark: SparkSession, folder: str, parts: int, **of):
        self.spark, self.parts, self.files = spark, parts, Files(spark, folder)
        self.mark = fingerprint(parts=parts, **of)
        self.folder = f"{folder}/{self.mark}"
        self.table = f"{self.folder}/table"
        self.files.make(self.table)
        if not self.files.exists(f"{self.folder}/job.json"):
            self.files.write(f"{self.folder}/job.json", json.dumps({"parts": parts, **of}, sort_keys=True, default=str))

    def published(self) -> set[int]:
        return {int(n.split("=")[1]) for n in self.files.names(self.table) if n.startswith("part=")}

    def progress(self) -> Progress:
        return Progress(len(self.published()), self.parts)

    def run(self, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], wave: int = 16) -> DataFrame:
        """All rows after `work`, which keeps their column part; parts that are published are not worked on again.  One Spark job for `wave` parts."""
        marked = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int"))
        todo = sorted(set(range(self.parts)) - self.published())
        schema = None
        for at in range(0, len(todo), wave):
            some, attempt = todo[at : at + wave], f"{self.folder}/.attempt-{uuid.uuid4().hex}"
            out = work(marked.where(F.col("part").isin(some)))
            schema = out.schema
            out.repartition(len(some), "part").write.partitionBy("part").parquet(attempt)
            for part in some:
                made = f"{attempt}/part={part}"
                self.files.make(made)  # of no rows: published empty
                self.files.publish(made, f"{self.table}/part={part}")
            self.files.remove(attempt)
        return self.read(schema or work(marked.limit(0)).schema)

    def read(self, schema) -> DataFrame:
        """The published rows.  Parts appear whole, so this can be read while others run."""
        return self.spark.read.schema(schema).parquet(self.table)

    def clean(self) -> None:
        """What stopped attempts left behind.  Not while another run is on."""
        for name in self.files.names(self.folder):
            if name.startswith(".attempt-"):
                self.files.remove(f"{self.folder}/{name}")
