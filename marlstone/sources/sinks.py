"""Sinks: predictions with a round-trip check, parquet, reports, manifests and bundles."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contracts
from .workspace import checkpointed

SAFE_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$")


def safe_id(name: str) -> str:
    """The name, if it can be a file's name and nothing else."""
    if not SAFE_NAME.match(name) or ".." in name:
        raise ValueError(f"unsafe id {name!r}")
    return name


def write_predictions(predictions: DataFrame, expected: DataFrame, path: str, index: str = "row_idx") -> None:
    """id,prediction in the expected rows' order, as CSV; read back and compared.

    expected: id and row index.  One file, as its readers want: the rows are sorted in ranges and checkpointed, and one task only copies them out.
    """
    rows = expected.select("id", index).join(predictions.select("id", F.col("prediction").cast("int")), "id", "left")
    contracts.require([contracts.unique(predictions, ["id"], "id_unique"), contracts.failing(rows, F.col("prediction").isin(0, 1), "prediction_domain"), contracts._rule(predictions.select("id").join(expected.select("id"), "id", "left_anti"), "unexpected_id", F.count(F.lit(1)))])
    checkpointed(rows.orderBy(index).select("id", "prediction")).coalesce(1).write.mode("overwrite").csv(path, header=True)
    back = predictions.sparkSession.read.csv(path, header=True, schema="id string, prediction int")
    wanted = rows.select(F.col("id").cast("string"), "prediction")
    if not (back.exceptAll(wanted).isEmpty() and wanted.exceptAll(back).isEmpty()):
        raise ValueError(f"{path}: what was written reads back differently")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_manifest(spark, folder: str) -> DataFrame:
    """name (the path below the folder), bytes and SHA-256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    below = F.substring_index("path", root, -1)
    return files.select(below.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark, folder: str, manifest: dict[str, str]) -> None:
    found = {r["name"]: r["sha256"] for r in file_manifest(spark, folder).collect()}
    wrong = sorted(n for n, h in manifest.items() if found.get(n) != h)
    if wrong:
        raise ValueError(f"files missing or changed: {', '.join(wrong)}")


def sha256_file(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def atomic_json(value, path: str | Path) -> None:
    """A small driver-side JSON file that is there whole or not at all."""
    path = Path(path)
    part = path.with_suffix(path.suffix + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))
    part.replace(path)
