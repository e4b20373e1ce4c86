"""Artifacts of a run: cached item views, bundles, configurations, and an audit of what is there."""

from __future__ import annotations

import dataclasses
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sinks import atomic_json, safe_id, sha256_file


def content_hash(df: DataFrame) -> str:
    """Rows and two sums of row hashes: the same for the same rows in any order or partitioning, repeats counted."""
    names = sorted(df.columns)
    row = lambda seed: F.xxhash64(F.lit(seed), *[F.col(f"`{n}`") for n in names], *[F.col(f"`{n}`").isNull() for n in names]).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row(1)).alias("a"), F.sum(row(2)).alias("b")).first()
    return f"{found['n']}_{int(found['a'] or 0) % (1 << 64):016x}{int(found['b'] or 0) % (1 << 64):016x}"


def _done(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def cached_view(items: DataFrame, build: Callable[[DataFrame], DataFrame], view: str, folder: str) -> DataFrame:
    """build(items), written once for each view and content of the items, and read back from then on.

    A table counts as there once its commit marker is, so a write that was cut off is done again.
    """
    spark = items.sparkSession
    path = f"{folder.rstrip('/')}/{safe_id(view)}/{content_hash(items)}"
    if not _done(spark, path):
        build(items).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_config(config, run: str, folder: str | Path) -> Path:
    """A run's configuration (a dictionary or data class) as JSON in a folder of the run's own; the run's name must be safe."""
    target = Path(folder) / safe_id(run) / "config.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    atomic_json(dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config), target)
    return target


def write_bundle(folder: str | Path, target: str | Path) -> dict[str, str]:
    """All files below a folder as one zip with manifest.json (path -> SHA-256) inside, written from streams; returns the manifest.

    Entries are in order of path and have one fixed time, so the same files give the same bundle.
    """
    root, target = Path(folder), Path(target)
    files = [p for p in sorted(root.rglob("*")) if p.is_file() and p != target and p.relative_to(root).as_posix() != "manifest.json"]
    manifest = {p.relative_to(root).as_posix(): sha256_file(p) for p in files}
    atomic_json({"files": manifest}, root / "manifest.json")
    part = target.with_suffix(target.suffix + ".part")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for p in [*files, root / "manifest.json"]:
            entry = zipfile.ZipInfo(p.relative_to(root).as_posix())
            entry.compress_type = zipfile.ZIP_DEFLATED
            with p.open("rb") as source, z.open(entry, "w", force_zip64=True) as sink:
                while block := source.read(1 << 20):
                    sink.write(block)
    part.replace(target)
    return manifest


def verify_bundle(target: str | Path) -> None:
    """An error if a file of the bundle is missing, changed or not listed in its manifest."""
    import hashlib
    import json

    with zipfile.ZipFile(target) as z:
        wanted = json.loads(z.read("manifest.json"))["files"]
        wrong = set(wanted) ^ (set(z.namelist()) - {"manifest.json"})
        for name in set(wanted) - wrong:
            digest = hashlib.sha256()
            with z.open(name) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != wanted[name]:
                wrong.add(name)
    if wrong:
        raise ValueError(f"bundle files missing or changed: {', '.join(sorted(wrong))}")


def state_audit(pairs: DataFrame, candidates: dict[str, DataFrame], term: str = "term", key: str = "item", size: int = 100) -> DataFrame:
    """One row for each named prediction table: whether it has the pairs' keys once each, is binary, its positives and rate, beside the pairs' own counts.

    pairs: term and key; a candidate: key and prediction.  A table that is not there (None) is reported as missing.
    """
    groups = pairs.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    base = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pair_rows"), F.count(F.lit(1)).alias("terms"), F.count_if(F.col("n") == size).alias("exact_terms"), F.count_if(F.col("n") > size).alias("over_terms"))
    found = []
    for name, table in candidates.items():
        if table is None:
            found.append(base.select(F.lit(name).alias("name"), F.lit("missing").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in (("rows", "bigint"), ("same_keys", "boolean"), ("is_binary", "boolean"), ("positives", "bigint"), ("rate", "double"))], "*"))
            continue
        keys = pairs.select(key, F.lit(1).alias("d")).unionAll(table.select(key, F.lit(-1))).groupBy(key).agg(F.sum("d").alias("d")).agg(F.count_if(F.col("d") != 0).alias("odd"))
        p = F.col("prediction")
        own = table.agg(F.count(F.lit(1)).alias("rows"), (F.count_if(p.isNull() | ~p.isin(0, 1)) == 0).alias("is_binary"), F.coalesce(F.sum(p), F.lit(0)).alias("positives"), F.avg(p).alias("rate"))
        joined = base.crossJoin(own).crossJoin(keys)  # a row each
        found.append(joined.select(F.lit(name).alias("name"), F.lit("available").alias("status"), "rows", (F.col("odd") == 0).alias("same_keys"), "is_binary", "positives", "rate", "pair_rows", "terms", "exact_terms", "over_terms"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
