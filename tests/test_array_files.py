"""Array files: round trips, ranges by offset, commits and failures."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.sources import array_files as A


@pytest.fixture
def folder(spark, tmp_path):
    A.register(spark)
    return tmp_path / "arrays"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "index long, vector array<float>")


def save(df, path, mode="append", parts=4, **options):
    df.repartitionByRange(parts, "index").sortWithinPartitions("index").write.format("arrays").mode(mode).options(**options).save(f"file://{path}")


def load(spark, path, **options):
    return [r["vector"] for r in spark.read.format("arrays").options(**options).load(f"file://{path}").orderBy("index").collect()]


@pytest.mark.parametrize("dtype", ["float32", "float16"])
def test_round_trip(spark, folder, dtype):
    x = np.random.default_rng(1).normal(size=(500, 7)).astype(dtype)
    save(table(spark, x), folder, dtype=dtype)
    manifest = json.loads((folder / A.MANIFEST).read_text())
    assert manifest["rows"] == 500 and len(manifest["files"]) == 4
    assert (np.concatenate([np.load(folder / n, mmap_mode="r") for n in manifest["files"]]) == x).all()
    df = spark.read.format("arrays").option("rows", 60).load(f"file://{folder}")
    assert df.rdd.getNumPartitions() == sum(-(-len(np.load(folder / n)) // 60) for n in manifest["files"])
    assert (np.array(load(spark, folder, rows=60)) == x.astype("float32")).all()
    assert df.where("index = 123").select(F.get("vector", F.lit(2))).first()[0] == np.float32(x[123, 2])


def test_a_file_of_other_software(spark, folder):
    x = np.arange(30, dtype="<i4").reshape(10, 3)
    np.save(f"{folder}.npy", x)
    assert load(spark, f"{folder}.npy", rows=4) == x.tolist()
    np.save(f"{folder}.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="row-major"):
        load(spark, f"{folder}.npy")


def test_existing_arrays_are_kept_or_replaced_whole(spark, folder):
    save(table(spark, np.ones((5, 2))), folder)
    with pytest.raises(Exception, match="there already"):
        save(table(spark, np.zeros((3, 2))), folder)
    assert len(load(spark, folder)) == 5
    save(table(spark, np.zeros((3, 2))), folder, mode="overwrite")
    assert load(spark, folder) == [[0, 0]] * 3
    assert len([p for p in Path(folder).iterdir() if p.suffix == ".npy"]) == len(json.loads((folder / A.MANIFEST).read_text())["files"])


def test_faulty_rows_leave_nothing(spark, folder):
    good = table(spark, np.ones((8, 2)))
    for bad in (good.where("index <> 3"), good.withColumn("vector", F.when(F.col("index") != 5, F.col("vector"))), good.withColumn("vector", F.when(F.col("index") == 5, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))):
        with pytest.raises(Exception, match="gap|order|length"):
            save(bad, folder)
        assert not (folder / A.MANIFEST).exists()


def test_no_rows(spark, folder):
    save(table(spark, np.ones((2, 2))).limit(0), folder)
    assert load(spark, folder) == []
