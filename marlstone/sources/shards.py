"""Row indexes and restartable sharded jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import lineage_hash
from ..operators.joins import small_side
from ..operators.windows import number_rows


def with_row_index(df: DataFrame, *order: str, into: str = "row_idx") -> DataFrame:
    """0, 1, 2 in an explicit order that tells all rows apart, without one task for all rows."""
    return number_rows(df, list(order), into)


def shard_summary(df: DataFrame, key: str, size: int, index: str = "row_idx") -> DataFrame:
    """shard, rows, bounds and a fingerprint of its keys."""
    return df.groupBy(F.floor(F.col(index) / size).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.min(index).alias("first_row"), F.max(index).alias("last_row"), lineage_hash(F.col(key)).alias("fingerprint"))


def run_shards(df: DataFrame, score, folder: str, size: int, signature: str, key: str = "id", index: str = "row_idx") -> DataFrame:
    """Scores only shards that folder has no finished rows for under this signature, and returns all scored rows.

    score maps a DataFrame of rows to one with the same rows and more columns.  A shard is its own partition folder, replaced
    whole, so a job that is stopped can be started again, and a shard whose rows or keys changed is scored anew.
    """
    spark = df.sparkSession
    marked = df.withColumn("shard", F.floor(F.col(index) / size).cast("long"))
    want = shard_summary(df, key, size, index)
    todo = want.select("shard")
    done = None
    try:
        done = spark.read.parquet(folder).where(F.col("run_signature") == signature)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    if done is not None:
        have = done.groupBy("shard").agg(F.count(F.lit(1)).alias("have"), lineage_hash(F.col(key)).alias("seen"))
        todo = want.join(have, "shard", "left").where("have is null or have <> rows or seen <> fingerprint").select("shard")
    out = score(marked.join(small_side(todo), "shard")).withColumn("run_signature", F.lit(signature))
    out.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    return spark.read.parquet(folder).where(F.col("run_signature") == signature)


def verify_shards(df: DataFrame, index: str = "row_idx") -> None:
    """Row indexes are 0..n-1, each once."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if r["n"] and (r["n"] != r["d"] or r["lo"] != 0 or r["hi"] != r["n"] - 1):
        raise ValueError("row indexes are not contiguous")
