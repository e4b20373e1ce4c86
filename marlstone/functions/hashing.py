"""Keyed hashes that Spark and other SQL engines compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: str, *keys: Column) -> Column:
    """First 15 hex digits of md5("seed:key|key"), a non-negative long."""
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_fold(seed: str, key: Column, folds: int) -> Column:
    return (keyed_hash(seed, key) % folds).cast("int")


def sha1_percent(key: Column) -> Column:
    """0..99 from the first eight hex digits of SHA-1."""
    return (F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("long") % 100).cast("int")


def pair_uid(*keys: Column) -> Column:
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))


def lineage_hash(keys: Column) -> Column:
    """Aggregate: SHA-256 over the sorted keys, whatever order rows come in.  It holds a group's keys in one row, so it is for groups of bounded size."""
    return F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(keys.cast("string")))), 256)


def order_free_hash(keys: Column) -> Column:
    """Aggregate: the number of keys and two sums of 60 bits of their MD5 each: like lineage_hash() the same in any order of rows, but a few numbers for a group of any size."""
    digest = F.md5(keys.cast("string"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return F.concat_ws("_", F.count(keys).cast("string"), part(1), part(16))
