"""The few functions without a built-in form, as Arrow functions."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; plain Latin and Turkish text never leaves the JVM's fast path."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())

    return F.when(c.rlike(r"^[\x00-\x7FçğıöşüÇĞİÖŞÜ]*$"), c).otherwise(F.arrow_udf(run, "string")(c))


def blake2b_fold(seed: str, key: Column, folds: int) -> Column:
    """First eight bytes of BLAKE2b as a little-endian number, modulo folds."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") % folds for k in keys.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(key.cast("string"))
