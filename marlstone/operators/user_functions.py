"""User-defined aggregates with partial states, and table functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def aggregate(df: DataFrame, key: str, value: str, update: Callable[[bytes | None, pa.Array], bytes], merge: Callable[[list[bytes]], bytes], finish: Callable[[bytes], float | None]) -> DataFrame:
    """One row for each key: finish(state) as `result`, by an aggregate of one's own with states as bytes.

    update: a state (None at first) with a batch's values of one key; merge: states into one.  Rows are folded where they lie, so a key
    that holds a third of all rows sends one state for each batch that has it; those are merged in SALTS groups first and then once
    more.  merge must not depend on the order of states, and a state's size should not grow with the rows it stands for.
    """
    kind = df.schema[key].dataType.simpleString()

    def partial(batches):
        for b in batches:
            table = pa.table({"k": b[key], "i": pa.array(range(len(b)), pa.int64())}).group_by("k").aggregate([("i", "list")])
            found = [update(None, b[value].take(i.values)) for i in table["i_list"].combine_chunks()]
            yield pa.RecordBatch.from_arrays([table["k"].combine_chunks().cast(b.schema.field(key).type), pa.array(found, pa.binary())], names=[key, "state"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.head(1).assign(state=[merge([bytes(s) for s in rows["state"]])])

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.head(1)[[key]].assign(result=[finish(merge([bytes(s) for s in rows["state"]]))])

    states = df.select(key, value).mapInArrow(partial, f"`{key}` {kind}, state binary").withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(SALTS)))
    few = states.groupBy(key, "salt").applyInPandas(merged, f"`{key}` {kind}, state binary, salt bigint")
    return few.groupBy(key).applyInPandas(last, f"`{key}` {kind}, result double")


class TextWindows:
    """Table function: start and text of each run of `size` words, a new one every `step` words, up to the end of the text."""

    def eval(self, text: str, size: int, step: int):
        words = WORD.findall(text or "")
        for start in range(0, len(words), step):
            yield start, " ".join(words[start : start + size])


def text_windows(df: DataFrame, text: str, size: int, step: int) -> DataFrame:
    """The rows with start and window of each run of words of their text; a text without words has none."""
    table = F.udtf(TextWindows, returnType="start int, window string")
    return df.lateralJoin(table(F.col(text).outer(), F.lit(size), F.lit(step)))
