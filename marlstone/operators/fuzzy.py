"""Joins of texts within an edit distance, by segment signatures.

A text is cut into k + 1 even segments.  k edits leave one of them unchanged, and it lies within k places of where it was, so two texts
within k edits share (length of the cut text, segment number, segment) between one side's segments and the other side's substrings.  The
candidates' Levenshtein distance is then exact.  Texts are made distinct first, so copies cost nothing and meet once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal_joins import salted_join


def _starts(length: Column, k: int) -> list[Column]:
    """Where each segment of a text of this length starts (from 1), and one more for its end: the first ones are the shorter ones."""
    size, longer = F.floor(length / (k + 1)), length % (k + 1)
    return [(1 + j * size + F.greatest(longer - (k + 1 - j), F.lit(0))).cast("int") for j in range(k + 2)]


def _signatures(texts: DataFrame, k: int) -> DataFrame:
    """text, n (its length), segment and piece."""
    starts = _starts(F.col("n"), k)
    pieces = [F.struct(F.lit(j).alias("segment"), F.substr("text", starts[j], starts[j + 1] - starts[j]).alias("piece")) for j in range(k + 1)]
    return texts.select("text", "n", F.explode(F.array(*pieces)).alias("s")).select("text", "n", "s.segment", "s.piece")


def _probes(texts: DataFrame, k: int) -> DataFrame:
    """text, n (the length looked for), segment and piece: all substrings that a segment of a near text can be, once each."""
    wide = texts.select("text", F.length("text").alias("own"), F.explode(F.sequence(F.greatest(F.length("text") - k, F.lit(0)), F.length("text") + k)).alias("n"))
    starts = _starts(F.col("n"), k)
    segments = [F.struct(F.lit(j).alias("segment"), starts[j].alias("at"), (starts[j + 1] - starts[j]).alias("size")) for j in range(k + 1)]
    places = wide.select("text", "own", "n", F.explode(F.array(*segments)).alias("s"))
    shifts = places.select("text", "n", "s.segment", "s.size", "own", F.explode(F.sequence(F.greatest(F.col("s.at") - k, F.lit(1)), F.least(F.col("s.at") + k, F.col("own") - F.col("s.size") + 1))).alias("at")).where(F.col("at") + F.col("size") - 1 <= F.col("own"))
    return shifts.select("text", "n", "segment", F.substr("text", F.col("at"), F.col("size")).alias("piece")).distinct()


def similar_texts(left: DataFrame, right: DataFrame, k: int, heavy_rows: int = 100_000) -> DataFrame:
    """left_text, right_text and distance of all pairs of distinct texts within k edits.  Each side has a column text; nulls meet nothing."""
    if k < 0:
        raise ValueError("k must not be negative")
    a = left.where(F.col("text").isNotNull()).select("text").distinct()
    b = right.where(F.col("text").isNotNull()).select("text").distinct().withColumn("n", F.length("text"))
    probes = _probes(a, k).withColumnRenamed("text", "left_text")
    signed = _signatures(b, k).withColumnRenamed("text", "right_text")
    met = salted_join(probes, signed, ["n", "segment", "piece"], heavy_rows).select("left_text", "right_text").distinct()
    return met.withColumn("distance", F.levenshtein("left_text", "right_text", k)).where("distance >= 0")


def similar_pairs(texts: DataFrame, k: int, heavy_rows: int = 100_000) -> DataFrame:
    """similar_texts() of a column text with itself, each pair of different texts once, the lesser first."""
    return similar_texts(texts, texts, k, heavy_rows).where("left_text < right_text")
