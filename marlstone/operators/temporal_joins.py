"""Joins by time: points in intervals, overlapping intervals, and the last row as of a time.

Interval joins are equi-joins on grid cells.  An interval goes to the coarsest level it needs, level l having cells of unit * 2**l, so it
touches at most two cells whatever its length; a point goes to one cell of each level that some interval uses, of at most LEVELS.  The
exact condition follows.  As-of joins take both sides in one ordered pass for each key; a key with many rows is cut into ranges of time
and the last row of each range is carried into the next ones.  Neither has a nested loop, and neither gathers a key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 62
HEAVY_ROWS, HEAVY_KEYS, RANGES = 100_000, 20_000, 256


def micros(c: Column | str) -> Column:
    """A timestamp, date or number as a long that orders alike."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def _ticks(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    return micros(column) if kind in ("timestamp", "date", "timestamp_ntz") else F.col(column).cast("long")


def _level(length: Column, unit: int) -> Column:
    """The least level whose cells are at least as long as the interval."""
    return F.when(length <= unit, 0).otherwise(F.ceil(F.log2(length / unit))).cast("int")


def _cell(at: Column, level: Column, unit: int) -> Column:
    """floor(at / width of a cell), in whole numbers."""
    width = F.lit(unit).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), level)
    return F.call_function("div", at - F.pmod(at, width), width)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """left joined with right on `on`; a key with more than heavy_rows rows of left is dealt over parts, right's rows for it repeated.

    heavy_rows rises with the table so that at most HEAVY_KEYS keys are heavy: that list is broadcast.
    """
    least = max(heavy_rows, left.count() // HEAVY_KEYS)
    heavy = F.broadcast(left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / least).cast("int").alias("_parts")).where("_parts > 1"))
    own = [c for c in left.columns if c not in on]
    part = F.pmod(F.xxhash64(*own), F.coalesce("_parts", F.lit(1))).cast("int") if own else F.lit(0)
    dealt = left.join(heavy, on, "left").withColumn("_part", part).drop("_parts")
    spread = right.join(heavy, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread, [*on, "_part"]).drop("_part")


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, on: list[str] | None = None, unit: int = 60_000_000, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Every point with every interval that holds it: start <= at < end, and equal keys `on` where given.

    Timestamps count in microseconds, so unit is a minute unless given.  Rows with a null time, and intervals that end before they start,
    join with nothing; the sides' other columns must differ in name.
    """
    on = on or []
    p = points.withColumn("_at", _ticks(points, at)).where(F.col("_at").isNotNull())
    i = intervals.withColumns({"_start": _ticks(intervals, start), "_end": _ticks(intervals, end)}).where("_start < _end")
    i = i.withColumn("_level", _level(F.col("_end") - F.col("_start"), unit))
    first, last = _cell(F.col("_start"), F.col("_level"), unit), _cell(F.col("_end") - 1, F.col("_level"), unit)
    i = i.withColumn("_cell", F.explode(F.sequence(first, last)))  # two cells at most
    levels = [r[0] for r in i.select("_level").distinct().collect()]  # LEVELS numbers at most
    if not levels:
        return p.limit(0).join(i.drop("_level", "_cell"), on).drop("_at", "_start", "_end") if on else p.limit(0).crossJoin(i.limit(0)).drop("_at", "_start", "_end", "_level", "_cell")
    p = p.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))).withColumn("_cell", _cell(F.col("_at"), F.col("_level"), unit))
    joined = salted_join(p, i, [*on, "_level", "_cell"], heavy_rows)
    return joined.where("_start <= _at and _at < _end").drop("_level", "_cell", "_at", "_start", "_end")


def sums_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, values: dict[str, str], count: str, on: list[str] | None = None, unit: int = 60_000_000, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """intervals that hold a point, with the number of their points in `count` and sums: values gives the new column's name for each summed one.

    Points of one time and intervals of one span are added up before they meet, so the join grows with the distinct times and spans and
    not with the pairs of rows.
    """
    on = on or []
    times = points.groupBy(*on, at).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
    spans = intervals.select(*on, start, end).distinct()
    met = points_in_intervals(times, spans, at, start, end, on, unit, heavy_rows).groupBy(*on, start, end).agg(F.sum("_n").alias(count), *[F.sum(f"_{v}").alias(name) for v, name in values.items()])
    return intervals.join(met, [*on, start, end])


def overlapping_intervals(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, on: list[str] | None = None, unit: int = 60_000_000, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Pairs of half-open intervals that share a time: the later start of the two lies in the other interval.

    So each pair is found once: left starts within right, or right starts strictly within left.
    """
    a = points_in_intervals(left.where(F.col(left_start) < F.col(left_end)), right, left_start, right_start, right_end, on, unit, heavy_rows)
    b = points_in_intervals(right.where(F.col(right_start) < F.col(right_end)), left, right_start, left_start, left_end, on, unit, heavy_rows).where(F.col(left_start) < F.col(right_start))
    return a.unionByName(b.select(*a.columns))


def as_of(left: DataFrame, right: DataFrame, at: str, right_at: str, on: list[str], value: list[str], tolerance: int | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """left with the columns `value` and right_at of the last row of right at or before its time, null without one (within tolerance).

    on names the key on both sides and right_at differs from left's columns, as do the values.  Rows of right of one key and time are
    told apart by their values, the greatest wins.  Null keys meet nothing; null times of left find nothing.  Every row of left stays, once.
    """
    kept = [c for c in left.columns]
    row = F.struct(*[F.col(c) for c in kept])
    found = F.struct(F.col(right_at), *[F.col(v) for v in value])
    kinds = right.select(found.alias("r")).schema["r"].dataType
    a = left.select(*on, _ticks(left, at).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(kinds).alias("_found"))
    b = right.select(*on, _ticks(right, right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), found.alias("_found")).where(F.col("_at").isNotNull())
    for key in on:
        b = b.where(F.col(key).isNotNull())
    both = a.unionByName(b)
    # Keys with many rows are cut at quantiles of their own times.  HEAVY_KEYS keys at most, each with at most RANGES bounds, are broadcast.
    sizes = both.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    least = max(heavy_rows, (rows or 0) // HEAVY_KEYS)
    counts, most = sizes.where(F.col("_n") > least), most if most and most > least else None
    if most is None:
        both = both.withColumn("_range", F.lit(0))
    else:
        parts = min(RANGES, -(-most // least))
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"h.{k}")) for k in on]
        heavy = both.alias("b").join(F.broadcast(counts.alias("h")), same, "left_semi").groupBy(*on).agg(F.percentile_approx("_at", [j / parts for j in range(1, parts)], 10_000).alias("_bounds"))
        marked = both.alias("b").join(F.broadcast(heavy.alias("h")), same, "left").select("b.*", "h._bounds")
        both = marked.withColumn("_range", F.when(F.col("_at").isNull() | F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda x: x < F.col("_at"))))).drop("_bounds")
    order = [F.col("_at").asc_nulls_first(), F.col("_side"), F.col("_found")]
    inside = Window.partitionBy(*on, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last("_found", ignorenulls=True).over(inside)
    if most is None:
        out = both.withColumn("_last", here)
    else:
        tails = both.where("_side = 0").groupBy(*on, "_range").agg(F.max(F.struct("_at", "_found")).alias("_t"))
        ranges = both.select(*on, "_range").distinct().join(tails, [*on, "_range"], "left")
        carried = ranges.withColumn("_before", F.last(F.col("_t._found"), ignorenulls=True).over(Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*on, "_range"]]
        out = both.withColumn("_here", here).alias("b").join(carried.alias("c"), same, "left").select("b.*", F.coalesce("_here", "_before").alias("_last"))
    out = out.where("_side = 1")
    hit = F.col("_at").isNotNull()
    if tolerance is not None:
        time = F.col(f"_last.{right_at}")
        ticks = F.unix_micros(time.cast("timestamp")) if kinds[right_at].dataType.typeName() in ("timestamp", "date", "timestamp_ntz") else time.cast("long")
        hit = hit & (F.col("_at") - ticks <= tolerance)
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in kept], *[F.when(hit, F.col(f"_last.{c}")).alias(c) for c in [right_at, *value]])
