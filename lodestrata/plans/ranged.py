"""Computations along one global order without a task that gets all rows.

Rows are dealt to ranges of the ordering columns (sampled bounds) and written with the number of their range; windows
run inside ranges; one summary row a range carries what crosses their borders.  There are as many summary rows as
partitions, so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans.scratch import Tables


def deal(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``part``, the number of its range of ``order``; written, so that a row keeps its part."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return Tables(df.sparkSession, "ranged").keep(ranged, "dealt")


def _carried(rows: DataFrame, dealt: DataFrame, value: Column, how: str, forward: bool) -> DataFrame:
    """``rows`` joined with the aggregate of ``value`` (of ``dealt``) over all earlier (or later) parts, as ``carried``."""
    order = Window.orderBy("part" if forward else F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("part").agg(getattr(F, how)(value).alias("x"))
    return rows.join(F.broadcast(ends.select("part", getattr(F, how)("x").over(order).alias("carried"))), "part")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``position``: 0, 1, 2, ... in the order of ``key``."""
    dealt = deal(df, key)
    inner = dealt.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    out = _carried(inner, dealt, F.lit(1), "sum", True)
    return out.withColumn("position", (F.coalesce("carried", F.lit(0)) + F.col("i") - 1).cast("long")).drop("part", "i", "carried")


def with_next(df: DataFrame, key: str, name: str = "next_key") -> DataFrame:
    """``df`` with the next larger ``key`` (null at the last row)."""
    dealt = deal(df, key)
    inner = dealt.withColumn(name, F.lead(key).over(Window.partitionBy("part").orderBy(key)))
    return _carried(inner, dealt, F.col(key), "min", False).withColumn(name, F.coalesce(name, "carried")).drop("part", "carried")


def around(rows: DataFrame, at: str, value: Column) -> DataFrame:
    """``rows`` with ``below`` and ``above``: the largest ``value`` at or before, the smallest at or after, by ``at``.

    ``value`` is a function of ``at`` that grows with it, and null where a row is none of those sought.
    """
    dealt = deal(rows, at)
    # each side runs from its own end: a frame that reaches forward to the last row would be gone through for every row
    before = Window.partitionBy("part").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("part").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0)
    near = dealt.withColumn("below", F.max(value).over(before)).withColumn("above", F.min(value).over(after))
    near = _carried(near, dealt, value, "max", True).withColumn("below", F.coalesce("below", "carried")).drop("carried")
    return _carried(near, dealt, value, "min", False).withColumn("above", F.coalesce("above", "carried")).drop("carried", "part")


def running_max(rows: DataFrame, at: str, value: str) -> DataFrame:
    """``rows`` with ``reached``: the largest ``value`` of all rows at or before theirs by ``at``."""
    dealt = deal(rows, at)
    inside = Window.partitionBy("part").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    near = _carried(dealt.withColumn("reached", F.max(value).over(inside)), dealt, F.col(value), "max", True)
    return near.withColumn("reached", F.greatest("reached", "carried")).drop("part", "carried")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores if a small input has fewer; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- along the order of each key ------------------------------------------------------------------------------------------------
#: Rows of one key that a single window may get; keys with more are cut into spans of their order.
HOT_ROWS = 2_000_000


def largest(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: one row a key leaves a task."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _spans(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_span", F.floor(F.col(order) / HOT_ROWS))


def running(rows: DataFrame, keys: list[str], order: str, name: str, how: str, value: Column, upto: int = 0) -> DataFrame:
    """``rows`` with ``name``: the sum, min or max of ``value`` over a key's rows up to this one (``upto`` -1: before it).

    ``order`` is a whole number that no two rows of a key share.  A hot key's spans are summed by themselves, and what
    is before a span is added from one row a span.
    """
    agg = getattr(F, how)
    if largest(rows, keys) <= HOT_ROWS:
        return rows.withColumn(name, agg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)))
    cut = _spans(rows, keys, order)
    inner = cut.withColumn("_in", agg(value).over(Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, upto)))
    ends = cut.groupBy(*keys, "_span").agg(agg(value).alias("_x"))
    before = ends.select(*keys, "_span", agg("_x").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = {"sum": F.when(F.coalesce("_before", "_in").isNotNull(), F.coalesce("_before", F.lit(0)) + F.coalesce("_in", F.lit(0))), "min": F.least("_before", "_in"), "max": F.greatest("_before", "_in")}[how]
    return inner.join(before, [*keys, "_span"]).withColumn(name, both).drop("_span", "_in", "_before")


def lagged(rows: DataFrame, keys: list[str], order: str, name: str, value: str) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the key's row before; hot keys are cut into spans as in ``running``."""
    if largest(rows, keys) <= HOT_ROWS:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    cut = _spans(rows, keys, order)
    held = F.struct(F.col(value).alias("x"))
    inner = cut.withColumn("_in", F.lag(held).over(Window.partitionBy(*keys, "_span").orderBy(order)))
    ends = cut.groupBy(*keys, "_span").agg(F.max_by(held, order).alias("_last"))
    before = ends.select(*keys, "_span", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_span")).alias("_before"))
    return inner.join(before, [*keys, "_span"]).withColumn(name, F.coalesce("_in", "_before")["x"]).drop("_span", "_in", "_before")


def ranked(rows: DataFrame, group: str, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the order of each group; a group with many rows is ranked by ranges."""
    if largest(rows, [group]) <= HOT_ROWS:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranged = rows.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id())
    dealt = Tables(rows.sparkSession, "ranged").keep(ranged, "dealt")
    inner = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("part", group).orderBy(*order)))
    ends = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("_n"))
    before = ends.select(group, "part", F.sum("_n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return inner.join(before, [group, "part"]).withColumn(name, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("int")).drop("part", "_in", "_before")
