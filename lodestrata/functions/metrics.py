"""Latency histograms with fixed bounds; a percentile is the upper bound of its bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper bounds of the buckets in microseconds; what is larger is in the overflow bucket (infinity).
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000, 50_000, 100_000)
PERCENTS = {"p50_us": 50, "p99_us": 99, "p999_us": 99.9}


def bucket(value: Column) -> Column:
    out = F.lit(float("inf"))
    for b in reversed(BOUNDS):
        out = F.when(value <= b, float(b)).otherwise(out)
    return out


def histogram(values: DataFrame, group: str, value: str) -> DataFrame:
    """name, upper, n, total: at most sixteen rows a name leave a task."""
    exact = F.col(value).cast("decimal(18,2)")
    return values.groupBy(F.col(group).alias("name"), bucket(F.col(value)).alias("upper")).agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("total"))


def percentiles(hist: DataFrame, *percents: float) -> DataFrame:
    """name, percent, p_upper: the first bucket up to which there are percent / 100 of all values."""
    run = hist.select("name", "upper", F.sum("n").over(Window.partitionBy("name").orderBy("upper")).alias("c"), F.sum("n").over(Window.partitionBy("name")).alias("t"))
    asked = run.select("name", "upper", "c", "t", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent"))
    return asked.where(F.col("c") * 100 >= F.col("t") * F.col("percent")).groupBy("name", "percent").agg(F.min("upper").alias("p_upper"))


def mean(hist: DataFrame) -> DataFrame:
    return hist.groupBy("name").agg((F.sum("total").cast("double") / F.sum("n")).alias("mean_us"), F.sum("n").alias("count"))


def snapshot(hist: DataFrame) -> DataFrame:
    """One row a name: the three percentiles, the mean rounded to one digit, the count."""
    of = percentiles(hist, *PERCENTS.values()).groupBy("name").agg(*[F.max(F.when(F.col("percent") == float(p), F.col("p_upper"))).alias(n) for n, p in PERCENTS.items()])
    return of.join(mean(hist), "name").withColumn("mean_us", F.round("mean_us", 1))


def engine(log: DataFrame) -> DataFrame:
    """Counters of a change log (level: where its bytes were written), one row a level."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return log.groupBy("level").agg(F.count_if(F.col("op") == "P").alias("puts"), F.count_if(F.col("op") == "D").alias("deletes"), F.sum(size).cast("long").alias("bytes"))
