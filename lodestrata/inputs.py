"""The driver's tables as inputs of the engine: change logs, structures, and the same as SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans import log as kv

AS_OF = 1706659200000000  # 2024-01-31 00:00:00 UTC
DAY = 86_400_000_000
FROM = 1704067200000000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


def user(column: str | F.Column = "user_id") -> F.Column:
    number = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("user:"), F.lpad(number.cast("string"), 6, "0"))


def cents(name: str = "value") -> F.Column:
    return (F.col(name).cast("decimal(18,2)") * 100).cast("long")


def kv_log(s: SparkSession, d: str) -> DataFrame:
    """The change log of users: an error deletes, a signup expires after seven days."""
    kind = F.col("event_type")
    return events(s, d).select(
        F.col("event_id").alias("seq"), F.lit(0).alias("ord"), user().alias("key"), F.when(kind == "error", "D").otherwise("P").alias("op"),
        F.when(kind != "error", F.col("value").cast("decimal(18,2)").cast("string")).alias("value"), F.when(kind == "signup", F.col("ts_us") + 7 * DAY).alias("expires_at"), "ts_us", "event_type",
    )


def live(s: SparkSession, d: str) -> DataFrame:
    return kv.live(kv_log(s, d), AS_OF)


def pair(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


LOG_SQL = f"""log AS (SELECT event_id AS seq, 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
 CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value, CASE WHEN event_type = 'signup' THEN epoch_us(ts) + {7 * DAY} END AS expires_at, epoch_us(ts) AS ts_us, event_type FROM events)"""


def latest_sql(where: str = "true", name: str = "latest", log: str = "log") -> str:
    return f"{name} AS (SELECT key, x.op AS op, x.value AS value, x.expires_at AS expires_at, x.seq AS seq FROM (SELECT key, arg_max({{'op': op, 'value': value, 'expires_at': expires_at, 'seq': seq}}, seq) AS x FROM {log} WHERE {where} GROUP BY key))"


def live_sql(where: str = "true", name: str = "live", log: str = "log") -> str:
    return f"""{name} AS (SELECT key, x.value AS value, x.expires_at AS expires_at, x.seq AS seq FROM (SELECT key, arg_max({{'op': op, 'value': value, 'expires_at': expires_at, 'seq': seq}}, seq) AS x FROM {log} WHERE {where} GROUP BY key)
 WHERE x.op = 'P' AND (x.expires_at IS NULL OR x.expires_at > {AS_OF}))"""


KV = f"WITH {LOG_SQL}, {live_sql()} "
LAG = "lag({}) OVER (PARTITION BY key ORDER BY seq)"
CENTS_SQL = "CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)"
