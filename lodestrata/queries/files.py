"""Export and import, backups, manifests, compaction filters, checked records, counters of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import metrics
from lodestrata.inputs import AS_OF, DAY, KV, LOG_SQL, kv_log, latest_sql, live, live_sql, pair
from lodestrata.operators import manifest
from lodestrata.plans import log as kv
from lodestrata.plans.scratch import Tables
from lodestrata.queries.store import WORLDS
from lodestrata.registry import add
from lodestrata.sources import jsonl
from lodestrata.store import Store

_FIELDS = ("seq", "ord", "key", "op", "value", "expires_at")


def _log(s: SparkSession, d: str) -> DataFrame:
    return kv_log(s, d).select(*_FIELDS)


def _folder(s: SparkSession, label: str) -> str:
    return f"{Tables(s, label).path}/out"


# --- JSON lines and backups -----------------------------------------------------------------------------------------------------
def _export(s: SparkSession, d: str) -> DataFrame:
    """The lines of an export, as they stand in the files."""
    path = _folder(s, "export")
    Store(_log(s, d), AS_OF).export(path, "user:000010", "user:000100")
    return s.read.text(path).select(F.col("value").alias("line"))


def _export_count(s: SparkSession, d: str) -> DataFrame:
    n = Store(_log(s, d), AS_OF).export(_folder(s, "export"))
    return s.range(1).select(F.lit(n).cast("long").alias("n"))


def _import(s: SparkSession, d: str) -> DataFrame:
    """An export of the early store, imported with a time to live into the present one."""
    path, store = _folder(s, "import"), Store(_log(s, d), AS_OF)
    store.snapshot(5000).export(path)
    return store.state(jsonl.batch(s, path, AS_OF, DAY))


def _ns_export(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "export")
    WORLDS["ns"].store(s, d).export(path)
    return jsonl.read(s, path)


def _restored(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "backup")
    jsonl.backup(_log(s, d), path)
    return pair(kv.live(jsonl.restore(s, path), AS_OF))


def _disk(s: SparkSession, d: str) -> DataFrame:
    """Files of the change log on disk: number and bytes."""
    return jsonl.files(s, f"{d}/events.parquet").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


_LINE = """'{"k":"' || key || '","v":"' || value || '"}' AS line"""
add("kv_export", _export, KV + f"SELECT {_LINE} FROM live WHERE key >= 'user:000010' AND key < 'user:000100'")
add("kv_export_count", _export_count, KV + "SELECT count(*) AS n FROM live")
add("kv_import", _import, f"WITH {LOG_SQL}, {live_sql()}, {live_sql('seq <= 5000', 'early')} SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT key FROM early) UNION ALL SELECT key, value, CAST({AS_OF + DAY} AS BIGINT) FROM early")
add("ns_export", _ns_export, WORLDS["ns"].sql("SELECT key, value FROM live", False))
add("kv_backup_restore", _restored, KV + "SELECT key, value FROM live")
add("kv_size_on_disk", _disk, None)  # SQL does not see files
add("kv_estimate_key_count", lambda s, d: _log(s, d).agg(F.count(F.lit(1)).alias("at_most")), "SELECT count(*) AS at_most FROM events")

# --- manifests --------------------------------------------------------------------------------------------------------------------
_COMMITS, _LEVELS = 250, 4


def _files(s: SparkSession, d: str) -> DataFrame:
    return manifest.of_log(_log(s, d), _COMMITS, _LEVELS)


def _narrow(s: SparkSession, d: str) -> DataFrame:
    """Files of few commits, so that some ranges are apart."""
    return manifest.of_log(_log(s, d), 3, _LEVELS)


def _sql(commits: int) -> str:
    return f"WITH {LOG_SQL}, m AS (SELECT seq // {commits} AS file, min(key) AS first_key, max(key) AS last_key, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes, CAST(seq // {commits} % {_LEVELS} AS INT) AS level FROM log GROUP BY ALL) "


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    m = _narrow(s, d)
    low = m.where((F.col("level") == 1) & (F.col("bytes") < 60))
    return manifest.overlapping(m.where("level = 0"), low)


add("mf_files", _files, _sql(_COMMITS) + "SELECT file, first_key, last_key, bytes, level FROM m")
add("mf_level_sizes", lambda s, d: manifest.level_sizes(_files(s, d)), _sql(_COMMITS) + "SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM m GROUP BY level")
add("mf_sorted_level", lambda s, d: manifest.sorted_level(_files(s, d), 1).select("file", "first_key"), _sql(_COMMITS) + "SELECT file, first_key FROM m WHERE level = 1")
add("mf_overlapping", _overlaps, _sql(3) + "SELECT file FROM m WHERE level = 0 AND EXISTS (SELECT 1 FROM m r WHERE r.level = 1 AND r.bytes < 60 AND r.first_key <= m.last_key AND r.last_key >= m.first_key)")
add("mf_validate", lambda s, d: manifest.differences(_files(s, d).where("bytes >= 4000"), _files(s, d).where("level <> 2").select("file")), _sql(_COMMITS) + "SELECT file, 'missing' AS issue FROM m WHERE bytes >= 4000 AND level = 2 UNION ALL SELECT file, 'orphan' FROM m WHERE level <> 2 AND NOT bytes >= 4000")

# --- compaction, records, counters ------------------------------------------------------------------------------------------------
add("kv_compaction_filter", lambda s, d: kv.compact(_log(s, d), AS_OF, True, F.length("value") > 5, F.concat(F.lit("<"), "value", F.lit(">"))).select("key", "value"), KV + "SELECT key, '<' || value || '>' AS value FROM live WHERE length(value) > 5")


def _records(s: SparkSession, d: str) -> DataFrame:
    """Checked records of the log, of which one is spoilt."""
    return kv.record(_log(s, d)).withColumn("crc", F.when(F.col("seq") == 777, F.col("crc") + 1).otherwise(F.col("crc")))


add("wal_replay", lambda s, d: kv.replay(_records(s, d)), f"WITH {LOG_SQL} SELECT seq, op, key, value FROM log WHERE seq < 777")
add("wal_record", lambda s, d: kv.record(_log(s, d)).select("seq", F.md5("payload").alias("payload_md5")), f"WITH {LOG_SQL} SELECT seq, md5(op || chr(1) || key || chr(1) || coalesce(value, '') || chr(1) || coalesce(CAST(expires_at AS VARCHAR), '')) AS payload_md5 FROM log")
add("engine_levels", lambda s, d: metrics.engine(_log(s, d).withColumn("level", (F.floor(F.col("seq") / _COMMITS) % _LEVELS).cast("int"))), f"WITH {LOG_SQL} SELECT CAST(seq // {_COMMITS} % {_LEVELS} AS INT) AS level, count(*) FILTER (op = 'P') AS puts, count(*) FILTER (op = 'D') AS deletes, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM log GROUP BY ALL")


def _engine(s: SparkSession, d: str) -> DataFrame:
    """One row: puts, deletes, gets of all customers with their hits, entries of a scan, bytes written and kept."""
    log, now = _log(s, d), live(s, d)
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    written = log.agg(F.count_if(F.col("op") == "P").alias("puts"), F.count_if(F.col("op") == "D").alias("deletes"), F.sum(size).cast("long").alias("bytes_written"))
    kept = now.agg(F.count(F.lit(1)).alias("scan_entries"), F.sum(size).cast("long").alias("bytes_kept"))
    return written.join(F.broadcast(kept)).withColumn("space_amplification", F.round(F.col("bytes_written") / F.col("bytes_kept"), 2))  # one row each


add("engine_snapshot", _engine, f"WITH {LOG_SQL}, {live_sql()}, w AS (SELECT count(*) FILTER (op = 'P') AS puts, count(*) FILTER (op = 'D') AS deletes, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes_written FROM log), k AS (SELECT count(*) AS scan_entries, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes_kept FROM live) SELECT *, round(bytes_written / bytes_kept, 2) AS space_amplification FROM w, k")
add("cursor_seek_prefix", lambda s, d: pair(live(s, d).where(F.col("key") >= "user:00012")).orderBy("key"), KV + "SELECT key, value FROM live WHERE key >= 'user:00012'")
add("kv_states", lambda s, d: kv.latest(_log(s, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expires_at").isNotNull()).alias("expiring")), f"WITH {LOG_SQL}, {latest_sql()} SELECT op, count(*) AS n, count(expires_at) AS expiring FROM latest GROUP BY op")
