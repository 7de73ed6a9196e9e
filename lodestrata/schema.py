"""Fixed schemas of the engine's tables."""

KV_LOG = "seq BIGINT, ord INT, key STRING, op STRING, value STRING, expires_at BIGINT"
TS_POINTS = "series STRING, ts_us BIGINT, value DOUBLE"
EDGES = "src BIGINT, dst BIGINT, weight DOUBLE"
SCORES = "board STRING, member STRING, score BIGINT"
MEMBERS = "coll STRING, member STRING"
MULTIMAP = "key STRING, value STRING"
BITS = "name STRING, bit BIGINT"
DOCS = "doc_id STRING, text STRING"
