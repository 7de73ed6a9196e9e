"""The registered queries of the training-data operators: ``queries()`` and ``oracle_sql()``.

Each applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import tokenfiles

    return tokenfiles.read(tokenfiles.write(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import neighbours

    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import chat

    rows = chat.records_from_rows(table(spark, sf_dir, "conversations"))
    extra = spark.range(1).selectExpr("cast(-7 AS bigint) AS conv_id", """to_json(named_struct('prompt', '</s>[INST] ok [/INST]', 'response', '</s>[INST] ok [/INST]')) AS record""")
    return chat.digests(chat.read_back(chat.format_turns(chat.canonical(rows.union(extra)))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), use=~toxicity.held_out())
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import bpe

    return bpe.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), digests=True)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(language.teaching()))
    return language.predict(docs, model).withColumn("held_out", language.held_out())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.llm import htmltext

    return htmltext.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_near_duplicates": op2_near_duplicates, "op3_token_files": op3_token_files, "op4_neighbours": op4_neighbours, "op5_chat_format": op5_chat_format, "op6_toxicity": op6_toxicity, "op7_quality_rules": op7_quality_rules, "op8_bpe": op8_bpe, "op9_language": op9_language, "op10_html_text": op10_html_text}


#: Links on full sets of distinct two-word shingles, then everything that is reachable.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE
cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g
  FROM cut
),
shingles AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach(v, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v
),
class AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT sets.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN class ON class.v = sets.doc_id
"""

#: A turn's frame has 20 characters, and every backslash and every control string inside it one more.
CHAT_FORMAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
  UNION ALL
  SELECT -7, turn, role, '</s>[INST] ok [/INST]', 'prompt_response' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)
),
sized AS (
  SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')) AS chars
  FROM turns
),
joined AS (
  SELECT conv_id, layout, count(*) AS n, sum(chars) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM sized
  GROUP BY conv_id, layout
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, layout
FROM joined
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others' tests use brute force or held-out labels."""
    return {"op2_near_duplicates": NEAR_DUPLICATES_SQL, "op5_chat_format": CHAT_FORMAT_SQL}
