"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON object in any of several layouts.  Its nested field paths (the schema of its variant, types of
leaves aside) are hashed; the hash selects one declarative mapping that turns the record into canonical turns
(role, text).  Turns are written in one template; the control strings of the template are escaped inside texts and
roles, reversibly, so that a formatted text reads back to exactly its turns.  The loss mask is a list of spans
(code points) of the assistant texts.

Template: ``<s>[INST]`` role ``[/INST]`` text ``</s>`` for each turn.  Escape: a backslash becomes two; in a control
string a backslash follows the first character.

Defined cases: a null text or role is empty; a record that is not JSON, or has an unknown layout, has null turns and
null results; a record without turns formats to an empty text; rows of the same turn number are ordered by role and
text; rows without conv_id form one conversation without id; columns with a name of OWN are left out, others stay; a
record is as large as a variant of Spark may be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import without

#: The control strings of the template.
OPEN, HEAD, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: The columns that the operator adds or uses on its way.
OWN = ("v", "print", "layout", "turns", "parts", "formatted", "loss_spans", "read_turns", "loss_text")


@dataclass(frozen=True)
class Layout:
    """A known layout: its fields (as the schema of a variant prints them) and SQL over ``v`` that makes its turns."""

    name: str
    fields: str
    turns: str


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _field(path: str) -> str:
    return f"try_variant_get(v, '$.{path}', 'string')"


#: The registry of declarative mappings.
LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>", "transform(try_variant_get(v, '$.messages', 'array<struct<role: string, content: string>>'), m -> named_struct('role', coalesce(m.role, ''), 'text', coalesce(m.content, '')))"),
    Layout("from_value", "OBJECT<conversations: ARRAY<OBJECT<from: STRING, value: STRING>>>", "transform(try_variant_get(v, '$.conversations', 'array<struct<`from`: string, value: string>>'), m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.`from`, '') END, 'text', coalesce(m.value, '')))"),
    Layout("prompt_response", "OBJECT<prompt: STRING, response: STRING>", f"array({_turn("'user'", _field('prompt'))}, {_turn("'assistant'", _field('response'))})"),
    Layout("prompt_completion", "OBJECT<completion: STRING, prompt: STRING>", f"array({_turn("'user'", _field('prompt'))}, {_turn("'assistant'", _field('completion'))})"),
    Layout("instruction", "OBJECT<instruction: STRING, output: STRING>", f"array({_turn("'user'", _field('instruction'))}, {_turn("'assistant'", _field('output'))})"),
    Layout("instruction_input", "OBJECT<input: STRING, instruction: STRING, output: STRING>", f"array({_turn("'user'", f"concat_ws('\\n\\n', {_field('instruction')}, nullif({_field('input')}, ''))")}, {_turn("'assistant'", _field('output'))})"),
    Layout("system_question", "OBJECT<question: STRING, response: STRING, system_prompt: STRING>", f"array({_turn("'system'", _field('system_prompt'))}, {_turn("'user'", _field('question'))}, {_turn("'assistant'", _field('response'))})"),
)


def fingerprint(variant: Column) -> Column:
    """Hash of the nested field paths of a variant; a null leaf counts as a string."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(variant), r"\bVOID\b", "STRING"))


def canonical(records: DataFrame, json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout (name) and turns (array of role, text), both null where no mapping fits.

    Columns of ``records`` that have the name of one of the operator's own are left out, the others stay.
    """
    kept = without(records.withColumn("_json", F.col(f"`{json_col}`")), *OWN)
    out = kept.withColumn("v", F.try_parse_json("_json")).withColumn("print", fingerprint(F.col("v")))
    layout, turns = "CASE", "CASE"
    for x in layouts:
        same = f"print = xxhash64('{x.fields}')"
        layout += f" WHEN {same} THEN '{x.name}'"
        turns += f" WHEN {same} THEN {x.turns}"
    empty = "print = xxhash64('OBJECT<messages: ARRAY<STRING>>')"  # no message at all
    return out.withColumn("layout", F.expr(f"{layout} WHEN {empty} THEN 'messages' END")).withColumn("turns", F.expr(f"{turns} WHEN {empty} THEN cast(array() AS array<struct<role: string, text: string>>) END")).drop("v", "print", "_json")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escape(x: str) -> str:
    """SQL that escapes the string expression ``x``."""
    any_control = r"(?=<s>|</s>|\[INST\]|\[/INST\])(.)"
    return f"regexp_replace(replace({x}, {_sql(chr(92))}, {_sql(chr(92) * 2)}), {_sql(any_control)}, {_sql('$1' + chr(92) * 2)})"


def unescape(x: str) -> str:
    return f"regexp_replace({x}, {_sql('(?s)' + chr(92) * 2 + '(.)')}, '$1')"


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds formatted (string) and loss_spans (array of start, length in code points)."""
    parts = f"transform({turns}, t -> named_struct('head', concat('{OPEN}{HEAD}', {escape('t.role')}, '{TEXT}'), 'body', {escape('t.text')}, 'loss', t.role = 'assistant'))"
    text = f"array_join(transform(parts, p -> concat(p.head, p.body, '{CLOSE}')), '')"
    start = "cast(named_struct('at', 0, 'spans', array()) AS struct<at: bigint, spans: array<struct<start: bigint, length: bigint>>>)"
    step = f"named_struct('at', s.at + char_length(p.head) + char_length(p.body) + {len(CLOSE)}, 'spans', if(p.loss, concat(s.spans, array(named_struct('start', s.at + char_length(p.head), 'length', cast(char_length(p.body) AS bigint)))), s.spans))"
    return df.withColumn("parts", F.expr(parts)).withColumn("formatted", F.expr(text)).withColumn("loss_spans", F.expr(f"aggregate(parts, {start}, (s, p) -> {step}, s -> s.spans)")).drop("parts")


def read_back(df: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Adds read_turns (array of role, text) and loss_text (all text under the mask, unescaped), from the output alone."""
    pieces = f"filter(split({formatted}, '{CLOSE}'), x -> x <> '')"
    turn = f"named_struct('role', {unescape(f"substring(substring_index(x, '{TEXT}', 1), {len(OPEN + HEAD) + 1})")}, 'text', {unescape(f"substring(x, char_length(substring_index(x, '{TEXT}', 1)) + {len(TEXT) + 1})")})"
    loss = f"array_join(transform({spans}, s -> {unescape(f'substring({formatted}, cast(s.start + 1 AS int), cast(s.length AS int))')}), '')"
    return df.withColumn("read_turns", F.expr(f"transform({pieces}, x -> {turn})")).withColumn("loss_text", F.expr(loss))


def records_from_rows(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as records of the layout ``messages``: conv_id, record (JSON)."""
    message = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), message.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return listed.select("conv_id", F.to_json(F.struct(F.expr("transform(m, x -> named_struct('content', x.text, 'role', x.role))").alias("messages"))).alias("record"))


def digests(df: DataFrame) -> DataFrame:
    """n_turns, digests and sizes of read-back conversations."""
    joined = r"array_join(transform(read_turns, t -> concat(t.role, '\n', t.text, '\n')), '')"
    return df.select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(F.expr(joined), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "layout")
