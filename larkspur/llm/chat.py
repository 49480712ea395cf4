r"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths.

The fingerprint is a hash of the sorted field paths with their types. A registry maps it to a
declarative mapping: Spark SQL expressions that turn one layout into canonical turns. Two kinds of
input exist: tables, whose schema is fingerprinted once, and rows that each hold a JSON record,
which are fingerprinted one by one from the record's own variant schema.

Format: ``<|im_start|>role\ntext<|im_end|>\n`` for each turn. A control string inside a text or a
role is a ``<`` with k >= 0 backslashes and a ``|`` behind it; escaping adds one backslash, reading
takes it off, so no text can close its turn and every text comes back unchanged. A line feed in a
role is written ``<|nl|>``, which no escaped text can hold.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text) with null
turns first, so repeated rows stay as repeated turns; null conversation ids form one conversation;
an empty table gives an empty result; unused columns are dropped, so their names can't clash; a
layout without a mapping raises an error for tables and gives null turns for JSON rows.

Only DataFrame and SQL functions run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes canonical turns: ``turns`` is a SQL expression of type TURNS over the layout's fields.

    rows: the layout has a row for each turn; ``turns`` then gives the one turn of a row, as a struct, and the rows of a conversation are put together in the order of ``order``.
    """

    name: str
    turns: str
    key: str | None = None
    order: str | None = None


def _paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{at}.{f.name.lower()}")]
    if isinstance(kind, T.ArrayType):
        return _paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return _paths(kind.keyType, f"{at}{{k}}") + _paths(kind.valueType, f"{at}{{v}}")
    word = "number" if isinstance(kind, T.NumericType) else kind.simpleString()
    return [f"{at}:{word}"]


def fingerprint(schema: T.StructType, fields: set[str] | None = None) -> str:
    """Hash of the sorted nested field paths; ``fields`` limits it to top-level fields of that name."""
    kept = T.StructType([f for f in schema.fields if fields is None or f.name.lower() in fields])
    return hashlib.sha256("\n".join(sorted(_paths(kept))).encode()).hexdigest()[:16]


#: Table layouts: (schema of the fields that matter, as DDL, mapping).
TABLE_LAYOUTS: list[tuple[str, Mapping]] = [
    ("conv_id long, turn long, role string, text string", Mapping("turn_rows", "struct(coalesce(role, '') as role, coalesce(text, '') as text)", "conv_id", "turn")),
    ("id long, messages array<struct<role:string,content:string>>", Mapping("messages", "transform(messages, m -> struct(coalesce(m.role, '') as role, coalesce(m.content, '') as text))", "id")),
    ("id long, conversations array<struct<from:string,value:string>>", Mapping("from_value", "transform(conversations, m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else coalesce(m.from, '') end as role, coalesce(m.value, '') as text))", "id")),
    ("id long, prompt string, response string", Mapping("prompt_response", "array(struct('user' as role, coalesce(prompt, '') as text), struct('assistant' as role, coalesce(response, '') as text))", "id")),
    ("id long, instruction string, input string, output string", Mapping("instruction", "array(struct('user' as role, concat(coalesce(instruction, ''), if(coalesce(input, '') = '', '', concat('\\n\\n', input))) as text), struct('assistant' as role, coalesce(output, '') as text))", "id")),
]

#: JSON layouts: (sample record whose variant schema is the layout's, mapping over the variant column ``v``).
JSON_LAYOUTS: list[tuple[str, Mapping]] = [
    ('{"messages":[{"content":"a","role":"b"}]}', Mapping("messages", f"transform(variant_get(v, '$.messages', 'array<struct<role:string,content:string>>'), m -> struct(m.role as role, m.content as text))")),
    ('{"conversations":[{"from":"a","value":"b"}]}', Mapping("from_value", "transform(variant_get(v, '$.conversations', 'array<struct<from:string,value:string>>'), m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))")),
    ('{"prompt":"a","response":"b"}', Mapping("prompt_response", "array(struct('user' as role, variant_get(v, '$.prompt', 'string') as text), struct('assistant' as role, variant_get(v, '$.response', 'string') as text))")),
    ('{"instruction":"a","output":"b"}', Mapping("instruction", "array(struct('user' as role, variant_get(v, '$.instruction', 'string') as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))")),
    ('{"input":"c","instruction":"a","output":"b"}', Mapping("instruction_input", "array(struct('user' as role, concat(variant_get(v, '$.instruction', 'string'), if(variant_get(v, '$.input', 'string') = '', '', concat('\\n\\n', variant_get(v, '$.input', 'string')))) as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))")),
]


def canonical_turns(df: DataFrame, layouts: list[tuple[str, Mapping]] | None = None) -> DataFrame:
    """(key, turns, layout) of a table in any registered layout; extra columns are ignored."""
    for ddl, m in TABLE_LAYOUTS if layouts is None else layouts:
        schema = T.StructType.fromDDL(ddl)
        names = {f.name.lower() for f in schema.fields}
        if fingerprint(df.schema, names) != fingerprint(schema):
            continue
        tag = F.lit(m.name).alias("layout")
        if m.order is None:
            return df.select(F.col(m.key), F.expr(m.turns).alias("turns"), tag)
        rows = df.select(F.col(m.key), F.struct(F.col(m.order).alias("at"), F.expr(m.turns).alias("said")).alias("__t"))
        # A conversation becomes one formatted string, so its turns have to meet in one row.
        made = rows.groupBy(m.key).agg(F.sort_array(F.collect_list("__t")).alias("__all"))
        return made.select(m.key, F.col("__all.said").alias("turns"), tag)
    raise ValueError(f"no mapping for the layout {fingerprint(df.schema)}: {df.schema.simpleString()}")


def canonical_turns_json(df: DataFrame, key: str = "id", record: str = "record", layouts: list[tuple[str, Mapping]] | None = None) -> DataFrame:
    """(key, turns, layout) of rows that each hold a JSON record; rows of an unknown layout get null turns and layout null."""
    rows = df.select(F.col(key), F.try_parse_json(F.col(record)).alias("v")).withColumn("__print", F.xxhash64(F.expr("schema_of_variant(v)")))
    turns, tag = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for sample, m in JSON_LAYOUTS if layouts is None else layouts:
        hit = F.col("__print") == F.xxhash64(F.expr(f"schema_of_variant(parse_json('{sample}'))"))
        turns, tag = F.when(hit, F.expr(m.turns)).otherwise(turns), F.when(hit, F.lit(m.name)).otherwise(tag)
    clean = F.transform(F.col("__turns"), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return rows.select(key, turns.alias("__turns"), tag.alias("layout")).select(key, clean.alias("turns"), "layout")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_turns(df: DataFrame, turns: str = "turns", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted (string) and loss_spans (array of start and length in code points, one for each turn that is learned from)."""
    kept = [c for c in df.columns if c != turns]
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    parts = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END) + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "__p",
        zero,
        lambda a, p: F.struct(
            (a["at"] + size(p)).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    joined = F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return df.select(*kept, parts.alias("__p")).select(*kept, joined.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    role = lambda p: unescape(F.replace(F.substring_index(p, "\n", 1), F.lit(NEWLINE), F.lit("\n")))
    text = lambda p: unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, span by span, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
