"""Chat formatting, native throughout: layouts are recognised by a fingerprint of their nested field paths.

A layout is a set of nested field paths, named by the hash of them sorted. What is read has a layout if its paths, but
for those the layout does not know, have that hash; so other fields do not hide a layout, and of several the first
in LAYOUTS holds. Each layout has a declarative mapping to canonical turns (role, text): typed frames are recognised
from their schema, JSON records one by one from the fields of all their elements (an empty list has any), and a record
of unknown layout gets null turns. Turns are written as

    <|turn|>ROLE<|text|>TEXT<|end|>\\n        or, for a text that is trained on,
    <|turn|>ROLE<|learn|>TEXT<|end|>\\n

so the loss mask is the text between <|learn|> and <|end|> and can be read back from the output. Control
strings inside roles and texts, these and those of common chat templates, get a backslash after their first
character; one that has backslashes there already gets one more, which makes the escape reversible.

Turns of a conversation stand in ascending turn, nulls first, and on ties by role and text; a null role or
text is an empty one. A conversation is one row of the result, whatever its length.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, PLAIN, LEARN, CLOSE = "<|turn|>", "<|text|>", "<|learn|>", "<|end|>\n"
LEARNED = "assistant"
_TAIL = "\\\\*(?:\\||/?s>)"
_TAIL2 = "\\\\*/?INST\\]"
_ESCAPE = f"(?<=<)(?={_TAIL})|(?<=\\[)(?={_TAIL2})"
_UNESCAPE = f"(?<=<)\\\\(?={_TAIL})|(?<=\\[)\\\\(?={_TAIL2})"
TURNS = "array<struct<role:string,text:string>>"

#: Layouts, in the order they are tried: field paths, and the canonical turns as SQL over a record's fields, or over all rows
#: of a conversation. [] is an element of an array.
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    "sharegpt": (("conversations[].from", "conversations[].value"), "transform(conversations, m -> named_struct('role', case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end, 'text', m.value))"),
    "rows": (("conv_id", "role", "text", "turn"), "transform(sort_array(collect_list(named_struct('turn', turn, 'role', coalesce(role, ''), 'text', coalesce(text, '')))), t -> named_struct('role', t.role, 'text', t.text))"),
    "instruction_input": (("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', if(coalesce(input, '') = '', instruction, concat(instruction, '\n\n', input))), named_struct('role', 'assistant', 'text', output))"),
    "prompt_system": (("prompt", "response", "system"), "array(named_struct('role', 'system', 'text', system), named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    "instruction": (("instruction", "output"), "array(named_struct('role', 'user', 'text', instruction), named_struct('role', 'assistant', 'text', output))"),
    "prompt": (("completion", "prompt"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', completion))"),
    "prompt_response": (("prompt", "response"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    "question": (("answer", "question"), "array(named_struct('role', 'user', 'text', question), named_struct('role', 'assistant', 'text', answer))"),
}
#: The types under which a layout's JSON is read.
_READ = {"messages": "messages array<struct<role:string,content:string>>", "sharegpt": "conversations array<struct<`from`:string,value:string>>"} | {n: ", ".join(f"{p} string" for p in paths) for n, (paths, _) in LAYOUTS.items() if n != "rows" and "[]" not in paths[0]}


def _hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {name: _hash(paths) for name, (paths, _) in LAYOUTS.items()}


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, down to what is neither struct nor array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{at}[]")
    return [at]


def layout_of(df: DataFrame) -> str:
    """The layout of a typed frame."""
    found = paths(df.schema)
    for name, (known, _) in LAYOUTS.items():
        if _hash(p for p in set(found) if p in known) == FINGERPRINTS[name]:
            return name
    raise ValueError(f"no layout has the fields {found}")


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a typed frame of any layout; layouts but rows need a column conv_id beside theirs."""
    name = layout_of(df)
    mapped = F.expr(LAYOUTS[name][1])
    if name == "rows":
        return df.groupBy("conv_id").agg(mapped.cast(TURNS).alias("turns"))
    return df.select("conv_id", _clean(mapped).alias("turns"))


def turns_of_json(df: DataFrame, json_col: str = "record") -> DataFrame:
    """``df`` with ``layout`` and ``turns`` of each JSON record; both null where no layout has its field paths. Columns of
    these names are replaced."""
    keys = F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")

    def inside(a: str) -> Column:
        """The paths of the fields of an array's elements, all that are known of an empty one."""
        items = F.from_json(json_col, f"{a} array<map<string,string>>")[a]
        names = F.array_distinct(F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), none))))
        known = F.array(*(F.lit(p) for p in sorted({p for paths, _ in LAYOUTS.values() for p in paths if p.startswith(f"{a}[]")})))
        return F.coalesce(F.when(F.size(items) == 0, known).otherwise(F.transform(names, lambda k: F.concat(F.lit(f"{a}[]."), k))), none)

    arrays = sorted({p.split("[]")[0] for paths, _ in LAYOUTS.values() for p in paths if "[]" in p})
    d = df.drop("layout", "turns").withColumn("_textloom_paths", F.array_distinct(F.concat(keys, *[inside(a) for a in arrays])))
    mark = lambda n: F.sha2(F.array_join(F.array_sort(F.array_intersect("_textloom_paths", F.array(*map(F.lit, LAYOUTS[n][0])))), "\n"), 256)
    d = d.withColumn("layout", F.coalesce(*[F.when(mark(n) == FINGERPRINTS[n], F.lit(n)) for n in LAYOUTS if n in _READ]))
    out = F.lit(None).cast(TURNS)
    for n, schema in _READ.items():
        d = d.withColumn(f"_textloom_{n}", F.when(F.col("layout") == n, F.from_json(json_col, schema)))
        out = F.when(F.col("layout") == n, _clean(F.expr(_within(LAYOUTS[n][1], n)))).otherwise(out)
    return d.withColumn("turns", out).drop("_textloom_paths", *[f"_textloom_{n}" for n in _READ])


def _within(sql: str, name: str) -> str:
    """A layout's SQL over the struct _textloom_<name> that its record was read into."""
    import re

    fields = {p.split("[]")[0] for p in LAYOUTS[name][0]}
    parts = re.split(r"('[^']*')", sql)
    return "".join(x if x[:1] == "'" else re.sub(r"(?<![\w.`])(" + "|".join(sorted(fields, key=len, reverse=True)) + r")(?![\w(])", rf"_textloom_{name}.\1", x) for x in parts)


def _clean(t: Column) -> Column:
    return F.transform(t, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))).cast(TURNS)


def escape(c) -> Column:
    return F.regexp_replace(c, _ESCAPE, "\\\\")


def unescape(c) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "")


def formatted(t: DataFrame) -> DataFrame:
    """``t`` (conv_id, turns) with its turns written out as ``formatted``."""
    one = lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.when(x["role"] == LEARNED, LEARN).otherwise(PLAIN), escape(x["text"]), F.lit(CLOSE))
    return t.withColumn("formatted", F.array_join(F.transform("turns", one), ""))


def read_back(f: DataFrame) -> DataFrame:
    """``f`` with ``turns`` (role, text, learned) as they can be read from ``formatted`` alone."""
    pieces = F.filter(F.split("formatted", CLOSE.replace("|", "\\|")), lambda p: p != "")
    d = f.withColumn("_textloom_p", F.transform(pieces, lambda p: F.split(F.substring(p, len(OPEN) + 1, 2**31 - 1), "<\\|(?:text|learn)\\|>")))
    d = d.withColumn("_textloom_l", F.transform(pieces, lambda p: F.contains(p, F.lit(LEARN))))
    return d.withColumn("turns", F.zip_with("_textloom_p", "_textloom_l", lambda p, m: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"), m.alias("learned")))).drop("_textloom_p", "_textloom_l")


def op7(spark, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(formatted(turns(rows.unionByName(extra))).drop("turns"))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("_textloom_loss", learned).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_textloom_loss").cast("long").alias("loss_chars"), F.sha2("_textloom_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, len(regexp_extract_all(role || chr(10) || text, '<\\*(\||/?s>)|\[\\*/?INST\]')) AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(CLOSE)} + length(role) + length(text) + esc + CASE WHEN role = 'assistant' THEN {len(LEARN)} ELSE {len(PLAIN)} END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
QUERIES = {"op7_chat_formatting": op7}
ORACLES = {"op7_chat_formatting": SQL}
