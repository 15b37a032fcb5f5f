r"""Chat formatting with DataFrame functions only.

Records arrive as JSON strings in unlike layouts. The sorted set of a record's
field paths (fields of the record, and of every element of its arrays of objects;
a field that holds a list or an object is marked, and elements with unlike fields
are told apart) is hashed; the hash selects a declarative mapping to canonical turns.
Canonical turns are rendered as

    ### role: text</turn>

with every control string inside a role or text escaped, so that the output
can be split and unescaped again without loss:

    \ becomes \b,  </turn> becomes \t,  "### " becomes \h   (and in roles  ": "  becomes \c)

Defined results: a null text or role is empty; a record that is null, is not a
JSON object or has an unknown fingerprint has null turns (``layout`` is null
then, and its fingerprint is kept), which covers records whose elements have unlike
fields and texts that are lists or objects; numbers and booleans are their JSON text;
a conversation without turns renders as the empty string; turns keep their order,
equal turns are kept; texts may be of any length; repeated rows are formatted each;
an empty table gives no rows. Columns pass through, except that input columns named
fingerprint, layout, turns, formatted or loss_spans are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
#: layout -> (field paths, kind, source of the turns)
#: kind "list": an array of objects with a role and a text field;
#: kind "fields": one turn for each (role, fields); several fields are joined by a blank line.
LAYOUTS = {
    "messages": (["messages", "messages[].content", "messages[].role"], "list", ("messages", "role", "content")),
    "turns": (["turns", "turns[].role", "turns[].text"], "list", ("turns", "role", "text")),
    "share": (["conversations", "conversations[].from", "conversations[].value"], "list", ("conversations", "from", "value")),
    "prompt_completion": (["completion", "prompt"], "fields", [("user", ["prompt"]), ("assistant", ["completion"])]),
    "prompt_response": (["prompt", "response"], "fields", [("user", ["prompt"]), ("assistant", ["response"])]),
    "instruction": (["input", "instruction", "output"], "fields", [("user", ["instruction", "input"]), ("assistant", ["output"])]),
    "instruction_short": (["instruction", "output"], "fields", [("user", ["instruction"]), ("assistant", ["output"])]),
    "question_answer": (["answer", "question"], "fields", [("user", ["question"]), ("assistant", ["answer"])]),
    "system_prompt": (["prompt", "response", "system"], "fields", [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]),
}
#: Names that other layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LIST_FIELDS = ("messages", "turns", "conversations")
#: Fields that must hold a plain value.
VALUE_FIELDS = sorted({f for _, kind, source in LAYOUTS.values() for f in (source[1:] if kind == "list" else [f for _, many in source for f in many])})
OPEN, CLOSE, MARK = "### ", "</turn>", "\\"


def _paths(record: Column) -> Column:
    """Sorted keys of a JSON object, those of list and object values marked; null for what is no object."""
    keys = F.json_object_keys(record)
    names = [f"`{f}`" for f in VALUE_FIELDS]
    lists = F.from_json(record, "struct<" + ",".join(f"{n}:array<string>" for n in names) + ">")
    objects = F.from_json(record, "struct<" + ",".join(f"{n}:map<string,string>" for n in names) + ">")
    marks = F.array(*[F.when(lists[f].isNotNull(), f + "[]").when(objects[f].isNotNull(), f + "{}") for f in VALUE_FIELDS])
    return F.array_sort(F.array_distinct(F.concat(keys, F.filter(marks, lambda m: m.isNotNull()))))


def _element_paths(elements: Column, name: str) -> Column:
    """Paths of a list's elements: plain where all are alike, else each kind of element by itself."""
    kinds = F.array_distinct(F.transform(elements, lambda e: F.coalesce(F.array_join(_paths(e), "\n"), F.lit("?"))))
    alike = F.transform(F.split(kinds[0], "\n"), lambda key: F.concat(F.lit(f"{name}[]."), key))
    unlike = F.transform(kinds, lambda kind: F.concat(F.lit(f"{name}[]:"), F.replace(kind, F.lit("\n"), F.lit(","))))
    return F.coalesce(F.when(F.size(kinds) == 1, alike).when(F.size(kinds) > 1, unlike), F.array().cast("array<string>"))


def fingerprint(record: Column) -> Column:
    """Hash of the record's sorted nested field paths; null for what is no JSON object."""
    keys = _paths(record)
    parsed = F.from_json(record, "struct<" + ",".join(f"{name}:array<string>" for name in LIST_FIELDS) + ">")
    nested = [_element_paths(parsed[name], name) for name in LIST_FIELDS]
    return F.when(keys.isNotNull(), F.sha2(F.array_join(F.array_sort(F.array_distinct(F.concat(keys, *nested))), "\n"), 256))


def known(paths: list[str]) -> Column:
    return F.sha2(F.lit("\n".join(sorted(paths))), 256)


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(MARK + "b"))
    text = F.replace(text, F.lit(CLOSE), F.lit(MARK + "t"))
    return F.replace(text, F.lit(OPEN), F.lit(MARK + "h"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(MARK + "c"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit(MARK + "c"), F.lit(": "))
    text = F.replace(text, F.lit(MARK + "h"), F.lit(OPEN))
    text = F.replace(text, F.lit(MARK + "t"), F.lit(CLOSE))
    return F.replace(text, F.lit(MARK + "b"), F.lit(MARK))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turn_of(role: str, text: str, names: Column | None):
    """Turn of an array element; ``names`` maps the layout's role names."""

    def turn(element: Column) -> Column:
        said = element[role]
        return _turn(said if names is None else F.coalesce(F.try_element_at(names, F.coalesce(said, F.lit(""))), said), element[text])

    return turn


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Add fingerprint, layout and turns (array of role and text)."""
    raw = F.col(record)
    out = records.withColumn("fingerprint", fingerprint(raw))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    for name, (paths, kind, source) in LAYOUTS.items():
        if kind == "list":
            field, role, text = source
            parsed = F.from_json(raw, f"struct<{field}:array<struct<`{role}`:string,`{text}`:string>>>")[field]
            made = F.transform(parsed, _turn_of(role, text, names if role == "from" else None))
        else:
            fields = sorted({f for _, many in source for f in many})
            parsed = F.from_json(raw, "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">")
            made = F.array(
                *[
                    _turn(
                        F.lit(role),
                        F.concat_ws("\n\n", *[F.nullif(parsed[f], F.lit("")) if len(many) > 1 else parsed[f] for f in many]),
                    ) for role, many in source
                ]
            )
        hit = F.col("fingerprint") == known(paths)
        if kind == "list":  # without elements there are no nested paths
            hit = hit | (F.col("fingerprint") == known([paths[0]])) & (F.size(made) == 0)
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, made).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(": "), escape(t["text"]), F.lit(CLOSE))), "")


def mask(turns: Column, trained: str = "assistant") -> Column:
    """Spans (start, length) in code points of the rendered string that hold text of the trained role."""
    head = F.length(F.lit(OPEN)) + F.length(F.lit(": "))
    sized = F.transform(
        turns,
        lambda t: F.struct(
            (F.length(escape_role(t["role"])) + head).alias("lead"), F.length(escape(t["text"])).alias("body"), (t["role"] == trained).alias("train")
        ),
    )
    spans = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["lead"] + t["body"] + F.length(F.lit(CLOSE))).alias("at"),
            F.when(
                t["train"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["lead"]).alias("start"), t["body"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return spans["spans"]


def read_back(formatted: Column) -> Column:
    """The turns of a rendered string."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 2147483647))
    return F.transform(
        body,
        lambda b: F.struct(
            unescape(F.substring_index(b, ": ", 1)).alias("role"),
            unescape(F.substring(b, F.locate(": ", b) + 2, F.lit(2147483647))).alias("text"),
        ),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text that the loss mask covers, joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_chat(records: DataFrame, record: str = "record") -> DataFrame:
    """Add fingerprint, layout, turns, formatted and loss_spans to JSON records."""
    out = canonical(records, record)
    return out.withColumn("formatted", render(F.col("turns"))).withColumn("loss_spans", mask(F.col("turns")))


def rows_to_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record of the ``messages`` layout for each conversation.

    A conversation is one string in the output, so its turns meet in one row;
    turns with equal numbers follow in order of role, then text.
    """
    spoken = F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(spoken)).alias("said"))
    said = F.transform("said", lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content")))
    return grouped.select(key, F.to_json(F.struct(said.alias("messages"))).alias("record"))
