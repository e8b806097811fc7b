"""Chat formatting: layouts by schema fingerprint, a template with reversible escapes, a loss mask. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, COLON, END = "### ", ": ", "</turn>"
#: Control strings and what stands for them in texts; the backslash comes first. In roles, colons too.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), (END, "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def _said(*parts: tuple[str, str]) -> str:
    turns = ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in parts)
    return f"filter(array({turns}), t -> t.text is not null)"


def _listed(field: str, role: str, text: str) -> str:
    return f"transform(filter({field}, m -> m is not null), m -> named_struct('role', m.{role}, 'text', m.{text}))"


def _either(field: str) -> str:
    """Each element by its own key, content or text; no turns if one has both."""
    both = f"exists({field}, m -> coalesce(m.content is not null and m.text is not null, false))"
    said = f"transform(filter({field}, m -> m is not null), m -> named_struct('role', m.role, 'text', coalesce(m.content, m.text)))"
    return f"if({both}, null, {said})"


#: The field paths of a layout, and SQL over the parsed record r that makes its turns.
LAYOUTS = {
    "messages": (("messages[].role", "messages[].content"), _listed("r.messages", "role", "content")),
    "messages_text": (("messages[].role", "messages[].text"), _listed("r.messages", "role", "text")),
    "messages_speaker": (("messages[].speaker", "messages[].content"), _listed("r.messages", "speaker", "content")),
    "messages_from": (("messages[].from", "messages[].value"), _listed("r.messages", "`from`", "value")),
    "conversations": (("conversations[].from", "conversations[].value"), _listed("r.conversations", "`from`", "value")),
    "system_messages": (("system", "messages[].role", "messages[].content"), f"concat({_said(('system', 'r.system'))}, {_listed('r.messages', 'role', 'content')})"),
    "messages_mixed": (("messages[].role", "messages[].content", "messages[].text"), _either("r.messages")),
    "system_messages_mixed": (("system", "messages[].role", "messages[].content", "messages[].text"), f"concat({_said(('system', 'r.system'))}, {_either('r.messages')})"),
    "prompt_completion": (("prompt", "completion"), _said(("user", "r.prompt"), ("assistant", "r.completion"))),
    "prompt_response": (("prompt", "response"), _said(("user", "r.prompt"), ("assistant", "r.response"))),
    "question_answer": (("question", "answer"), _said(("user", "r.question"), ("assistant", "r.answer"))),
    "instruction_output": (("instruction", "output"), _said(("user", "r.instruction"), ("assistant", "r.output"))),
    "instruction_input_output": (("instruction", "input", "output"), _said(("user", "concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))"), ("assistant", "r.output"))),
}
_RECORD = (
    "struct<messages:array<struct<role:string,content:string,text:string,speaker:string,`from`:string,value:string>>,conversations:array<struct<`from`:string,value:string>>,"
    "system:string,prompt:string,completion:string,response:string,question:string,answer:string,instruction:string,input:string,output:string>"
)
#: Names that tables of one turn a row have for the conversation and for the order of its turns.
CONVERSATION, ORDER = ("conv_id", "conversation_id", "dialog_id"), ("turn", "turn_id", "position")
#: Their other columns that a layout reads: who speaks, and what.
SPEAKER, SAID = ("role", "speaker", "from"), ("text", "content", "value")


def fingerprint(paths: Column) -> Column:
    """SHA-256 of the distinct, lower-cased field paths (array<string>) in order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform(paths, F.lower))), "\n"), 256)


def json_paths(record: Column) -> Column:
    """Leaf paths of a JSON object as the layouts have them: its keys, and the keys of all the objects in its lists.

    Null elements have none. Null where the record is null or no object.
    """

    def paths(key: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), key, F.lit("']")))
        elements = F.from_json(F.when(F.ltrim(value).startswith("["), value), "array<map<string,string>>")
        inner = F.array_distinct(F.flatten(F.transform(F.filter(elements, lambda m: m.isNotNull()), F.map_keys)))
        return F.when(F.size(inner) > 0, F.transform(inner, lambda x: F.concat(key, F.lit("[]."), x))).otherwise(F.array(key))

    return F.flatten(F.transform(F.json_object_keys(record), paths))


def struct_paths(record: Column, kind: T.StructType) -> Column:
    """Leaf paths of a struct column, named as json_paths() names them: its fields that are not null, and the fields of the
    structs in its lists. Null where the record is null."""
    parts = []
    for f in kind.fields:
        listed = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        names = [f"{f.name}[].{g.name}" for g in f.dataType.elementType.fields] if listed else [f.name]
        parts.append(F.when(record[f.name].isNotNull(), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")))
    return F.when(record.isNotNull(), F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>"))


def _shaped(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """The value with the fields of the wanted type, null where it has none."""
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        named = {f.name.lower(): f for f in have.fields}
        fields = [(_shaped(value[named[w.name].name], named[w.name].dataType, w.dataType) if w.name in named else F.lit(None).cast(w.dataType)).alias(w.name) for w in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _shaped(x, have.elementType, want.elementType))
    nested = isinstance(want, (T.StructType, T.ArrayType)) or isinstance(have, (T.StructType, T.ArrayType, T.MapType))
    return F.lit(None).cast(want) if nested else value.cast(want)


def canonical_turns(records: DataFrame, record_col: str = "record", ignore=("id", "meta", "source", "lang"), ignore_listed=("name",), roles: dict[str, str] | None = ROLES) -> DataFrame:
    """The input's columns, and layout (string) and turns (array of role, text), for records of mixed layouts.

    Records are JSON texts or structs. The nested field paths of each record, those in ``ignore`` and keys of listed objects in
    either aside, are hashed, and the hash selects the declarative mapping (LAYOUTS) that makes the turns; the order of fields
    is of no matter. Null, broken and empty records and unknown layouts have a null layout and null turns. In lists, null
    elements are no turns, null texts and roles are ''. Role names are lower-cased and read by ``roles``, or stay as they are
    if that is None. Input columns named layout or turns are replaced; rows that repeat stay.
    """
    keep = [F.col(f"in.{c}").alias(c) for c in records.columns if c.lower() not in ("layout", "turns")]
    rows = records.select(F.struct(*[F.col(c) for c in records.columns]).alias("in"))
    record, kind, want = F.col(f"in.{record_col}"), records.schema[record_col].dataType, T._parse_datatype_string(_RECORD)
    nested = isinstance(kind, T.StructType)
    aside = [*ignore, *ignore_listed]
    paths = struct_paths(record, kind) if nested else json_paths(record)
    paths = F.filter(paths, lambda p: ~F.when(F.contains(p, F.lit("[].")), F.lower(F.substring_index(p, "[].", -1)).isin(*aside)).otherwise(F.lower(p).isin(*ignore)))
    rows = rows.select("in", fingerprint(paths).alias("print"), (_shaped(record, kind, want) if nested else F.from_json(record, want)).alias("r"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (fields, sql) in LAYOUTS.items():
        is_it = F.col("print") == fingerprint(F.array(*[F.lit(p) for p in fields]))
        layout, turns = F.when(is_it, F.lit(name)).otherwise(layout), F.when(is_it, F.expr(sql)).otherwise(turns)

    def clean(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit("")) if roles is None else F.lower(F.coalesce(t["role"], F.lit("")))
        named = F.lit(None).cast("string")
        for a, b in (roles or {}).items():
            named = F.when(role == a, F.lit(b)).otherwise(named)
        return F.struct(F.coalesce(named, role).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return rows.select(*keep, layout.alias("layout"), F.transform(turns, clean).alias("turns"))


def turns_of_rows(table: DataFrame) -> DataFrame:
    """(conv_id, turns) from a table of one turn a row.

    Rows become one record for each conversation, a struct with a list ``messages`` of what the table has of SPEAKER and SAID,
    and canonical_turns() maps it by the hash of its field paths; roles stay as they are. A table without a column of
    CONVERSATION or of ORDER raises ValueError; one of no known layout has null turns. Other columns are of no matter. Turns
    are in the order of the order column, null first, ties by role and text; repeated rows are repeated turns; null roles and
    texts are ''; a null conversation id is a conversation. A conversation becomes one row, whatever its length.
    """
    have = {c.lower(): c for c in table.columns}
    conv, order = (next((have[c] for c in names if c in have), None) for names in (CONVERSATION, ORDER))
    if conv is None or order is None:
        raise ValueError(f"no column for the conversation or the order of turns: {sorted(have)}")
    who, what = ([have[c] for c in names if c in have] for names in (SPEAKER, SAID))
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"by{i}") for i, c in enumerate([*who, *what])]
    message = F.struct(*[F.col(c).cast("string").alias(c.lower()) for c in (*who, *what)]) if who or what else F.struct(F.lit(None).cast("string").alias("none"))
    said = F.sort_array(F.collect_list(F.struct(F.col(order).alias("turn"), *blank, message.alias("message"))))
    records = table.groupBy(F.col(conv).alias("conv_id")).agg(said.alias("said"))
    records = records.select("conv_id", F.struct(F.transform("said", lambda t: t["message"]).alias("messages")).alias("record"))
    return canonical_turns(records, roles=None).select("conv_id", "turns")


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    """Splits at doubled backslashes from the left, so that what is left of a backslash begins a code."""

    def codes(part: Column) -> Column:
        for plain, code in escapes[1:]:
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), codes), "\\")


def format_turns(conversations: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """The input's columns, formatted (string) and loss_mask, from a column turns (array of role, text).

    A turn reads ``### role: text</turn>`` and a newline; control strings inside roles and texts are escaped, so that
    read_back gets every role and text back exactly. loss_mask has an element for each turn: null, or for the roles in
    loss_roles start and length of the text within its turn's segment, in code points from 0. Null turns: null in both;
    no turns: '' and an empty mask.
    """

    def head(t: Column) -> Column:
        return F.concat(F.lit(HEAD), escape(t["role"], ROLE_ESCAPES), F.lit(COLON))

    def mask(t: Column) -> Column:
        return F.when(t["role"].isin(*loss_roles), F.struct(F.char_length(head(t)).alias("start"), F.char_length(escape(t["text"])).alias("length")))

    segments = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END + "\n")))
    return conversations.select("*", F.array_join(segments, "").alias("formatted"), F.transform("turns", mask).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The input's columns, turns_read (array of role, text) and loss_texts (array of string), from formatted and loss_mask."""
    segments = F.filter(F.split("formatted", END + "\n", -1), lambda s: s != "")

    def turn(s: Column) -> Column:
        at = F.locate(COLON, s)
        role, text = F.substring(s, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1)), F.substring(s, at + len(COLON), F.char_length(s))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    marked = F.zip_with(segments, "loss_mask", lambda s, m: F.when(m.isNotNull(), unescape(F.substring(s, m["start"] + 1, m["length"]))))
    return formatted.select("*", F.transform(segments, turn).alias("turns_read"), F.filter(marked, lambda x: x.isNotNull()).alias("loss_texts"))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id and digests of what read_back finds."""
    back = read_back(format_turns(conversations))
    said = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_fingerprint_chat_format(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    mine = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(turns_of_rows(rows.unionByName(mine)))


SQL = r"""
with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b as (select *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') as et,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') as er from a)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || er || ': ' || et || '</turn>' || chr(10))) as bigint) as formatted_chars
from b group by conv_id"""
