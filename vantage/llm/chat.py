"""Chat formatting: records of many layouts, told apart by a fingerprint of their field
paths, become canonical turns, which a template writes out reversibly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

_TURN = "array<struct<role string, text string>>"

#: JSON of up to so many characters parses if it is JSON; longer may exceed the parser's
#: limits for a string or a variant.
PARSES = 16_000_000

#: Layout name -> (shape of a record, as schema_of_variant prints it; mapping to turns).
#: A mapping is either ("list", path, role field, text field, {role names}) or
#: ("fields", [(role, path), ...]); empty optional fields give no turn.
LAYOUTS = {
    "messages": ("OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>", ("list", "$.messages", "role", "content", {})),
    "dialogue": ("OBJECT<conversations: ARRAY<OBJECT<from: STRING, value: STRING>>>", ("list", "$.conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "prompt": ("OBJECT<prompt: STRING, response: STRING>", ("fields", [("user", "$.prompt"), ("assistant", "$.response")])),
    "instruction": ("OBJECT<instruction: STRING, output: STRING, system: STRING>", ("fields", [("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output")])),
    "nested": ("OBJECT<data: OBJECT<turns: ARRAY<OBJECT<speaker: OBJECT<name: STRING>, utterance: STRING>>>>", ("nested", "$.data.turns")),
}


def fingerprint(shape: Column) -> Column:
    """Hash of the nested field paths and kinds of a record."""
    return F.sha1(shape)


def turns_of(record: Column, mapping: tuple, typed: bool = False) -> Column:
    """Canonical turns of a parsed record, a variant or a typed struct, by a declarative mapping."""

    def get(path: str, kind: str) -> Column:
        return reduce(lambda c, name: c[name], path.split(".")[1:], record) if typed else F.variant_get(record, path, kind)

    if mapping[0] == "fields":
        return F.array(*[F.struct(F.lit(role).alias("role"), get(path, "string").alias("text")) for role, path in mapping[1]])
    if mapping[0] == "nested":
        got = get(mapping[1], "array<struct<speaker struct<name string>, utterance string>>")
        return F.transform(got, lambda t: F.struct(t["speaker"]["name"].alias("role"), t["utterance"].alias("text")))
    _, path, role, text, names = mapping
    got = get(path, f"array<struct<`{role}` string, `{text}` string>>")

    def named(r: Column) -> Column:
        out = r
        for k, v in names.items():
            out = F.when(r == k, v).otherwise(out)
        return out

    return F.transform(got, lambda t: F.struct(named(t[role]).alias("role"), t[text].alias("text")))


def canonical(records: DataFrame, json: str = "record", layouts: dict = LAYOUTS, typed: str | None = None) -> DataFrame:
    """Add layout and turns (array of role, text) to records holding JSON text.

    A record whose fingerprint no layout has, or that is not JSON, gets layout
    ``unknown`` and no turns; an empty message list has no field paths below it and is
    ``unknown`` too.  A text of over PARSES characters that does not parse is an error.
    With typed, a column of structs, the turns come from it and the JSON text is a
    skeleton for the fingerprint alone, so records may be of any length.
    """
    parsed = F.try_parse_json(F.col(json))
    out = records.withColumn("__v", parsed)
    lost = F.col("__v").isNull() & (F.length(json) > PARSES)
    error = F.raise_error(F.concat(F.lit("a record does not parse; its characters: "), F.length(json).cast("string"))).cast("string")
    out = out.withColumn("__fp", F.when(lost, error).otherwise(fingerprint(F.schema_of_variant(F.col("__v")))))
    layout, turns = F.lit("unknown"), F.array().cast(_TURN)
    for name, (shape, mapping) in layouts.items():
        hit = F.col("__fp") == fingerprint(F.lit(shape))
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, turns_of(F.col(typed or "__v"), mapping, typed is not None)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("__v", "__fp")


def escape(text: Column) -> Column:
    """No opening mark is left: one more backslash goes between ``<`` and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    back = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(back, F.lit("\\\\"), F.lit("\\"))


def render(turns: DataFrame) -> DataFrame:
    """Add formatted and loss_spans (start, from 0, and length in code points of each
    assistant text in formatted).  Null roles and texts count as empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    part = F.transform("turns", lambda t: F.struct(
        blank(t["role"]).alias("role"), F.concat(F.lit(OPEN), escape_role(blank(t["role"])), F.lit("\n")).alias("head"), escape(blank(t["text"])).alias("body")))
    out = turns.withColumn("__p", part)
    out = out.withColumn("formatted", F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    spans = F.aggregate(
        "__p",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<role string, start long, len long>>").alias("got")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(CLOSE))).cast("long").alias("at"),
            F.concat(a["got"], F.array(F.struct(p["role"].alias("role"), (a["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("len")))).alias("got"),
        ),
        lambda a: F.transform(F.filter(a["got"], lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"))),
    )
    return out.withColumn("loss_spans", spans).drop("__p")


def parse(formatted: Column) -> Column:
    """Turns read back from formatted text."""
    chunks = F.split(formatted, r"<\|im_end\|>\n", -1)
    chunks = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))
    inner = lambda c: F.substring(c, F.lit(len(OPEN) + 1), F.length(c))
    head = lambda c: F.substring_index(inner(c), "\n", 1)
    return F.transform(chunks, lambda c: F.struct(
        unescape_role(head(c)).alias("role"), unescape(F.substring(inner(c), F.length(head(c)) + F.lit(2), F.length(c))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Conversations stored as rows by turn -> one record each (a struct with the fields
    of all layouts, those of the others null) and skeleton, JSON of the record with at
    most three turns and empty texts.  The layout is one that its roles allow: two turns
    user, assistant as a prompt with its response; with a system turn before them as an
    instruction; otherwise a list of messages, a list of from/value pairs or nested
    turns, by a hash of the id."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.concat_ws(",", F.transform("t", lambda t: t["role"]))
    plain = F.forall("t", lambda t: t["role"].isin("system", "user", "assistant"))
    said = {"user": "human", "assistant": "gpt"}
    other = lambda r: F.coalesce(*[F.when(r == k, v) for k, v in said.items()], r)
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    kind = F.when(roles == "user,assistant", "prompt").when(roles == "system,user,assistant", "instruction").when(plain & (pick == 0), "dialogue").when(pick == 1, "nested").otherwise("messages")
    got = got.withColumn("kind", kind)

    def record(t: Column) -> Column:
        text = lambda i: F.try_element_at(t, F.lit(i))["text"]
        fields = {
            "prompt": {"prompt": text(1), "response": text(2)},
            "instruction": {"system": text(1), "instruction": text(2), "output": text(3)},
            "dialogue": {"conversations": F.transform(t, lambda x: F.struct(other(x["role"]).alias("from"), x["text"].alias("value")))},
            "nested": {"data": F.struct(F.transform(t, lambda x: F.struct(F.struct(x["role"].alias("name")).alias("speaker"), x["text"].alias("utterance"))).alias("turns"))},
            "messages": {"messages": F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))},
        }
        return F.struct(*[F.when(F.col("kind") == k, v).alias(name) for k, of in fields.items() for name, v in of.items()])

    short = F.transform(F.slice("t", 1, 3), lambda t: F.struct(F.lit("").alias("role"), F.lit("").alias("text")))
    return got.select("conv_id", record(F.col("t")).alias("record"), F.to_json(record(short), {"ignoreNullFields": "true"}).alias("skeleton"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, turns, formatted, loss_spans for conversations given as rows.

    Turns follow ``turn``, ties by role and text; a null conv_id is one conversation;
    null roles and texts are empty; repeated rows are repeated turns; an empty table
    gives no conversation.  All of it is built-in functions.
    """
    return render(canonical(records_of_rows(rows), "skeleton", typed="record").drop("record", "skeleton"))
