"""Chat formatting: records of many layouts to canonical turns, and turns to one training string.

A record's schema fingerprint is a hash of its nested field paths (names and nesting, not types).
It selects a declarative mapping, which says where the turns' roles and texts stand.  The template
wraps every turn in ``<s>`` and ``</s>``, and in ``[INST] `` and `` [/INST]`` too unless it is the
assistant's.  Control strings inside roles and texts get a backslash after their first character (one
more if they have some), which reading takes off again, so every string comes back as it was.

Null roles and texts count as empty.  A record whose fingerprint no mapping has keeps its row, with a
null layout and no turns; so does a null record.  Turns with equal places are ordered by role and
text; repeated rows are turns of their own.  A null conversation id is a conversation.  An empty table
gives an empty result.  Columns that functions add (``layout`` and ``turns``; ``formatted`` and
``loss_spans``) replace input columns of these names; names that begin with ``_chat_`` are the
operator's own.  Only built-in functions are used.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts: a list of turns (its place, and the fields of a turn), or fields in turn order.
#: ``optional`` fields may be absent; ``roles`` renames.
MAPPINGS = (
    {"name": "messages", "list": "messages", "role": "role", "text": "content", "optional": ("name",)},
    {"name": "turns", "list": "turns", "role": "role", "text": "text", "optional": ("turn",)},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant", "bot": "assistant"}},
    {"name": "prompt_completion", "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), "optional": ("system",)},
    {"name": "prompt_response", "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), "optional": ("system",)},
    {"name": "instruction", "fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), "optional": ("system", "input")},
    {"name": "question_answer", "fields": (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), "optional": ("context",)},
)
_TURNS = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """The canonical form of a variant's schema: field names and nesting, without the types."""
    schema = F.schema_of_variant(record)
    untyped = F.regexp_replace(schema, r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\s*\d+\))?(?=[,>])", "")
    return F.regexp_replace(untyped, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\s*\d+\))?>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _shapes(mapping: dict) -> list[str]:
    """The canonical forms that a mapping accepts, with and without its optional fields."""
    optional = mapping.get("optional", ())
    out = []
    for present in product((False, True), repeat=len(optional)):
        without = {o for o, p in zip(optional, present, strict=True) if not p}
        if "list" in mapping:
            names = sorted({mapping["role"], mapping["text"], *optional} - without)
            out.append(f"OBJECT<{mapping['list']}: ARRAY<OBJECT<{', '.join(names)}>>>")
        else:
            names = sorted({n for _, parts in mapping["fields"] for n in parts} - without)
            out.append(f"OBJECT<{', '.join(names)}>")
    if "list" in mapping:
        out.append(f"OBJECT<{mapping['list']}: ARRAY<>>")
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, mapping: dict) -> Column:
    if "list" in mapping:
        role, text, roles = mapping["role"], mapping["text"], mapping.get("roles", {})
        items = F.try_variant_get(record, f"$.{mapping['list']}", f"array<struct<`{role}`:string,`{text}`:string>>")

        def turn(x: Column) -> Column:
            named = x[role]
            for old, new in roles.items():
                named = F.when(x[role] == old, F.lit(new)).otherwise(named)
            return _turn(named, x[text])

        return F.transform(F.coalesce(items, F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")), turn)
    turns = []
    for role, parts in mapping["fields"]:
        texts = [F.try_variant_get(record, f"$.{p}", "string") for p in parts]
        joined = F.array_join(F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != "")), "\n\n")
        present = F.coalesce(*texts).isNotNull() | F.lit(role != "system")
        turns.append(F.when(present, _turn(F.lit(role), joined)))
    return F.array_compact(F.array(*turns))


def canonical_turns(df: DataFrame, record: str, mappings: tuple = MAPPINGS) -> DataFrame:
    """``df`` with ``layout``, the name of the mapping that ``record`` (a variant) selects, and
    ``turns``, its role and text pairs."""
    marked = df.withColumn("_chat_fp", fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(_TURNS)
    for mapping in reversed(mappings):
        hit = F.col("_chat_fp").isin(*[F.xxhash64(F.lit(s)) for s in _shapes(mapping)])
        layout = F.when(hit, F.lit(mapping["name"])).otherwise(layout)
        turns = F.when(hit, _mapped(F.col(record), mapping)).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns}).drop("_chat_fp")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1"), r"\[(\\*/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1"), r"\[\\(\\*/?INST\])", "[$1")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: start and length, in characters of ``formatted``,
    of each assistant text."""

    def piece(t: Column) -> Column:
        role, text = _role_out(t["role"]), escape(t["text"])
        assistant = t["role"] == "assistant"
        begin = F.when(assistant, F.concat(F.lit("<s>"), role, F.lit("\n"))).otherwise(F.concat(F.lit("<s>[INST] "), role, F.lit("\n")))
        return F.struct(begin.alias("begin"), text.alias("text"), F.when(assistant, F.lit("</s>")).otherwise(F.lit(" [/INST]</s>")).alias("end"), assistant.alias("learn"))

    def add(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.char_length(p["begin"])
        length = F.char_length(p["text"])
        spans = F.when(p["learn"], F.array_append(acc["spans"], F.struct(at.alias("start"), length.alias("length")))).otherwise(acc["spans"])
        return F.struct((at + length + F.char_length(p["end"])).alias("at"), spans.alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    pieced = df.withColumn("_chat_pieces", F.transform("turns", piece))
    formatted = F.array_join(F.transform("_chat_pieces", lambda p: F.concat(p["begin"], p["text"], p["end"])), "")
    return pieced.withColumns({"formatted": formatted, "loss_spans": F.aggregate("_chat_pieces", nothing, add, lambda acc: acc["spans"])}).drop("_chat_pieces")


def read_turns(formatted: Column) -> Column:
    """The turns that ``formatted`` holds: role, text, and whether the text is under the loss mask."""

    def turn(part: Column) -> Column:
        body = F.substring(part, 4, 2**31 - 1)
        asked = F.startswith(body, F.lit("[INST] "))
        body = F.when(asked, F.substr(body, F.lit(8), F.char_length(body) - 15)).otherwise(body)
        at = F.instr(body, "\n")
        return F.struct(_role_back(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + 1)).alias("text"), (~asked).alias("learn"))

    return F.transform(F.filter(F.split(formatted, "</s>", -1), lambda p: p != ""), turn)


def conversations_as_records(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record (a variant) for each conversation of a table of turns, in any of the seven layouts.

    Conversations are dealt by a hash of their id among the layouts that hold their roles without
    loss, so that the fingerprint has to tell them apart: any roles as ``turns`` or ``messages``, those
    of user, assistant and system as ``conversations`` too (under its own names), and an exchange of a
    user's and an assistant's turn, with or without a system's before, as one of the flat layouts too.
    """
    turn = F.struct(F.col(turn_col).alias("at"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list(turn)).alias("_chat_turns"))
    turns, roles = F.col("_chat_turns"), F.transform("_chat_turns", lambda t: t["role"])

    def each(role: str, text: str, named: dict[str, str]) -> Column:
        def one(t: Column) -> Column:
            name = t["role"]
            for new, old in named.items():
                name = F.when(t["role"] == new, F.lit(old)).otherwise(name)
            return F.struct(name.alias(role), t["text"].alias(text))

        return F.transform(turns, one)

    def flat(*fields: str) -> Column:
        return F.struct(*[F.get(turns, F.lit(k))["text"].alias(f) for k, f in enumerate(fields)])

    known = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    pair, triple = (roles == F.array(*map(F.lit, x)) for x in (("user", "assistant"), ("system", "user", "assistant")))
    some = F.size(turns) > 0
    choices = [
        (some, F.struct(each("role", "text", {}).alias("turns"))),
        (some, F.struct(each("role", "content", {}).alias("messages"))),
        (some & known, F.struct(each("from", "value", {"user": "human", "assistant": "gpt"}).alias("conversations"))),
        (pair, flat("prompt", "completion")),
        (pair, flat("prompt", "response")),
        (pair, flat("instruction", "output")),
        (pair, flat("question", "answer")),
        (triple, flat("system", "prompt", "completion")),
        (triple, flat("system", "prompt", "response")),
        (triple, flat("system", "instruction", "output")),
        (triple, flat("context", "question", "answer")),
    ]
    open_to = F.array_compact(F.array(*[F.when(when, F.lit(k)) for k, (when, _) in enumerate(choices)]))
    dealt = grouped.withColumn("_chat_open", open_to).withColumn("_chat_kind", F.get("_chat_open", F.pmod(F.xxhash64(conv_col), F.size("_chat_open")).cast("int")))
    record = F.to_variant_object(choices[0][1])
    for k, (_, fields) in enumerate(choices[1:], 1):
        record = F.when(F.col("_chat_kind") == k, F.to_variant_object(fields)).otherwise(record)
    return dealt.select(conv_col, record.alias("record"))
