"""Chat formatting, with DataFrame functions only: the fingerprint of a record's nested field paths selects a declarative mapping to canonical turns; a template writes them, and what it writes can be read back."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

#: Strings that some chat template gives a meaning; texts never hold them unescaped.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, SEP, END = CONTROL[:3]

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: a list field with role and text fields, or single fields that each are a turn's text. layout: the record's fields as paths with [] for lists."""

    name: str
    layout: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    single: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("turns", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt_completion", ("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction_output", ("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", ("input", "instruction", "output"), single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_question_answer", ("answer", "question", "system"), single=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def _shape(paths: tuple[str, ...]) -> str:
    """Paths as the text that Spark's schema_of_variant gives for such a record."""
    lists: dict[str, list[str]] = {}
    for path in paths:
        top, _, below = path.partition("[].")
        lists.setdefault(top, []).extend([below] if below else [])
    inner = [f"{k}: " + (f"ARRAY<OBJECT<{', '.join(f'{x}: STRING' for x in sorted(v))}>>" if v else "STRING") for k, v in sorted(lists.items())]
    return f"OBJECT<{', '.join(inner)}>"


def paths_of(schema: T.DataType, top: str = "") -> tuple[str, ...]:
    """Sorted paths of the leaves of a struct."""
    if isinstance(schema, T.StructType):
        return tuple(sorted(x for f in schema.fields for x in paths_of(f.dataType, f"{top}.{f.name}" if top else f.name)))
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{top}[]")
    return (top,)


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(F.regexp_replace(shape, r"\bVOID\b", "STRING"))


def _single(mapping: Mapping, get) -> Column:
    turns = F.array(*(F.struct(F.lit(role).alias("role"), get(name).cast("string").alias("text")) for role, name in mapping.single))
    return F.filter(turns, lambda t: t["text"].isNotNull())


def _listed(mapping: Mapping, items: Column) -> Column:
    def role(x: Column) -> Column:
        got = x[mapping.role].cast("string")
        return reduce(lambda c, kv: F.when(got == kv[0], F.lit(kv[1])).otherwise(c), mapping.roles.items(), got)

    return F.transform(items, lambda x: F.struct(F.coalesce(role(x), F.lit("")).alias("role"), F.coalesce(x[mapping.text].cast("string"), F.lit("")).alias("text")))


def canonical_json(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[Column, Column]:
    """(turns, layout name) of records as JSON text, each by its own fingerprint. Records of no known layout, null or broken ones have null for both. A field that is null counts as text; null single fields are no turn, null texts in lists are empty."""
    variant = F.try_parse_json(record)
    mark = fingerprint(F.schema_of_variant(variant))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m in mappings:
        if m.single:
            got = _single(m, lambda field: F.variant_get(variant, f"$.{field}", "string"))  # noqa: B023
        else:
            got = _listed(m, F.variant_get(variant, f"$.{m.turns}", f"array<struct<{m.role}:string,{m.text}:string>>"))
        hit = mark == F.xxhash64(F.lit(_shape(m.layout)))
        turns, name = F.when(hit, got.cast(TURNS)).otherwise(turns), F.when(hit, F.lit(m.name)).otherwise(name)
    return turns, name


def spread(turns: Column, key: Column) -> Column:
    """Turns as JSON records in layouts that a hash of key chooses among those that hold them without loss: lists of three kinds, or a prompt and a completion."""
    by, listed = F.pmod(F.xxhash64(key), F.lit(4)), {m.name: m for m in MAPPINGS if m.turns}

    def written(name: str) -> Column:
        m = listed[name]
        roles = {v: k for k, v in m.roles.items()}

        def role(x: Column) -> Column:
            return reduce(lambda c, kv: F.when(x["role"] == kv[0], F.lit(kv[1])).otherwise(c), roles.items(), x["role"])

        return F.to_json(F.struct(F.transform(turns, lambda t: F.struct(role(t).alias(m.role), t["text"].alias(m.text))).alias(m.turns)))

    pair = F.transform(turns, lambda t: t["role"]) == F.array(F.lit("user"), F.lit("assistant"))
    taken = F.exists(turns, lambda t: t["role"].isin(*listed["from_value"].roles))
    single = F.to_json(F.struct(F.get(turns, F.lit(0))["text"].alias("prompt"), F.get(turns, F.lit(1))["text"].alias("completion")))
    return F.when((by == 0) & pair, single).when((by == 1) & ~taken, written("from_value")).when(by == 2, written("turns")).otherwise(written("messages"))


def canonical_struct(df: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Turns of a typed struct column; its schema's fingerprint selects the mapping. An unknown layout raises ValueError."""
    paths = paths_of(df.schema[column].dataType)
    found = [m for m in mappings if tuple(sorted(m.layout)) == paths]
    if not found:
        raise ValueError(f"no mapping for the fields {', '.join(paths)}")
    m = found[0]
    return (_single(m, lambda field: F.col(column)[field]) if m.single else _listed(m, F.col(column)[m.turns])).cast(TURNS)


def escape(text: Column) -> Column:
    """Backslashes are doubled, then one goes in after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, trained: str = "assistant") -> Column:
    """Where in the formatted text the trained role's texts stand: array of (start from 0, length), in code points."""
    parts = F.transform(turns, lambda t: F.struct((F.length(escape(t["role"])) + len(START) + len(SEP)).cast("long").alias("before"), F.length(escape(t["text"])).cast("long").alias("length"), (t["role"] == trained).alias("trained")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["before"]
        more = F.array(F.struct(start.alias("start"), p["length"].alias("length")))
        return F.struct((start + p["length"] + len(END)).alias("at"), F.when(p["trained"], F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def format_chats(df: DataFrame, turns: Column) -> DataFrame:
    """df with turns, formatted and loss_spans. Null turns give null; no turns give an empty text."""
    return df.withColumn("turns", turns).withColumns({"formatted": formatted(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


def read_turns(text: Column) -> Column:
    """The turns in a formatted text."""
    whole = F.split(text, F.lit(r"\Q" + END + r"\E"), -1)
    parts = F.transform(F.slice(whole, F.lit(1), F.size(whole) - 1), lambda x: F.split(x, F.lit(r"\Q" + SEP + r"\E"), -1))
    return F.transform(parts, lambda p: F.struct(unescape(F.substr(p[0], F.lit(len(START) + 1))).alias("role"), unescape(p[1]).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def grouped(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as one record for each conversation: conv_id and record, a struct in the messages layout.

    Turns go by number, nulls first; ties go by role, then text. Null roles and texts are empty. Rows of a null conversation are one conversation. Repeated rows are repeated turns. Other columns are not read; an empty table gives no rows. A conversation is one row, as its hash and text must be.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    groups = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return groups.select("conv_id", F.struct(F.transform("all", lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role"))).alias("messages")).alias("record"))
