"""Chat formatting: typed content parts, flattened by a visitor into a ChatML-like template.

A message holds ordered parts of kind text, image, audio or document. The visitor renders text
parts as escaped text and every other part as a placeholder; it records each attachment's place,
reference and expanded token count. Only DataFrame functions are used.

Escaping is reversible: in a text every `<|` becomes `<||`, in a role also every newline becomes
`<|n|>`. Template marks have a letter after `<|`, so no text can imitate one; nor can two text parts that
follow each other and end with `<` and begin with `|`.

Defined results: a null text, role or part list counts as empty; turns with equal numbers follow
each other by role, then content; null turns come first; rows with a null conversation form one
conversation; repeated rows are repeated turns; other columns are ignored, whatever their names; an empty table
gives none. Texts are formatted whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholders by kind of part; an unknown kind gets that of "file".
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "file": "<|file|>"}
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """One text part, for tables whose messages are plain strings."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))).cast(PART))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _render(part: Column, before: Column) -> Column:
    """A part as text; before: the part in front of it, if any."""
    said = F.coalesce(part["text"], F.lit(""))
    split_mark = F.coalesce(_is_text(before) & F.endswith(before["text"], F.lit("<")), F.lit(False)) & F.startswith(said, F.lit("|"))
    out = F.when(_is_text(part), F.concat(F.when(before.isNotNull() & split_mark, F.lit("|")).otherwise(F.lit("")), escape(said)))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["kind"] == kind, F.lit(mark))
    return out.otherwise(F.lit(PLACEHOLDERS["file"]))


def _tokens(part: Column) -> Column:
    some = lambda name: F.coalesce(part[name], F.lit(0))
    return (
        F.when(part["kind"] == "image", F.ceil(some("width") / PATCH) * F.ceil(some("height") / PATCH))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", some("pages").cast("long") * TOKENS_PER_PAGE)
        .otherwise(F.lit(1))
        .cast("long")
    )


def format_chat(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments, loss_spans, attachments.

    segments (text, loss) concatenate to formatted; loss marks the bodies of loss_role's turns, and loss_spans
    (start, length) are their places in formatted, in code points from 0.
    attachments (position, turn, kind, ref, tokens) are in the order of their placeholders.
    """
    content = F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")) if parts else text_part(F.col(text))
    attached = F.transform(
        F.filter(F.col("parts"), lambda p: ~_is_text(p)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    # a message is rendered before rows are gathered
    rendered = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts")).withColumn("said", F.filter("parts", lambda p: ~_is_text(p) | (F.coalesce(p["text"], F.lit("")) != ""))).select(
        "conv_id", "turn", "role", F.array_join(F.transform("said", lambda p, i: _render(p, F.get("said", i - 1))), "").alias("body"), attached.alias("attached")
    )
    turns = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), (t["role"] == loss_role).alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    attachments = F.transform(
        F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))),
        lambda a, i: F.struct(i.alias("position"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
    )
    built = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), attachments.alias("attachments"))
    whole = built.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    # an assistant's place is the length of all that lies before it
    ends = F.aggregate("segments", F.array().cast("array<bigint>"), lambda a, s: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + F.char_length(s["text"])))
    spans = F.transform("segments", lambda s, i: F.when(s["loss"], F.struct((F.get("__ends", i) - F.char_length(s["text"])).alias("start"), F.char_length(s["text"]).cast("long").alias("length"))))
    return whole.withColumn("__ends", ends).withColumn("loss_spans", F.filter(spans, lambda x: x.isNotNull())).drop("__ends")


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay."""
    raw = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda t: F.startswith(t, F.lit(START)))
    body = lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t))
    head = lambda t: F.substring_index(t, "\n", 1)
    return F.transform(
        F.transform(raw, body),
        lambda t: F.struct(unescape_role(head(t)).alias("role"), unescape(F.substring(t, F.length(head(t)) + 2, F.length(t))).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read back from the formatted conversation and unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
