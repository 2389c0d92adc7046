"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of typed parts: text, image, audio or document. A visitor flattens the parts in order:
text is escaped and written out, every other part becomes a placeholder with its number, its reference is
recorded in ``attachments`` and its expanded token count is added up. Messages are wrapped in a template,
and the spans that the loss covers (the assistant's text) are recorded in code points.

Template of a message:  <|turn|>ROLE<|text|>BODY<|end|>
Escaping inside ROLE and BODY is reversible: every backslash is doubled, and each control opener
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash after its first character. So no control
string can occur inside an escaped text, and ``\\\\(.)`` -> ``$1`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "type string, text string, ref string, tokens long"
#: Tokens that a placeholder expands to, where a part names none.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: Column) -> Column:
    """Escape control strings; ``unescape`` is its exact inverse. Null stays null."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])(?=\||/?s>|/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content list of one text part; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def _visit(part: Column, i: Column) -> Column:
    """What a part leaves in the body: escaped text, or a numbered placeholder."""
    placeholder = F.concat(F.lit("<|"), part["type"], F.lit(":"), i.cast("string"), F.lit("|>"))
    return F.when(part["type"].isin(*DEFAULT_TOKENS), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _attachment(part: Column, i: Column) -> Column:
    """What is recorded of a part that is not text."""
    tokens = part["tokens"]
    for kind, n in DEFAULT_TOKENS.items():
        tokens = F.coalesce(tokens, F.when(part["type"] == kind, F.lit(n).cast("long")))
    return F.struct(F.col("turn").alias("turn"), i.cast("int").alias("part"), part["type"].alias("type"), part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0).cast("long")).alias("tokens"))


def format_chats(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation, messages ordered by (turn, role, content).

    Columns: the conversation, n_turns, formatted (string), loss_spans (array of start and length, in code
    points of ``formatted``), attachments (array of turn, index, type, ref, tokens, in order) and expanded_tokens.

    ``content_col`` is array<struct<type, text, ref, tokens>>. Null content, role and part text are empty; a part
    with an unknown or null type is text where it has text. A null conversation id is one conversation of
    its own, null turns come first, equal turns are ordered by role, then content. No rows give no rows. A formatted
    conversation is one string, so one conversation must fit a task (2 GB is Spark's limit for a string).
    """
    empty = F.array().cast("array<struct<type:string,text:string,ref:string,tokens:bigint>>")
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(content_col), empty).alias("parts")
    )
    attached = F.filter(F.transform("parts", _attachment), lambda x: x["type"].isin(*DEFAULT_TOKENS))
    body = F.array_join(F.transform("parts", _visit), "")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    pieces = rows.select("conv", "turn", "role", "parts", head.alias("head"), body.alias("body"), attached.alias("att"))
    # Where a message begins is a running sum over its conversation; the grouping below uses the same exchange and order.
    order = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    chars = F.char_length("head") + F.char_length("body") + len(END)
    placed = pieces.withColumns({"at": F.sum(chars).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - chars, "no": F.row_number().over(order)})
    span = F.when(F.col("role") == loss_role, F.struct((F.col("at") + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("len")))
    message = F.struct("no", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"), "att")
    sized = placed.select("conv", message.alias("m")).groupBy("conv").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    spans = F.array_compact(F.transform("ms", lambda m: m["span"]))
    attachments = F.flatten(F.transform("ms", lambda m: m["att"]))
    out = sized.select(F.col("conv"), F.size("ms").cast("long").alias("n_turns"), F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])).withColumnRenamed("conv", conv_col)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped; placeholders stay as they are."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1_000_000_000)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(b, TEXT, 1)).alias("role"),
            unescape(F.regexp_replace(F.substring_index(b, TEXT, -1), r"<\|end\|>\z", "")).alias("text"),
        ),
    )


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")
