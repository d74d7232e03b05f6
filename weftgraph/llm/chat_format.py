"""Operator 5: chat formatting with typed content parts. DataFrame functions only.

A turn's content is an array of parts (type, text, ref, width, height, seconds, pages). A visitor flattens them in
order: text parts are escaped text; image, audio and document parts become numbered placeholders, and each
reference is recorded with the tokens that its placeholder stands for. A turn reads
    <|turn|>role\\nbody<|end|>
and a conversation is its turns one after another. Control strings inside texts and roles are escaped so that
they can be read back exactly. The loss mask is held as runs: for each turn the code points before the body, of
the body and after it, and whether the body is learnt (assistant turns).

Null text counts as empty, a null role as empty, null parts as one text part; a null conv_id is a conversation of
its own. Turns are ordered by turn (null first), then role, then text; repeated rows are kept. An empty table
gives an empty result. Other columns are not read. A conversation is one value, as its digest is: its turns are
gathered by an aggregation that is combined in each map task; it must fit in a row (2 GB), as any formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
# Control strings of common chat templates, each with its escape. ~ itself comes first.
ESCAPES = [("~", "~0"), ("<|", "~1"), ("|>", "~2"), ("</s>", "~3"), ("<s>", "~4"), ("[INST]", "~5"), ("[/INST]", "~6"), ("<<SYS>>", "~8"), ("<</SYS>>", "~9")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "~7")]
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(c: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, mark in table:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescape(c: Column, table: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, mark in reversed(table):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def visited(parts: Column, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 1024) -> tuple[Column, Column]:
    """The body that parts flatten to, and the attachments: array of (ordinal, type, ref, tokens)."""
    other = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")

    def tokens(p: Column) -> Column:
        area = F.ceil(F.coalesce(p["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(p["height"], F.lit(0)) / patch)
        return F.when(p["type"] == "image", area).when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate)).when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * page_tokens).otherwise(F.lit(0)).cast("long")

    attachments = F.transform(other, lambda p, i: F.struct((i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))

    def flat(p: Column, i: Column) -> Column:
        ordinal = F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: F.coalesce(q["type"], F.lit("text")) != "text"))
        mark = F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), ordinal.cast("string"), F.lit("|>"))
        return F.when(F.coalesce(p["type"], F.lit("text")) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)

    return F.array_join(F.transform(parts, flat), ""), attachments


def format_chats(df: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, mask, attachments and expanded_tokens of every conversation.

    df: conv_id, turn, role, text and, if there is one, parts as PARTS says (null: the text)."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    parts = F.coalesce(F.col("parts"), text_part(plain)) if "parts" in df.columns else text_part(plain)
    body, attachments = visited(parts)
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = df.select("conv_id", F.struct(F.col("turn"), role.alias("role"), body.alias("body"), attachments.alias("attachments")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("before"), F.length(t["body"]).alias("body"), F.lit(len(END)).alias("after"), t["role"].isin(*learnt).alias("learnt"))).alias("mask"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn_index"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: a["tokens"]))), F.lit(0).cast("long"), lambda x, y: x + y).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Formatted conversations with turns (role, text) and learnt texts read from `formatted` and `mask`."""
    cut = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.greatest(F.col("n_turns").cast("int"), F.lit(0)))
    inner = lambda s: F.substring(s, F.lit(1), F.length(s) - len(END))
    role = lambda s: F.substring_index(s, "\n", 1)
    turns = F.transform("cut", lambda s: F.struct(unescape(role(s), ROLE_ESCAPES).alias("role"), unescape(F.substring(inner(s), F.length(role(s)) + 2, F.length(s))).alias("text")))
    masked = F.zip_with("cut", "mask", lambda s, m: F.when(m["learnt"], unescape(F.substring(s, m["before"] - len(TURN) + 1, m["body"]))))
    return chats.withColumn("cut", cut).withColumn("turns", turns).withColumn("learnt_texts", F.filter(masked, lambda x: x.isNotNull())).drop("cut")
