"""Chat formatting: typed content parts flattened into one training string.

Every message is a role and an ordered list of parts. A visitor turns each
part into text: text parts are escaped, attachments become a placeholder and
leave a reference and an expanded token count behind. Everything is a
DataFrame expression; no Python runs on the executors.

The template writes a message as ``<s>[INST]role[/INST]body</s>``. Control
strings inside roles and texts get one backslash after their first character,
and control strings that already have backslashes there get one more, so the
escape is a bijection and no text can open or close a turn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TYPE = (
    "array<struct<type:string,text:string,ref:string,"
    "width:int,height:int,seconds:double,pages:int>>"
)

OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
_CONTROL = r"/?(?:s>|INST\]|IMG\]|AUD\]|DOC\])"


@dataclass(frozen=True)
class TokenCosts:
    """Tokens an attachment expands to: image patches, audio frames, document pages."""

    patch_pixels: int = 28
    frames_per_second: float = 25.0
    tokens_per_page: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def text_part(text: Column) -> Column:
    """A content list that holds one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast(
        "array<struct<type:string,text:string>>"
    )


def _body(parts: Column, typed: bool) -> Column:
    """All parts as text. Neighbouring text parts are joined before they are escaped, so
    no control string can be put together from several of them.
    """
    def said(part: Column) -> Column:
        return F.coalesce(part["text"], F.lit(""))

    if not typed:
        return escape(F.array_join(F.transform(parts, said), ""))

    def visit(seen: Column, part: Column) -> Column:
        mark = F.when(F.lit(False), "")
        for kind, shown in PLACEHOLDERS.items():
            mark = mark.when(part["type"] == kind, shown)
        return F.struct(
            F.when(mark.isNull(), seen["done"])
            .otherwise(F.concat(seen["done"], escape(seen["open"]), mark))
            .alias("done"),
            F.when(mark.isNull(), F.concat(seen["open"], said(part))).otherwise("").alias("open"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    return F.aggregate(parts, start, visit, lambda seen: F.concat(seen["done"], escape(seen["open"])))


def _tokens(part: Column, costs: TokenCosts) -> Column:
    def known(name: str) -> Column:
        return F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))

    def patches(name: str) -> Column:
        return F.ceil(known(name) / costs.patch_pixels)

    return (
        F.when(part["type"] == "image", patches("width") * patches("height"))
        .when(part["type"] == "audio", F.ceil(known("seconds") * costs.frames_per_second))
        .when(part["type"] == "document", known("pages") * costs.tokens_per_page)
        .cast("bigint")
    )


def _attachments(parts: Column, costs: TokenCosts) -> Column:
    held = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDERS))
    return F.transform(
        held,
        lambda p: F.struct(
            p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p, costs).alias("tokens")
        ),
    )


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_chats(
    messages: DataFrame, costs: TokenCosts = TokenCosts(), trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: the training string, its loss mask, its attachments.

    ``messages`` has ``conv_id``, ``turn``, ``role`` and ``parts`` (of
    ``PART_TYPE``, or with ``type`` and ``text`` alone); other columns are
    ignored. Messages are ordered by turn (nulls first), then role, then body,
    so ties have one order and repeated rows all stay. Null roles, texts and
    part lists are empty; a part of an unknown or null type counts as text;
    negative or null sizes expand to no tokens. Rows with a null ``conv_id``
    form one conversation. An empty table gives no rows.

    Returns ``conv_id``, ``segments`` (text and whether the loss counts it; in
    order they are the whole string), ``formatted``, ``attachments`` (kind,
    reference, expanded tokens, in placeholder order) and
    ``attachment_tokens``.
    """
    element = messages.schema["parts"].dataType.elementType
    typed = "ref" in element.fieldNames()
    parts = F.coalesce(F.col("parts"), F.array().cast(messages.schema["parts"].dataType))
    role = F.coalesce("role", F.lit(""))
    message = [
        F.col("turn"),
        role.alias("role"),
        _body(parts, typed).alias("body"),
    ]
    if typed:
        message.append(_attachments(parts, costs).alias("attachments"))
    turns = messages.select("conv_id", F.struct(*message).alias("message"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    segments = F.flatten(
        F.transform(
            "messages",
            lambda m: F.array(
                _segment(F.concat(F.lit(OPEN + HEAD), escape(m["role"]), F.lit(BODY)), F.lit(False)),
                _segment(m["body"], m["role"] == trained),
                _segment(F.lit(CLOSE), F.lit(False)),
            ),
        )
    )
    attachments = (
        F.flatten(F.transform("messages", lambda m: m["attachments"]))
        if typed
        else F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")
    )
    return (
        chats.select("conv_id", segments.alias("segments"), attachments.alias("attachments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn(
            "attachment_tokens",
            F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: an array of role and text, unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        halves = F.split(piece, r"\[/INST\]", 2)
        return F.struct(
            unescape(F.substring(F.get(halves, F.lit(0)), len(OPEN + HEAD) + 1, 2**31 - 1)).alias("role"),
            unescape(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("text"),
        )

    return F.transform(turns, read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
