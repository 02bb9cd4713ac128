"""Chat formatting as a relational plan (Spark expressions only).

A conversation becomes one string::

    <|turn|>ROLE\\nTEXT<|next|>TEXT<|end|>\\n<|turn|>...

Adjacent turns of one role share a block and are parted by ``<|next|>``, so that
the merge can be undone. Roles and texts are escaped (``&`` ``<`` ``[`` as
character references, line breaks in roles too): no control string, of this
template or of another bracketed one, can come from the data.

Defined cases: a null role or text counts as empty; null turn numbers sort
first; equal turn numbers are ordered by role, then text; rows that occur twice
stay two turns; rows of a null conversation id form one conversation; an empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import running_sum

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"


def _replace(x: Column, a: str, b: str) -> Column:
    return F.replace(x, F.lit(a), F.lit(b))


def escape(x: Column) -> Column:
    return _replace(_replace(_replace(x, "&", "&amp;"), "<", "&lt;"), "[", "&lsqb;")


def unescape(x: Column) -> Column:
    return _replace(_replace(_replace(x, "&lsqb;", "["), "&lt;", "<"), "&amp;", "&")


def escape_role(x: Column) -> Column:
    return _replace(escape(x), "\n", "&NewLine;")


def unescape_role(x: Column) -> Column:
    return unescape(_replace(x, "&NewLine;", "\n"))


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` (array of ``start, end`` in code points of ``formatted``, end
    exclusive) is the loss mask: the texts of ``loss_role``, without markers.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("t"),
    )
    collected = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns_of = F.col("turns")

    def piece(x: Column, i: Column) -> Column:
        opens = F.coalesce(F.get(turns_of, i - 1)["role"] != x["role"], F.lit(True))
        closes = F.coalesce(F.get(turns_of, i + 1)["role"] != x["role"], F.lit(True))
        return F.struct(
            F.when(opens, F.concat(F.lit(TURN), escape_role(x["role"]), F.lit("\n"))).otherwise(F.lit(NEXT)).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (x["role"] == F.lit(loss_role)).alias("loss"),
        )

    pieces = collected.select("conv_id", F.transform(turns_of, piece).alias("pieces"))
    lengths = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("bigint"))
    placed = pieces.select("conv_id", "pieces", running_sum(lengths).alias("ends"))
    spans = F.transform(
        "pieces",
        lambda p, i: F.struct(
            (F.get(F.col("ends"), i) - F.length(p["tail"]) - F.length(p["body"])).alias("start"),
            (F.get(F.col("ends"), i) - F.length(p["tail"])).alias("end"),
            p["loss"].alias("loss"),
        ),
    )
    return placed.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns (array of ``role, text``) that ``format_chat`` wrote."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        body = F.substr(block, F.lit(len(TURN) + 1))
        head = F.substring_index(body, "\n", 1)
        return F.transform(
            F.split(F.substr(body, F.length(head) + 2), r"<\|next\|>", -1),
            lambda t: F.struct(unescape_role(head).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the mask.

    UTF-32 gives each code point four bytes, so that a span is cut without
    scanning the string from its start for each span.
    """
    wide = F.encode(formatted, "UTF-32")
    cut = F.transform(
        spans,
        lambda s: unescape(
            F.decode(F.substring(wide, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")
        ),
    )
    return F.array_join(cut, "")


def chat_digest(chats: DataFrame) -> DataFrame:
    """What can be read back from ``format_chat``'s output, as counts and digests."""
    read = chats.select(
        "conv_id",
        parse_chat(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
