"""Chat formatting: every assistant turn becomes a training example of its own.

An example holds all turns up to its target; only the target's text is
trainable. DataFrame functions only.

The template writes a turn as ``### role``, a line feed, the text, ``</turn>``
and a line feed. In texts and roles a backslash, ``<`` and ``###`` (in roles a
line feed also) become a backslash and one letter, so that no text can end a
turn or open one, and every example reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: Control string -> escape; the backslash comes first when escaping, last when reading.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("###", "\\h")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "\\n")]
TARGET_ROLE = "assistant"


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, safe in pairs:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, safe in reversed(pairs):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per assistant turn.

    Returns conv_id, upto (turns held), is_target, formatted, loss_start and
    loss_end (code points, end exclusive). Turns that follow the last assistant
    turn come in one more row without a target, so no turn is lost.
    Null texts and roles count as empty; repeated turn numbers are put in order of
    role and text; rows without conv_id form one conversation. Other columns
    are not read. An empty table gives no rows. Texts of any length are taken whole; a conversation is one row.
    """
    one = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    shown = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t.role == TARGET_ROLE).alias("target"),
        F.transform("turns", lambda t: escape(t.text)).alias("body"),
        F.transform("turns", lambda t: escape(t.role, ROLE_ESCAPES)).alias("head"),
    )
    shown = shown.select(
        "conv_id",
        "target",
        F.transform("body", lambda b: F.length(b)).alias("sizes"),
        F.zip_with("head", "body", lambda h, b: F.concat(F.lit(OPEN), h, F.lit("\n"), b, F.lit(CLOSE))).alias("parts"),
        F.posexplode("target").alias("at", "is_target"),
    ).where(F.col("is_target") | (F.col("at") == F.size("target") - 1))
    end = F.length("formatted") - len(CLOSE)
    return shown.select(
        "conv_id",
        (F.col("at") + 1).alias("upto"),
        "is_target",
        F.array_join(F.slice("parts", F.lit(1), F.col("at") + 1), "").alias("formatted"),
        F.get("sizes", F.col("at")).alias("size"),
    ).select(
        "conv_id",
        "upto",
        "is_target",
        "formatted",
        F.when(F.col("is_target"), end - F.col("size")).otherwise(F.length("formatted")).alias("loss_start"),
        F.when(F.col("is_target"), end).otherwise(F.length("formatted")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example, as array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(part, F.length(head) + 2)).alias("text"),
        )

    return F.transform(bodies, turn)


def read_target(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, end - start))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, for each conversation, read back from them."""
    read = examples.select(
        "conv_id",
        "upto",
        "formatted",
        F.length("formatted").alias("size"),
        F.when(F.col("is_target"), read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).alias("target"),
    )
    # Only targets are gathered; of the contexts, the longest.
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "upto").alias("formatted"),
        F.collect_list(F.when(F.col("target").isNotNull(), F.struct("upto", "target"))).alias("targets"),
        F.sum("size").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform(F.array_sort("targets"), lambda t: t.target), "")
    return whole.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), "formatted_chars"
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
