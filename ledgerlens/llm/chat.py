"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of a
role are merged into one block, and the blocks concatenated:

    <turn:ROLE>TEXT<and>TEXT</turn><turn:ROLE>TEXT</turn>

Inside texts and roles a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>``
becomes ``\\g``. What a text says can therefore never look like a mark, and each
backslash of the output is followed by one of three letters, so three replacements
undo it. The loss mask covers the output as runs (chars, loss) in code points:
true for assistant texts, false for marks and other texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, AND = "<turn:", "</turn>", "<and>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_runs), one row for each conversation.

    Null roles and texts count as empty. Rows are ordered by turn (null first), ties by role and then
    text; repeated rows stay. A null ``conv_id`` is a conversation of its own. All steps
    are linear in a conversation's length, whose row has to fit into a task in any case.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    talks = turns.select(F.col(conv).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    talks = talks.select("conv_id", "turns", F.transform("turns", lambda t: t["role"]).alias("roles"))
    fresh = lambda i: (i == 1) | (F.element_at("roles", i) != F.element_at("roles", F.greatest(i - 1, F.lit(1))))
    talks = talks.select("conv_id", "turns", "roles", F.filter(F.sequence(F.lit(1), F.size("roles")), fresh).alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("roles") + 1))
    merged = F.zip_with(
        "starts",
        ends,
        lambda s, e: F.struct(
            F.element_at("roles", s).alias("role"),
            F.transform(F.slice("turns", s, e - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    blocks = talks.select("conv_id", merged.alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(">"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], AND), F.lit(CLOSE))), "")
    run = lambda n, loss: F.struct(n.alias("chars"), loss.alias("loss"))
    between = F.lit(False)
    runs = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            run(F.when(i == 0, F.length(head(b))).otherwise(F.lit(len(AND))), between),
                            run(F.length(t), b["role"] == learn),
                        ),
                    )
                ),
                F.array(run(F.lit(len(CLOSE)), between)),
            ),
        )
    )
    return blocks.select("conv_id", formatted.alias("formatted"), F.filter(runs, lambda r: r["chars"] > 0).alias("loss_runs"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Reads (conv_id, turns array<struct<role, text>>, loss_texts array<string>) back from the output alone."""
    halves = F.transform(
        F.filter(F.split("formatted", CLOSE), lambda b: b != ""),
        lambda b: F.struct(
            unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), ">", 1)).alias("role"),
            F.split(F.substr(b, F.locate(">", b) + 1), AND).alias("texts"),
        ),
    )
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    pieces = F.regexp_extract_all("formatted", F.lit("(<[^>]*>|[^<]+)"), F.lit(1))
    masked = F.zip_with("pieces", "loss_runs", lambda p, r: F.when(r["loss"] & (F.length(p) == r["chars"]), unescape(p)))
    return (
        chats.select("conv_id", "formatted", "loss_runs", halves.alias("blocks"), pieces.alias("pieces"))
        .select("conv_id", "formatted", turns.alias("turns"), F.filter(masked, lambda t: t.isNotNull()).alias("loss_texts"))
    )


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations say, as counts and hashes."""
    said = parse_chats(chats).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("loss_texts", "").alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return said.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
