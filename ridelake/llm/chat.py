"""Chat formatting: prefix-target expansion, with built-in functions only.

One conversation becomes a formatted text, and each assistant turn an example of its own: the text up to
and including that reply, with only the reply under the loss mask. A turn is written as

    <|turn>role NEWLINE text<turn|> NEWLINE

and role and text are escaped so that no control string of this or a bracket-style template can occur
inside them: a backslash becomes ``\\s``, ``<`` becomes ``\\l``, ``[`` becomes ``\\b`` and, in roles, a
newline becomes ``\\n``. Undoing the four in any order that ends with ``\\s`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings and the escapes, backslash first.
OPEN, CLOSE, SEPARATOR = "<|turn>", "<turn|>\n", "\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("\n", "\\n"))


def _replace_all(column: Column, pairs) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escape_role(column: Column) -> Column:
    return _replace_all(column, ESCAPES)


def escape_text(column: Column) -> Column:
    return _replace_all(column, ESCAPES[:3])


def unescape(column: Column) -> Column:
    return _replace_all(column, [(new, old) for old, new in reversed(ESCAPES)])


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: (conv_id, formatted, turns), ``turns`` holding each turn's role and spans.

    Turns are ordered by (turn, role, text), null turns first; rows repeated in full stay as turns of their
    own. A null role or text counts as empty, a null conversation id is a conversation. Other columns
    are not read. Spans are in code points, counted from 0. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    pieces = ordered.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(
            t["role"].alias("role"),
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(SEPARATOR)).alias("head"),
            escape_text(t["text"]).alias("body"),
        )).alias("ps"),
    )
    return pieces.select(
        "conv_id",
        F.array_join(
            F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""
        ).alias("formatted"),
        F.transform("ps", lambda p: F.struct(
            p["role"].alias("role"),
            F.char_length(p["head"]).alias("head_chars"),
            F.char_length(p["body"]).alias("body_chars"),
        )).alias("turns"),
    )


def prefix_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per target turn of ``format_conversations``: its prefix, and the span under the loss mask.

    Columns: conv_id, example (from 0), text, loss_start, loss_chars, n_turns (in the prefix), is_last.
    Turns behind the last reply (or a conversation without one) come as a last row without a loss, so that the
    output holds every turn; it is told by ``loss_start`` null.
    """
    size = F.size("turns")
    # Running sums per turn, kept as rows: an array built turn by turn would be copied for each turn.
    spread = conversations.select("conv_id", "formatted", size.alias("size"), F.posexplode("turns").alias("k", "t"))
    wide = F.col("t.head_chars") + F.col("t.body_chars") + F.lit(len(CLOSE))
    order = "PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ends = spread.withColumn("wide", wide.cast("long")).selectExpr(
        "conv_id", "formatted", "size", "k", "t", f"sum(wide) OVER ({order}) AS end_at",
        f"sum(CASE WHEN t.role = '{target_role}' THEN 1 ELSE 0 END) OVER ({order}) AS targets",
    )
    is_target = F.col("t.role") == target_role
    is_last = F.col("k") == F.col("size") - 1
    loss_start = F.col("end_at") - len(CLOSE) - F.col("t.body_chars")
    return ends.where(is_target | is_last).select(
        "conv_id",
        (F.col("targets") - F.when(is_target, 1).otherwise(0)).alias("example"),
        F.substring("formatted", F.lit(1), F.col("end_at").cast("int")).alias("text"),
        F.when(is_target, loss_start).alias("loss_start"),
        F.when(is_target, F.col("t.body_chars").cast("long")).alias("loss_chars"),
        (F.col("k") + 1).cast("long").alias("n_turns"),
        is_last.alias("is_last"),
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    parts = F.split(text, F.lit(CLOSE.replace("|", "\\|")))
    bodies = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1)
    )
    return F.transform(bodies, lambda p: F.struct(
        unescape(F.substring_index(p, SEPARATOR, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, SEPARATOR) + 1, F.lit(2**31 - 1))).alias("text"),
    ))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, text under the loss mask, and lengths.

    The turns are parsed from the last example, which holds all of them; the text under the mask is cut
    from each example by its span.
    """
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    whole = F.array_join(
        F.transform(parse_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = examples.select(
        "conv_id",
        F.struct("example", F.coalesce(loss, F.lit("")).alias("loss")).alias("part"),
        F.when(F.col("is_last"), F.sha2(whole, 256)).alias("turns_sha256"),
        F.when(F.col("is_last"), F.size(parse_turns(F.col("text"))).cast("long")).alias("n_turns"),
        F.char_length("text").cast("long").alias("chars"),
    )
    parts = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return parts.select(
        "conv_id", "n_turns", "turns_sha256",
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
