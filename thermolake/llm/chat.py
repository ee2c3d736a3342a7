"""Chat formatting with prefix-target expansion.

Each assistant turn becomes one example: all earlier turns as context, its own text alone trainable. Turns after
the last assistant turn become one more example without a trainable part, so that the output holds every turn.

A turn is written ``<|start|>role<|sep|>text<|end|>``. Inside roles and texts, every control string gets a
backslash after its first character, and one more where it already has some, so unescaping restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
TRAINED_ROLE = "assistant"

# fixed values: control strings of this and other public templates
#   <|name|>  <s>  </s>  <<SYS>>  <</SYS>>  [INST]  [/INST]
_REST = r"(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])"
ESCAPE = (r"([<\[])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def prefix_targets(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Examples (conv_id, n_turns int, formatted, loss_start long, loss_length long).

    ``loss_start`` counts code points from 0; it is null, with length 0, in an example without a trainable part.
    ``n_turns`` is the number of turns the example holds. Turns follow their number; repeated rows are all kept,
    equal numbers are ordered by role and text. Null roles and texts are empty, a null conversation id is one
    conversation. One conversation is one record, as its last example holds it whole.
    """
    empty = F.lit("")
    conversations = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text")))).alias("turns"))
    escaped = conversations.select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), escape(t["role"]).alias("escaped_role"), escape(t["text"]).alias("body"))).alias(
        "turns"))
    rendered = escaped.select(
        "conv_id", "turns",
        F.transform("turns", lambda t: F.concat(
            F.lit(START), t["escaped_role"], F.lit(SEP), t["body"], F.lit(END))).alias("rendered"))
    last = F.size("turns")
    wanted = F.filter(F.sequence(F.lit(1), last), lambda i: (
        (i == last) | (F.element_at("turns", i)["role"] == TRAINED_ROLE)))
    examples = rendered.select("conv_id", "turns", "rendered", F.explode(wanted).alias("n_turns")).select(
        "conv_id", "n_turns", F.element_at("turns", F.col("n_turns")).alias("target"),
        F.array_join(F.slice("rendered", F.lit(1), F.col("n_turns")), "").alias("formatted"))
    trained = F.col("target.role") == TRAINED_ROLE
    length = F.char_length("target.body").cast("long")
    return examples.select(
        "conv_id", "n_turns", "formatted",
        F.when(trained, F.char_length("formatted") - len(END) - length).alias("loss_start"),
        F.when(trained, length).otherwise(F.lit(0).cast("long")).alias("loss_length"))


def trained_text(formatted: Column, loss_start: Column, loss_length: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, loss_start.cast("int") + 1, loss_length.cast("int")))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from an example."""
    pieces = F.split(formatted, r"<\|start\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.struct(
        unescape(F.substring_index(p, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation with what its examples hold."""
    loss = F.when(F.col("loss_start").isNotNull(), F.struct(
        "n_turns", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text")))
    found = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.array_sort(F.collect_list(loss)).alias("replies"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"))
    loss_text = F.array_join(F.transform("replies", lambda r: r["text"]), "")
    parsed = found.select(
        "conv_id", parse_turns(F.col("longest")).alias("turns"), loss_text.alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
