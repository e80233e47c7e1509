r"""Prefix-target expansion of conversations. Built-in functions only.

Every assistant turn becomes one example: all preceding turns are context and only that reply is trainable. Turns after the last
assistant turn form one example without a trainable part, so that each conversation can be read back whole.

A turn is written ``### role:\n``, its text, ``</turn>\n``. Inside texts ``\`` becomes ``\\``, ``<``
``\l`` and ``#`` ``\h`` (in roles also ``:`` ``\c``), so that no control string can occur there.

Defined results. Null texts and roles are empty. Rows are ordered by turn (null first), ties by role, then text; repeated rows are
turns of their own. Rows with a null conv_id form one conversation. An empty table gives an empty result. Other columns are ignored.
A conversation is one row, as its examples need it whole; there is no limit to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
LETTERS = {"<": "l", "#": "h"}
ROLE_LETTERS = LETTERS | {":": "c"}


def escape(text: Column, letters: dict[str, str] = LETTERS) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in letters.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def unescape(text: Column, letters: dict[str, str] = LETTERS) -> Column:
    def piece(x: Column) -> Column:
        for char, letter in letters.items():
            x = F.replace(x, F.lit("\\" + letter), F.lit(char))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def head(role: Column) -> Column:
    return F.concat(F.lit("### "), escape(role, ROLE_LETTERS), F.lit(":\n"))


def expand(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example (turns it holds), formatted, loss_start and loss_chars (code points of ``formatted``), whole
    (holds all turns of the conversation)."""
    empty = F.lit("")
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t["role"]), escape(t["text"]), F.lit(END))).alias("written"),
        F.transform("turns", lambda t: F.length(head(t["role"]))).alias("heads"),
        F.transform("turns", lambda t: t["role"] == target).alias("targets"),
    )
    n = F.size("written")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("targets", i) | (i == n))
    one = written.select("conv_id", "written", "heads", "targets", n.alias("n"), F.explode(ends).alias("example"))
    last, trained = F.element_at("written", F.col("example")), F.element_at("targets", F.col("example"))
    body = F.length(last) - F.element_at("heads", F.col("example")) - len(END)
    parts = one.select("conv_id", "example", F.array_join(F.slice("written", F.lit(1), F.col("example")), "").alias("formatted"), trained.alias("trained"), body.alias("body"), (F.col("example") == F.col("n")).alias("whole"))
    return parts.select("conv_id", "example", "formatted", (F.length("formatted") - len(END) - F.col("body")).cast("long").alias("loss_start"), F.when(F.col("trained"), F.col("body")).otherwise(0).cast("long").alias("loss_chars"), "whole")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescape(F.substring_index(F.substring(p, F.lit(5), F.length(p)), ":\n", 1), ROLE_LETTERS).alias("role"), unescape(F.substring(p, F.instr(p, ":\n") + 2, F.length(p))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say about each conversation, from their strings and masks alone."""
    loss = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    per = examples.select("conv_id", F.length("formatted").alias("chars"), F.when(F.col("whole"), F.col("formatted")).alias("all"), F.struct("example", loss.alias("text")).alias("loss"))
    conv = per.groupBy("conv_id").agg(F.max("all").alias("all"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    seen = conv.select("conv_id", "formatted_chars", read_turns(F.col("all")).alias("turns"), F.array_join(F.col("loss.text"), "").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
