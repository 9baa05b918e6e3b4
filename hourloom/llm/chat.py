"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it are context, the turn itself is the target, and only the
reply's text lies under the loss mask. All examples of a conversation are prefixes of one formatted text, so that text is
built once and an example is cut from it.

Template, one turn: `<turn>` role newline text `</turn>` newline. Inside roles and texts `&` becomes `&amp;` and `<` becomes
`&lt;` (and a newline in a role `&#10;`), so no control string can come from a text, and reading back is exact.

Defined cases: a null text or role is empty; turns are read in the order of turn (null first), role, text, so repeated rows
count as turns of their own; rows without conv_id form one conversation. Turns after the last reply belong to no training
example; they come as one more example without a target, so that the output holds the whole conversation. Other columns are
ignored. The role `assistant` alone is trainable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import sha256_hex

OPEN, CLOSE = "<turn>", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole conversation), examples array<struct<end, loss_start, loss_end>> in code points.

    An example is the first `end` characters; its loss mask is [loss_start, loss_end), empty for the one without a target.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turn = F.struct("turn", "role", "text", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == ASSISTANT, F.lit(False)).alias("reply"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        after = end + F.lit(len(CLOSE))
        made = F.struct(after.alias("end"), start.alias("loss_start"), end.alias("loss_end"))
        return F.struct(
            after.alias("at"),
            F.when(t["reply"], F.concat(done["made"], F.array(made))).otherwise(done["made"]).alias("made"),
        )

    none = F.array().cast("array<struct<end:int,loss_start:int,loss_end:int>>")
    walked = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("made")), step)
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))))
    rest = F.array(F.struct(F.col("walked.at").alias("end"), F.col("walked.at").alias("loss_start"), F.col("walked.at").alias("loss_end")))
    covered = F.element_at("walked.made", -1)["end"] == F.col("walked.at")
    return (
        listed.select("conv_id", whole.alias("formatted"), walked.alias("walked"))
        .select("conv_id", "formatted", F.when(F.size("walked.made") == 0, rest).when(covered, F.col("walked.made"))
                .otherwise(F.concat("walked.made", rest)).alias("examples"))
    )


def expand_examples(formatted: DataFrame) -> DataFrame:
    """conv_id, example (from 0), last, text, loss_start, loss_end: a row per assistant turn, and one for turns after the last reply."""
    each = formatted.select("conv_id", "formatted", F.size("examples").alias("n"), F.posexplode("examples").alias("example", "e"))
    text = F.substring("formatted", F.lit(1), F.col("e.end"))
    last = F.col("example") == F.col("n") - 1
    return each.select("conv_id", "example", last.alias("last"), text.alias("text"), "e.loss_start", "e.loss_end")


def split_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from an example's text."""
    pieces = F.filter(F.split(text, "</turn>\n", -1), lambda p: p != "")

    def parse(piece: Column) -> Column:
        line = F.locate("\n", piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), line - F.lit(len(OPEN) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, parse)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns (of the last), the text under the loss masks in order, characters."""
    mask = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    # Only the last example holds every turn; the others give their mask and length alone.
    return (
        examples.select("conv_id", "example", F.length("text").cast("long").alias("chars"), mask.alias("mask"), F.when(F.col("last"), F.col("text")).alias("text"))
        .groupBy("conv_id")
        .agg(
            F.max("text").alias("longest"),
            F.sort_array(F.collect_list(F.struct("example", "mask"))).alias("masks"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select("conv_id", split_turns(F.col("longest")).alias("turns"),
                F.concat_ws("", F.transform("masks", lambda m: m["mask"])).alias("loss_text"), "formatted_chars")
    )


def digests(read: DataFrame) -> DataFrame:
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss_text")).alias("loss_sha256"),
        "formatted_chars",
    )
