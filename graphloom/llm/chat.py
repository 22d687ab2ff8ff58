"""Chat formatting with a finite-state machine over roles; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The declarative template: marks around a turn, roles whose text is trained on, and the states that may follow each state.
TEMPLATE = {
    "open": "<|im_start|>",
    "close": "<|im_end|>\n",
    "loss_roles": ["assistant"],
    "start": "start",
    "follow": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user", "tool"], "tool": ["assistant"]},
    "final": ["assistant"],
}


def escape(text: Column) -> Column:
    """Puts a backslash into every `<|`, after those already there: no text can hold a mark, and `unescape` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per conversation: conv_id, valid, segments and formatted.

    segments: array of (text, loss), whose texts joined are `formatted`; loss is true on the whole text of a trained role and on
    nothing else. valid: the machine accepts the roles in turn order; others are formatted all the same. Null texts and roles
    are empty; rows of one turn number go by role, then text; repeated rows stay; a null conv_id is a conversation of its own;
    no rows give no rows. A conversation is one output row, so it has to fit one task's memory.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", blank("role").alias("role"), blank("text").alias("text")))).alias("turns"))
    follow = F.create_map(*[x for k, v in template["follow"].items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    step = lambda state, t: F.when(F.coalesce(F.array_contains(F.try_element_at(follow, state), t["role"]), F.lit(False)), t["role"]).otherwise(F.lit("rejected"))
    trained = F.array(*map(F.lit, template["loss_roles"]))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(template["open"]), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
                part(escape(t["text"]), F.array_contains(trained, t["role"])),
                part(F.lit(template["close"]), F.lit(False)),
            ),
        )
    )
    out = ordered.select("conv_id", F.aggregate("turns", F.lit(template["start"]), step).isin(template["final"]).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Undoes `format_chats`: adds turns, an array of (role, text) read from the formatted string alone."""
    pieces = F.split("formatted", r"\Q" + template["close"] + r"\E")
    body = lambda p: F.substr(p, F.lit(len(template["open"]) + 1))
    turn = lambda p: F.struct(unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substr(body(p), F.instr(body(p), F.lit("\n")) + 1)).alias("text"))
    return formatted.withColumn("turns", F.transform(F.filter(pieces, lambda p: p != ""), turn))


def digests(chats: DataFrame) -> DataFrame:
    read = read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
