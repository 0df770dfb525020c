"""Preference formatting, in DataFrame functions only.

The chosen and the rejected conversation of a pair are compared turn by turn. Their longest common prefix is rendered
once as the prompt; what follows is rendered as two completions. A completion's mask lists the spans, in code
points, that are trained on: each assistant text with its end marker.

Markers inside a role or text would end or begin turns, so they are broken by a space (``<| im_end|>``) before anything
else; no text can forge a turn.

Turns are ordered by turn, then role and text. A conversation is one row of the result and so is gathered whole; its
size is bounded by that of a string. Null roles count as ``user``, null texts as empty. Turns without a pair id are
left out; a pair with one side only gets an empty conversation for the other. Equal conversations are all prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _harmless(text: Column) -> Column:
    for marker in (START, END):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("<|", "<| ")))
    return text


def _render(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans (start, stop) of the trained parts of the rendered turns."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(turn["role"]) + len(START) + 1
        stop = start + F.char_length(turn["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + 1).alias("at"),
            F.when(turn["role"] == trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def _gathered(turns: DataFrame, pair: str, turn: str, role: str, text: str, name: str) -> DataFrame:
    told = (_harmless(F.coalesce(F.col(c), F.lit(default))).alias(field) for c, default, field in ((role, "user", "role"), (text, "", "text")))
    row = F.struct(F.col(turn).alias("turn"), *told)
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id")).agg(listed.alias(name))


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant"
) -> DataFrame:
    """Per pair: pair_id, common_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    columns = (pair_col, turn_col, role_col, text_col)
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = (
        _gathered(chosen, *columns, "a").join(_gathered(rejected, *columns, "b"), "pair_id", "full").select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    )
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, F.lit(False)).cast("int")  # 0: none
    common = F.when(first_other == 0, F.size("a")).otherwise(first_other - 1)
    rest = lambda c: F.slice(c, F.col("common_turns") + 1, F.size(c))
    cut = both.withColumn("common_turns", common)
    return cut.select(
        "pair_id",
        "common_turns",
        _joined(F.slice("a", F.lit(1), F.col("common_turns"))).alias("prompt"),
        _joined(rest("a")).alias("chosen"),
        _joined(rest("b")).alias("rejected"),
        _mask(rest("a"), trained).alias("chosen_mask"),
        _mask(rest("b"), trained).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from a table of conversations (conv_id, turn, role, text).

    Chosen: each conversation up to its last assistant turn (all of it, if there is none). Rejected: the same with
    that turn's text replaced by the last assistant text of the conversation whose id differs in the lowest bit only
    (empty if there is none). Of several assistant rows in the last turn, the greatest text counts as the answer.
    """
    turns = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("answer"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer.text").alias("other"))
    told = turns.join(last.select("conv_id", F.col("answer.turn").alias("end")), "conv_id", "left").where("end is null or turn <= end")
    answer = (F.col("role") == "assistant") & (F.col("turn") == F.col("end"))
    replaced = told.join(other, "conv_id", "left").withColumn("text", F.when(answer, F.coalesce("other", F.lit(""))).otherwise(F.col("text")))
    return told.select("conv_id", "turn", "role", "text"), replaced.select("conv_id", "turn", "role", "text")
