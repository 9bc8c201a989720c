"""Dialogue-level operators: assemble, cut, split, validate, chat messages.

A dialogue is a list ``QA = [head, q1, a1, q2, a2, ...]``.  Stored as turn
rows ``(key, pos, text)`` it can be cut to T turns by a plain filter on the
position (``pos < 2*T+1``) before anything is grouped, so the array a cut
operator builds is bounded by T whatever the size of the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X

# Organizer validation outcomes.
VALID = "valid"
FORMAT_ERROR = "QA format Error."
EARLY_STOP = "Early Stop Error."
GENERIC_ERROR = "Error"


def assemble_dialogue(turn_rows: DataFrame, keys: list[str], pos_col: str = "pos",
                      text_col: str = "text", max_items: int | None = None) -> DataFrame:
    """Turn rows -> one row per dialogue with ``QA ARRAY<STRING>`` in
    position order.  ``max_items`` keeps only the first items (a filter on
    the position, applied before the shuffle)."""
    rows = turn_rows
    if max_items is not None:
        rows = rows.where(F.col(pos_col) < max_items)
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("t"))))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda s: s["t"]).alias("QA"))


def cut_turns(qa, turns: int) -> Column:
    """``QA[:2*turns+1]`` (past the end is safe)."""
    return F.slice(X._c(qa), 1, 2 * turns + 1)


def cut_run(df: DataFrame, turns: int, qa_col: str = "QA", turn_col: str = "turn") -> DataFrame:
    """A run cut to ``turns`` is a run of its own: its dialogues are cut and
    carry the new turn number, so that writing it leaves the longer run as
    it is."""
    return df.withColumn(qa_col, cut_turns(qa_col, turns)).withColumn(turn_col, F.lit(turns).cast(df.schema[turn_col].dataType))


def head(qa) -> Column:
    return F.try_element_at(X._c(qa), F.lit(1))


def body(qa, turns: int) -> Column:
    """``QA[1:2*turns+1]``: the question / answer items after the head."""
    return F.slice(X._c(qa), 2, 2 * turns) if turns > 0 else F.array().cast("array<string>")


def marker_count(qa, turns: int, marker: str = "Question:") -> Column:
    """Occurrences of the question marker in the joined body."""
    return X.count_marker(F.array_join(body(qa, turns), ""), marker)


def validate_turns(qa, turns: int, marker: str = "Question:") -> Column:
    """``valid`` / ``QA format Error.`` (more markers than turns) /
    ``Early Stop Error.`` (fewer) / ``Error`` (count fits but items are
    missing, where the original fails on an index)."""
    n = marker_count(qa, turns, marker)
    return (F.when(n > turns, F.lit(FORMAT_ERROR))
            .when(n < turns, F.lit(EARLY_STOP))
            .when(F.size(body(qa, turns)) < 2 * turns, F.lit(GENERIC_ERROR))
            .otherwise(F.lit(VALID)))


def chat_roles(mode: str, pos: Column) -> Column:
    """Role of history item ``pos`` (0-based) for the doctor or patient
    view: doctor sees even items as user, patient sees odd items as user."""
    even = (pos % 2) == 0
    user = even if mode == "doctor" else ~even
    return F.when(user, F.lit("user")).otherwise(F.lit("assistant"))


def chat_messages(qa, system_prompt, mode: str = "doctor") -> Column:
    """``[{system}, {role, content} per history item]`` as
    ``ARRAY<STRUCT<role, content>>``."""
    sys_msg = F.struct(F.lit("system").alias("role"), X._c(system_prompt).alias("content"))
    items = F.transform(X._c(qa), lambda x, i: F.struct(chat_roles(mode, i).alias("role"), x.alias("content")))
    return F.concat(F.array(sys_msg), items)


def chat_message_rows(turn_rows: DataFrame, keys: list[str], system_prompt: Column, mode: str,
                      pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """The same messages as rows ``(keys, msg_idx, role, content)`` straight
    from turn rows in one scan: item 0 brings the system row along, and no
    dialogue is ever collected into one row."""
    item = F.struct((F.col(pos_col) + 1).cast("bigint").alias("msg_idx"), chat_roles(mode, F.col(pos_col)).alias("role"),
                    F.col(text_col).alias("content"))
    system = F.struct(F.lit(0).cast("bigint").alias("msg_idx"), F.lit("system").alias("role"),
                      system_prompt.alias("content"))
    rows = F.explode(F.when(F.col(pos_col) == 0, F.array(system, item)).otherwise(F.array(item)))
    return turn_rows.select(*keys, rows.alias("m")).select(*keys, "m.*")
