"""Chat formatting: one dialogue seen by each of its participants, in DataFrame functions only.

From a participant's perspective its own turns are the assistant's, everyone else is a named user,
and the mask covers what the assistant says. Turns stay rows, so a dialogue of any length is spread
over tasks; where a turn stands in the rendered dialogue comes from two-level running sums. The
sums over blocks of turns are made from lengths alone, so texts are shuffled once, by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capspark.llm.session import written

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text that cannot be taken for a control token."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column, name: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), _plain(name)), F.lit("")), F.lit("\n"))


def _before(said: DataFrame, shared: tuple[str, ...]) -> DataFrame:
    """said: g (dialogue d, block b), s, x. Returns g, p, before: for each block of a dialogue and
    each participant p the characters of all earlier blocks in p's view. Only lengths are shuffled."""
    common = F.col("s").isin(*shared)
    parts = said.groupBy("g", "s").agg(F.count("*").alias("n"), F.sum(F.length(_plain(F.col("x")))).alias("chars"))

    def chars(role: Column, name: Column) -> Column:
        return F.col("chars") + F.col("n") * (F.length(_head(role, name)) + len(CLOSE) + 1)

    other = chars(F.when(common, F.col("s")).otherwise(F.lit("user")), F.when(~common, F.col("s")))
    own = chars(F.lit("assistant"), F.lit(None).cast("string"))
    parts = written(parts.select("g", "s", other.alias("other"), (own - other).alias("more")), "parts")
    who = parts.filter(~common).select(F.struct("g.d").alias("k"), F.col("s").alias("p")).distinct()
    totals = parts.groupBy("g").agg(F.sum("other").alias("other")).withColumn("k", F.struct("g.d"))
    grid = totals.join(who, "k").join(parts.select("g", F.col("s").alias("p"), "more"), ["g", "p"], "left")
    earlier = Window.partitionBy("k", "p").orderBy("g.b").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("other") + F.coalesce("more", F.lit(0))).over(earlier)
    return grid.select("g", "p", F.coalesce(total, F.lit(0)).alias("before"))


def perspectives(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", shared: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each turn and each participant of its dialogue: dialogue, perspective (whose
    view it is), turn, speaker, role (assistant, user or system), name (of a named user, else
    null), rendered, n_chars, start (of the turn in the rendered dialogue, in characters), mask_start
    and mask_end (the span of the dialogue that is learned: the assistant's text and its end mark;
    null elsewhere).

    Participants are the dialogue's speakers but for the `shared` ones, whose turns keep their role
    in every view; a dialogue of shared turns only has no participant and no rows. A null text is
    rendered as an empty one. A null speaker is the participant "unknown"; a null dialogue is a
    dialogue of its own. Turns are ordered by turn (null first), speaker, text; repeated rows are
    rendered each. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    said = turns.select(
        F.col(dialogue).alias("d"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("s"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    said = said.select(F.struct("d", F.floor(F.col("t") / BLOCK).alias("b")).alias("g"), "t", "s", "x")  # a struct also joins on nulls
    rows = said.join(_before(said, shared).hint("merge"), "g")
    common, own = F.col("s").isin(*shared), F.col("s") == F.col("p")
    role = F.when(common, F.col("s")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(~common & ~own, F.col("s"))
    rows = rows.withColumn("role", role).withColumn("name", name)
    head = _head(F.col("role"), F.col("name"))
    rows = rows.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, _plain(F.col("x")), F.lit(CLOSE + "\n"))).withColumn("n_chars", F.length("rendered").cast("long"))
    within = Window.partitionBy("g", "p").orderBy("t", "s", "x").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_chars").over(within), F.lit(0)))
    start = F.col("before") + F.col("inside")
    learned = F.col("role") == "assistant"
    return rows.select(
        F.col("g.d").alias(dialogue),
        F.col("p").alias("perspective"),
        F.col("t").alias(turn),
        F.col("s").alias("speaker"),
        "role",
        "name",
        "rendered",
        "n_chars",
        start.cast("long").alias("start"),
        F.when(learned, start + F.col("head")).cast("long").alias("mask_start"),
        F.when(learned, start + F.col("n_chars") - 1).cast("long").alias("mask_end"),
    )
