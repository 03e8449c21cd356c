"""Ordered folds of long groups on many tasks.

A fold decides, row after row, whether a row joins what came before or cuts it off, by a state that
grows while rows join. A group is cut into blocks, and all blocks are folded at once: first as if each
began anew, then again with the state that the blocks before it hand on, until no block is handed
another state than it was folded with. That is then the fold of the whole group: the first block was
right from the start, and each other one was folded with what the right ones before it give.

What a block hands on is what its rows since its last cut add up to, together, if it has no cut, with
what it was handed itself. So a state passes blocks that do not cut in one round, and rounds are
needed only where another state moves a cut; only the blocks concerned are folded again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capspark.sources.shared import written

#: fold(rows of a block in order, with the state handed on in columns e_... that are null where it
#: begins anew; rows of its side table) gives (place, cut, what the rows since the last cut add up to) of each row.
Fold = Callable[[pd.DataFrame, pd.DataFrame | None], list[tuple]]


def blocked_fold(
    rows: DataFrame,
    narrow: DataFrame,
    keys: list[str],
    place: str,
    state: dict[str, str],
    add_up: Callable[[Window], dict[str, Column]],
    fold: Fold,
    enter: Callable[[DataFrame], DataFrame] = lambda handed: handed,
    side: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """keys, place, cut. rows: keys, blk (0.. in order within the group), place (long, the order), and
    what fold needs; narrow: the same rows with keys and blk at least. state: names and types; add_up: the state's columns over a window of blocks;
    enter may add columns e_... to handed states (keys, blk, e_ and state); side gives a table by keys
    and blk for rows with their handed states. Groups of one block are folded once, without an action;
    for others rounds run, their tables in the shared folder."""
    at = [*keys, "blk"]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in at), f"`{place}` long, cut boolean", *(f"`{c}` {t}" for c, t in state.items())])
    names = [*at, place, "cut", *state]

    def run(pdf: pd.DataFrame, more: pd.DataFrame | None = None) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=names)
        key = [pdf[k].iloc[0] for k in at]
        return pd.DataFrame([(*key, *x) for x in fold(pdf.sort_values(place), more)], columns=names)

    def folded(part: DataFrame, handed: DataFrame | None) -> DataFrame:
        if handed is None:
            part = part.select("*", *[F.lit(None).cast(t).alias(f"e_{c}") for c, t in entered])
        else:
            part = part.join(handed, at)
        if side is None:
            return part.groupBy(*at).applyInPandas(lambda a: run(a), schema)
        beside = side(part).withColumnsRenamed({k: f"s_{k}" for k in at})
        beside = beside.select(*[F.col(c).alias(c) for c in beside.columns])
        return part.groupBy(*at).cogroup(beside.groupBy(*[f"s_{k}" for k in at])).applyInPandas(lambda a, b: run(a, b), schema)

    entered = list(state.items())
    more = set(enter(rows.select(*at, *[F.lit(None).cast(t).alias(f"e_{c}") for c, t in entered])).dtypes) - {(k, kinds[k]) for k in at}
    entered += sorted((c.removeprefix("e_"), t) for c, t in more if c.removeprefix("e_") not in state)

    long = narrow.filter("blk > 0").select(*keys).distinct()
    if long.isEmpty():
        return folded(rows, None).select(*keys, place, "cut")
    short = folded(rows.join(long, keys, "left_anti"), None).select(*keys, place, "cut")
    rows = written(rows.join(long, keys, "left_semi"), "blocks")
    got, used = written(folded(rows, None), "folded"), None
    by_blk = Window.partitionBy(*keys).orderBy("blk")
    since = Window.partitionBy(*keys, "since").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        blocks = got.groupBy(*at).agg(F.max_by(F.struct(*state), place).alias("x"), F.max("cut").alias("cuts")).select(*at, "x.*", "cuts")
        blocks = blocks.withColumn("since", F.sum(F.col("cuts").cast("int")).over(by_blk))
        blocks = blocks.select(*at, *[c.alias(f"a_{k}") for k, c in add_up(since).items()])
        handed = blocks.select(*at, *[F.lag(f"a_{c}").over(by_blk).alias(f"e_{c}") for c in state]).filter("blk > 0")
        handed = written(handed, "handed")
        news = handed
        if used is not None:
            old = used.select(*at, *[F.col(f"e_{c}").alias(f"o_{c}") for c in state])
            same = " and ".join(f"e_{c} <=> o_{c}" for c in state)
            news = handed.join(old, at).filter(f"not ({same})").select(*handed.columns)
        if news.isEmpty():
            return short.unionByName(got.select(*keys, place, "cut"))
        again = folded(rows.join(news.select(*at), at, "left_semi"), enter(news))
        got = written(got.join(news.select(*at), at, "left_anti").unionByName(again), "folded")
        used = handed
