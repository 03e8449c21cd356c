"""Line dedup by site-relative frequency.

For every host, the pages that hold a line are divided by the host's pages; lines above a ratio
are boilerplate and dropped from that host's pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capspark.llm.session import bound_batches, written

#: A line of LONG characters or more does not come again by chance, so a lower share of a host's
#: pages makes it boilerplate: written text has such lines on far fewer than one page in a hundred.
MAX_RATIO = 0.1
MAX_RATIO_LONG = 0.02
LONG = 25
MIN_PAGES = 5
#: Pages of a host that are joined with its boilerplate together; a larger host is dealt to as many
#: parts as it needs. Where that made more parts than LARGE_HOSTS, parts are larger.
HOST_PAGES = 50_000
LARGE_HOSTS = 200_000

#: White space at a line's ends (fixed values).
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case, without port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _key(bare: Column) -> Column:
    """63 bits of a bare line's hash, and whether it is long in the last. Keys are only compared
    within a host: two lines of it share one with a chance of 1 in 4e18 for each pair."""
    return F.xxhash64(bare).bitwiseOR(F.lit(1)) - F.when(F.length(bare) >= LONG, F.lit(0)).otherwise(F.lit(1))


def _keys(text: Column) -> Column:
    """A key for each line; that of the empty line stands for all blank ones."""
    return F.transform(F.split(text, "\n", -1), lambda line: _key(F.btrim(line, F.lit(_BLANKS))))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, max_ratio_long: float = MAX_RATIO_LONG) -> DataFrame:
    """(host, keys): for each host the keys of its boilerplate lines. A host has at most
    (mean distinct lines of its pages) / max_ratio_long of them, whatever its number of pages. The
    pages are counted by line after map-side sums, so a hot host or line is spread over the tasks.
    """
    keys = F.array_except(_keys(F.coalesce(F.col(text_col), F.lit(""))), F.array(_key(F.lit(""))))  # distinct
    rows = pages.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), keys.alias("keys"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    ratio = F.when(F.col("key") % 2 != 0, F.lit(max_ratio_long)).otherwise(F.lit(max_ratio))
    hot = counts.join(totals, "host").filter(F.col("n") > F.col("pages") * ratio)
    return hot.groupBy("host").agg(F.collect_list("key").alias("keys"))


def _parts(pages: DataFrame, host: Column) -> DataFrame:
    """host, parts of the hosts with more than HOST_PAGES pages: at most LARGE_HOSTS of them."""
    totals = written(pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages")), "hosts")
    n = totals.agg(F.sum("pages")).head()[0] or 0
    rows = max(HOST_PAGES, -(-n // LARGE_HOSTS))
    return totals.filter(F.col("pages") > rows).select("host", F.ceil(F.col("pages") / rows).cast("long").alias("parts"))


def _without():
    """(text, the keys of its lines, those that go) -> the text without these lines."""

    def make(texts: pa.Array, keys: pa.Array, gone: pa.Array) -> pa.Array:
        out: list[str | None] = [None] * len(texts)
        for i in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist():
            stays = ~np.isin(keys[i].values.to_numpy(), gone[i].values.to_numpy())
            out[i] = "\n".join([x for x, stay in zip(texts[i].as_py().split("\n"), stays.tolist(), strict=True) if stay])
        return pa.array(out, pa.string())

    return F.arrow_udf(make, "string")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, max_ratio_long: float = MAX_RATIO_LONG, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """pages with text_col cleaned, and n_lines and n_dropped, or what `counts` names them, beside the
    given columns (columns of these names are replaced).

    Lines end at \\n and are compared without white space at their ends. A line goes if more than
    max_ratio of its host's pages hold it (max_ratio_long of LONG characters or more) and at least
    min_pages do; blank lines stay. A null host counts as the host "". A null text stays null and
    counts as a page without lines; so does an empty one. Repeated rows are pages of their own. A
    page that loses all its lines stays, with an empty text. A page's work grows with its lines, how
    many of them go. A host's pages are dealt to parts, so no task has more than HOST_PAGES of them.
    """
    bound_batches(pages.sparkSession)
    host = F.coalesce(F.col(host_col), F.lit(""))
    hot = written(boilerplate(pages, host_col, text_col, max_ratio, min_pages, max_ratio_long), "boilerplate")
    parts = _parts(pages, host)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    hot = hot.join(F.broadcast(parts), "host", "left").select(F.col("host").alias("__host"), F.col("keys").alias("__keys"), every.alias("__part"))
    hot = written(hot, "hot")  # its size is then known: where it is small it goes to the pages
    parts = parts.select(F.col("host").alias("__of"), F.col("parts").alias("__parts"))
    joined = pages.drop(*counts).withColumn("__h", host)
    joined = joined.join(F.broadcast(parts), F.col("__h") == F.col("__of"), "left")
    joined = joined.withColumn("__p", F.coalesce(F.pmod(F.xxhash64(text_col), F.col("__parts")), F.lit(0).cast("long")))
    joined = joined.join(hot, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__part")), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = joined.withColumn("__all", F.when(F.col("__keys").isNotNull(), _keys(text)))
    joined = joined.withColumn("__gone", F.array_intersect("__all", "__keys"))
    some = F.coalesce(F.size("__gone"), F.lit(0)) > 0
    asked = [F.when(some, c) for c in (text, F.col("__all"), F.col("__gone"))]
    joined = joined.withColumn("__kept", _without()(*asked))
    clean = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(F.coalesce("__kept", text_col))
    n_all = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    n = F.when(text == "", F.lit(0)).otherwise(n_all)
    left = F.size(F.array_except(F.array_distinct("__all"), "__gone"))
    n_kept = F.when(left == 0, F.lit(0)).otherwise(F.length("__kept") - F.length(F.replace("__kept", F.lit("\n"))) + 1)
    dropped = F.when(some, n_all - n_kept).otherwise(F.lit(0))
    out = [clean.alias(c) if c == text_col else F.col(c) for c in pages.columns if c not in counts]
    return joined.select(*out, n.cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1]))
