"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other numbers has the
same template. Windows of template words are hash-joined: the benchmark and the documents have a
window at every word, so any run of WINDOW equal template words meets. The documents and items that
meet are compared window by window, and the placeholders of windows on one alignment must agree: one
value of the item stands for one value in the document. Windows of few plain words must have the
item's own values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capspark.llm.session import written

WINDOW = 8
MIN_COVERED = 0.5
MIN_PLAIN = 3  # words of a window that are no placeholders; with fewer, all values must be equal
#: Template words of an item that is searched for at least. A text of one or two words, "Yes" or "the
#: answer", is in documents that have never seen the benchmark.
LEAST_WORDS = 3
#: Benchmark windows up to which they are sent to every task; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

#: Units that may follow a number (fixed values).
UNITS = "km|kilometers?|kilometres?|cm|centimeters?|centimetres?|mm|m|meters?|metres?|miles?|feet|ft|inch(?:es)?|yards?|kg|kilograms?|g|grams?|mg|lbs?|pounds?|ounces?|oz|tons?|tonnes?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|l|liters?|litres?|ml|gallons?|mph|km/h|kmh|percent|dollars?|euros?|cents?|usd|eur|gbp|degrees?|volts?|watts?|joules?|newtons?"
_NUMBER = r"(?<![\p{L}\p{N}])\d+(?:[.,:/]\d+)*(?![\p{L}\p{N}])"
_UNIT = rf"(?i)(?<=\d )(?:{UNITS})(?![\p{{L}}\p{{N}}])"
_NAME = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}[\p{L}'’-]*"


def template_words(text: Column) -> Column:
    """The words of a text, in lower case and without punctuation; a placeholder is \\x01, its type
    (n number, u unit, a name) and its value."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01\\s]+", " ")
    t = F.regexp_replace(t, _UNIT, "\x01u$0")
    t = F.regexp_replace(t, _NAME, "\x01a$0")
    t = F.regexp_replace(t, _NUMBER, "\x01n$0")
    words = F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}\x01.,:/]+|[.,:/]+(?![\p{N}])|(?<![\p{N}])[.,:/]+")
    return F.filter(words, lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: the variable of a function over an array of one."""
    return F.transform(F.array(value), body)[0]


def _windows(text: Column, size: Column | int, also_slots: bool = False) -> Column:
    """(at, h: hash of the template, and slots if asked for) of the windows of a text; of a text
    shorter than size there are none. Placeholders count in the hash by their type alone."""
    size = F.lit(size) if isinstance(size, int) else size

    def of_words(words: Column) -> Column:
        at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
        types = F.transform(words, lambda w: F.xxhash64(F.when(w.startswith("\x01"), F.substring(w, 1, 2)).otherwise(w)))

        def window(i: Column, t: Column) -> Column:
            parts = [i.alias("at"), F.xxhash64(F.slice(t, i + 1, size)).alias("h")]
            if also_slots:
                parts += [F.filter(F.slice(words, i + 1, size), lambda w: w.startswith("\x01")).alias("slots"), F.size(words).alias("n")]
            return F.struct(*parts)

        return _let(types, lambda t: F.transform(at, lambda i: window(i, t)))

    return _let(template_words(text), of_words)


def _sized(windows: Column, size: int) -> Column:
    return F.transform(windows, lambda x: F.struct(F.lit(size).alias("size"), x["h"].alias("h")))


def _strict() -> Column:
    """Whether a window (size, slots) has so few plain words that its values count as well. Windows
    of one hash have one number of placeholders."""
    return F.col("size") - F.size("slots") < F.least(F.lit(MIN_PLAIN), "size")


def _values() -> Column:
    return F.when(_strict(), F.xxhash64("slots")).otherwise(F.lit(0).cast("long"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, n (words), size (of its windows: window, or the whole of a shorter item), at, h, slots,
    strict (fewer than MIN_PLAIN plain words, or than all the words of a shorter window), values (of
    a strict window: the hash of its slots)."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("t"), F.size(template_words(F.col(text_col))).alias("n")).filter("n > 0").distinct()
    items = items.withColumn("size", F.least(F.lit(window), "n"))
    rows = items.select("item", "n", "size", F.explode(_windows(F.col("t"), F.col("size"), also_slots=True)).alias("x"))
    rows = rows.select("item", "n", "size", "x.at", "x.h", "x.slots")
    return rows.withColumn("strict", _strict()).withColumn("values", _values())


def short_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id and n_words of the items that matches() does not search for, with texts of one word to
    fewer than least_words template words."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.size(template_words(F.col(text_col))).alias("n_words"))
    return rows.filter((F.col("n_words") > 0) & (F.col("n_words") < least_words))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_covered: float = MIN_COVERED, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that hold a benchmark item, one row for each: id_col, item_id, n_windows (of
    the item, found), covered (share of the item's words), exact (all placeholders have the item's
    own values).

    An item is found if at least min_covered of its words lie in windows whose placeholders agree.
    Items of fewer than least_words template words are not searched for; short_items() lists them.
    Two values of the item may stand for one value in the document. A capital letter makes a word a
    name only after another word, and units are English ones, so a name that begins a sentence must
    be equal, and in German any noun may stand for any other. A text's work grows with its words,
    whatever its length. Null or empty texts, on either side, match nothing. Rows that share an id are one document;
    a null id is not reported. Items with equal texts are each reported. Empty tables give no rows.
    Other columns are left out, whatever their names.
    """
    bench = written(benchmark_windows(benchmark, text_col="text", window=window).filter(F.col("n") >= least_words), "windows")
    n = bench.count()
    keys = bench.select("size", "h", "item").distinct()
    keys = F.broadcast(keys) if n <= BROADCAST_WINDOWS else keys
    short = [r[0] for r in bench.filter(F.col("size") < window).select("size").distinct().collect()]  # below window
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id is not null and t is not null")
    ask = F.concat(*[_sized(_windows(F.col("t"), k), k) for k in (window, *short)])
    met = texts.select("id", F.explode(ask).alias("x")).select("id", "x.size", "x.h").join(keys, ["size", "h"]).select("id", "item").distinct()
    met = written(met, "met")

    sizes = met.join(bench.select("item", "size").distinct(), "item").groupBy("id").agg(F.collect_set("size").alias("sizes"))  # at most `window` sizes
    near = texts.join(sizes, "id").select("id", "t", F.explode("sizes").alias("size"))
    near = near.select("id", "size", F.explode(_windows(F.col("t"), F.col("size"), also_slots=True)).alias("x")).select("id", "size", "x.*")
    known = bench.select("size", "h").distinct()
    known = F.broadcast(known) if n <= BROADCAST_WINDOWS else known
    near = near.join(known, ["size", "h"], "left_semi").select("id", "size", F.col("at").alias("d_at"), "h", F.col("slots").alias("d_slots"), _values().alias("values"))
    pairs = near.join(bench, ["size", "h", "values"]).join(met, ["id", "item"]).select("id", "item", "n", "size", "at", (F.col("d_at") - F.col("at")).alias("shift"), "slots", "d_slots", "strict").filter("not strict or slots = d_slots")
    pairs = written(pairs, "pairs")

    slot = pairs.filter("not strict").select("id", "item", "shift", F.explode(F.arrays_zip("slots", "d_slots")).alias("z")).select("id", "item", "shift", F.col("z.slots").alias("i"), F.col("z.d_slots").alias("d")).distinct()
    agree = slot.groupBy("id", "item", "shift").agg(F.count("*").alias("values"), F.countDistinct("i").alias("of"), F.max(F.col("i") != F.col("d")).alias("other"))
    good = pairs.join(agree, ["id", "item", "shift"], "left").filter("strict or of is null or values = of")
    found = good.groupBy("id", "item", "n").agg(F.countDistinct("at").alias("n_windows"), (~F.coalesce(F.max(F.expr("other and not strict")), F.lit(False))).alias("exact"))
    covered = good.select("id", "item", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("word")).distinct().groupBy("id", "item").agg(F.count("*").alias("words"))
    return (
        found.join(covered, ["id", "item"])
        .filter(F.col("words") >= F.col("n") * F.lit(min_covered))
        .select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "n_windows", (F.col("words") / F.col("n")).alias("covered"), "exact")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay. Rows without an id stay."""
    gone = written(matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__gone")).distinct(), "contaminated")
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
