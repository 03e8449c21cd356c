"""Preparing texts for a translator and putting its answers back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capspark.functions import columns as C
from capspark.params import DEFAULTS, Params
from capspark.sources.ledger import Ledger

#: Name of a line with a speaker: 1 to 8 characters before an opening quote (a fixed value).
SPEAKER = r"(?U)^([^「『\s]{1,8})[「『]"
TEMPLATE = "Translate these {lang} subtitle lines into Chinese. Give one line for each, in order, and nothing else."


def detect_lang(subs: DataFrame, opt: str = "auto", p: Params = DEFAULTS) -> DataFrame:
    """video_id, lang: "en" if more than ascii_share of a video's characters are ASCII, else "ja"; or
    the given option."""
    share = F.sum(F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))) / F.greatest(F.sum(F.length("text")), F.lit(1))
    rows = subs.groupBy("video_id").agg(share.alias("s"))
    lang = F.when(F.col("s") > p.ascii_share, "en").otherwise("ja") if opt == "auto" else F.lit(opt)
    return rows.select("video_id", lang.alias("lang"))


def pending(subs: DataFrame, done: DataFrame) -> DataFrame:
    return subs.join(done.select("video_id", "event_id"), ["video_id", "event_id"], "left_anti")


def speaker_names(subs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """video_id, name, ord: the first max_names speakers of a video by where they first speak."""
    name = F.regexp_extract("text", SPEAKER, 1)
    first = subs.select("video_id", "event_id", name.alias("name")).filter("name <> ''").groupBy("video_id", "name").agg(F.min("event_id").alias("first"))
    rows = first.withColumn("ord", F.row_number().over(Window.partitionBy("video_id").orderBy("first", "name")))
    return rows.filter(F.col("ord") <= p.max_names).select("video_id", "name", "ord")


def clean_name(answer: Column) -> Column:
    """The first line of an answer, stripped, without quotes around it."""
    line = C.strip(F.split(C.strip(answer), C.LINE_END, 2)[0])
    return F.regexp_replace(line, r"""^["'「」『』“”]+|["'「」『』“”]+$""", "")


def glossary(names: DataFrame, answers: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """names with zh: names of kanji stay, others take the answer (video_id, name, answer); without a
    usable one they are dropped, and no later name moves up."""
    rows = names.join(answers, ["video_id", "name"], "left")
    zh = F.when(F.col("name").rlike("^[一-鿿]+$"), F.col("name")).otherwise(clean_name(F.col("answer")))
    return rows.withColumn("zh", zh).filter(F.col("zh").isNotNull() & (F.col("zh") != "") & (F.length("zh") <= p.max_translated_name_len)).select("video_id", "ord", "name", "zh")


def ask_names(names: DataFrame, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """video_id, name, answer of a user's name translator; an answer that fails is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                try:
                    out.append(ask(name))
                except Exception:  # the name is then left out of the glossary
                    out.append(None)
            yield pdf.assign(answer=out)

    kind = dict(names.dtypes)["video_id"]
    return names.filter(~F.col("name").rlike("^[一-鿿]+$")).select("video_id", "name").mapInPandas(run, f"video_id {kind}, name string, answer string")


def glossary_text(entries: DataFrame) -> DataFrame:
    """One text a video, a line for each of its at most max_names names."""
    line = F.struct("ord", F.concat("name", F.lit("->"), "zh", F.lit(" #人名")).alias("line"))
    return entries.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("glossary"))


def batches(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pending rows with batch and pos in it, in order of event_id; line breaks become wide spaces."""
    rn = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id")) - 1
    return rows.withColumn("__rn", rn).select("video_id", "event_id", F.floor(F.col("__rn") / p.batch).cast("long").alias("batch"), (F.col("__rn") % p.batch).cast("int").alias("pos"), F.translate("text", "\n", "　").alias("line"))


def history_before_batch(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """video_id, batch, history: the last translations before each batch. rows: batches() with zh."""
    w = Window.partitionBy("video_id").orderBy("event_id").rowsBetween(-p.history, -1)
    return rows.withColumn("history", F.collect_list("zh").over(w)).filter("pos = 0").select("video_id", "batch", "history")


def build_prompts(rows: DataFrame, history: DataFrame, glossaries: DataFrame, langs: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """video_id, batch, prompt. A batch has at most `batch` lines."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    b = rows.groupBy("video_id", "batch").agg(F.array_join(lines, "\n").alias("lines"))
    b = b.join(history, ["video_id", "batch"], "left").join(glossaries, "video_id", "left").join(langs, "video_id", "left")
    before = F.when(F.size("history") > 0, F.concat(F.lit("Before:\n"), F.array_join("history", "\n")))
    names = F.when(F.length("glossary") > 0, F.concat(F.lit("Names:\n"), F.col("glossary")))
    named = F.when(F.col("lang") == "en", "English").otherwise("Japanese")
    order = F.replace(F.lit(template), F.lit("{lang}"), named)
    return b.select("video_id", "batch", F.concat_ws("\n\n", before, names, order, "lines").alias("prompt"))


def align_reply(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """video_id, event_id, zh for batches whose reply (video_id, batch, reply) has as many lines as
    the batch; others give nothing."""
    sizes = rows.groupBy("video_id", "batch").agg(F.count("*").alias("n"))
    ok = replies.withColumn("got", C.lines_of(F.col("reply"))).join(sizes, ["video_id", "batch"]).filter(F.size("got") == F.col("n"))
    at = ok.select("video_id", "batch", F.posexplode("got").alias("pos", "zh"))
    return rows.join(at, ["video_id", "batch", "pos"]).select("video_id", "event_id", "zh")


def align_with_fallback(rows: DataFrame, reply1: DataFrame, reply2: DataFrame, single: DataFrame) -> DataFrame:
    """video_id, event_id, zh: from the first good reply of two, else the first line of the row's own
    reply (video_id, event_id, reply), else the line itself."""
    a = align_reply(rows, reply1).withColumnRenamed("zh", "a")
    b = align_reply(rows, reply2).withColumnRenamed("zh", "b")
    one = single.select("video_id", "event_id", C.lines_of(F.col("reply"))[0].alias("c"))
    out = rows.join(a, ["video_id", "event_id"], "left").join(b, ["video_id", "event_id"], "left").join(one, ["video_id", "event_id"], "left")
    return out.select("video_id", "event_id", F.coalesce("a", "b", "c", "line").alias("zh"))


def _lines(text: str) -> list[str]:
    return [x for x in (y.strip() for y in text.splitlines()) if x]


def _answers(ask: Callable[[str, float], str], lines: list[str], past: list[str], names: str, order: str) -> list[str]:
    """A text for each line: of a reply with as many lines, asked for twice, else line by line, each
    with the same history; a line without an answer stays as it is."""

    def reply(some: list[str], heat: float) -> list[str]:
        parts = ["Before:\n" + "\n".join(past)] if past else []
        parts += ["Names:\n" + names] if names else []
        try:
            return _lines(ask("\n\n".join([*parts, order, "\n".join(some)]), heat))
        except Exception:  # no answer: the next way is tried
            return []

    for heat in (0.3, 0.1):
        if len(got := reply(lines, heat)) == len(lines):
            return got
    return [(reply([x], 0.1) or [x])[0] for x in lines]


def ask_batches(rows: DataFrame, model: Callable[[], Callable[[str, float], str]], template: str = TEMPLATE) -> DataFrame:
    """video_id, event_id, zh of batches that do not need each other: rows video_id, lines (array of
    event_id, line, in order), history (array), glossary, lang. The model is made once for a task."""
    kind = dict(rows.dtypes)["video_id"]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                order = template.replace("{lang}", "English" if r.lang == "en" else "Japanese")
                past = [] if r.history is None else list(r.history)
                got = _answers(ask, [x["line"] for x in r.lines], past, r.glossary if isinstance(r.glossary, str) else "", order)
                out += [(r.video_id, x["event_id"], zh) for x, zh in zip(r.lines, got, strict=True)]
            yield pd.DataFrame(out, columns=["video_id", "event_id", "zh"])

    return rows.select("video_id", "lines", "history", "glossary", "lang").mapInPandas(run, f"video_id {kind}, event_id long, zh string")


def translate(subs: DataFrame, done: DataFrame, glossaries: DataFrame, langs: DataFrame, model: Callable[[], Callable[[str, float], str]], ledger: Ledger, p: Params = DEFAULTS, template: str = TEMPLATE, tasks: int | None = None) -> DataFrame:
    """video_id, event_id, zh of the pending rows by a user's model(prompt, temperature), which sees
    the last translations before each batch.

    Batch k of all videos is round k: its rows are read with the texts that round k - 1 has stored,
    dealt evenly to tasks, and stored before the next one begins. A run that breaks keeps its rounds:
    called again with the same ledger it goes on with the first round that is not committed, with
    the batches and the history that it had, and asks nothing twice; a lost executor costs the
    batches of its tasks in one round. History starts empty with a new ledger, whatever done holds.
    A video needs as many rounds as it has batches; videos run side by side.
    """
    spark = subs.sparkSession
    kind = dict(subs.dtypes)["video_id"]
    known = {r["stage"]: r["version"] for r in ledger.manifest().select("stage", "version").collect()}  # a row for each round
    one = spark.createDataFrame([(None,)], f"video_id {kind}")
    if "plan" not in known:
        version = ledger.new_version()
        rows = batches(pending(subs, done), p).join(glossaries, "video_id", "left").join(langs, "video_id", "left")
        line = F.sort_array(F.collect_list(F.struct("pos", "event_id", "line"))).alias("lines")  # at most p.batch
        ledger.put("plan", rows.groupBy("video_id", "batch").agg(line, F.max("glossary").alias("glossary"), F.max("lang").alias("lang")), version)
        ledger.commit("plan", version, one)
        known["plan"] = version
    part = lambda table, v: spark.read.parquet(f"{ledger.root}/{table}/version={v}")
    plan = part("plan", known["plan"])
    last = plan.agg(F.max("batch")).head()[0]
    rounds = 0 if last is None else last + 1
    tasks = tasks or spark.sparkContext.defaultParallelism
    back = -(-p.history // p.batch)  # rounds that a history may come from; all but a video's last batch are full
    found = []
    for k in range(rounds):
        stage = f"round {k}"
        if stage not in known:
            rows = plan.filter(F.col("batch") == k)
            if found and p.history:
                past = reduce(DataFrame.unionByName, found[-back:]).select("video_id", F.struct("event_id", "zh").alias("x"))
                past = past.groupBy("video_id").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most back * p.batch
                past = past.select("video_id", F.transform(F.slice("x", F.greatest(F.lit(1), F.size("x") - p.history + 1), F.lit(p.history)), lambda y: y["zh"]).alias("history"))
                rows = rows.join(past, "video_id", "left")
            else:
                rows = rows.withColumn("history", F.lit(None).cast("array<string>"))
            version = ledger.new_version()
            ledger.put("rounds", ask_batches(rows.repartition(tasks), model, template), version)
            ledger.commit(stage, version, one)
            known[stage] = version
        found.append(part("rounds", known[stage]))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"video_id {kind}, event_id long, zh string")


def upsert(done: DataFrame, new: DataFrame) -> DataFrame:
    """done and new (video_id, event_id, zh): the new text wins; ids that no subtitle has stay."""
    rows = done.select("video_id", "event_id", "zh", F.lit(0).alias("v")).unionByName(new.select("video_id", "event_id", "zh", F.lit(1).alias("v")))
    return rows.groupBy("video_id", "event_id").agg(F.max(F.struct("v", "zh")).alias("m")).select("video_id", "event_id", F.col("m.zh").alias("zh"))


def coverage(subs: DataFrame, done: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """video_id, total, translated, batches_left."""
    rows = subs.select("video_id", "event_id").join(done.select("video_id", "event_id", F.lit(1).alias("one")), ["video_id", "event_id"], "left")
    left = F.count("*") - F.count("one")
    return rows.groupBy("video_id").agg(F.count("*").alias("total"), F.count("one").alias("translated"), F.ceil(left / p.batch).cast("long").alias("batches_left"))
