"""Documents to token ids: five of the operators, one after the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capspark.llm import classifier, decontamination, lines, near
from capspark.llm.queries import bpe_digests
from capspark.llm.session import written

SIMILARITY = 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = classifier.learn(docs, _table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model, score_col="__score")
    return scored.filter(F.col("__score") >= classifier.THRESHOLD).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many pages of a source hold go; n_chars is that of the text that is left."""
    clean = lines.drop_boilerplate(docs, "source", "text", counts=("__n_lines", "__n_dropped"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near.drop_near_duplicates(docs, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and the text they decode to, as digests."""
    return bpe_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: The classifier's fit has no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its result to the shared folder, the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    return last(spark, reduce(lambda d, s: written(s[1](spark, d, sf_dir), "stage"), first, docs), sf_dir)
