"""Tables of a folder whose parts count only once they are committed.

A part is written to a folder of its own version first; its row in the manifest, one small file that
appears at once, is written after it. Readers take the versions that the manifest names, so a part
whose writer has died between the two is as if it had never been, and the older one stays.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class Ledger:
    """root: a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "long"):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), f"video_id {kind}, stage string, version long"

    def new_version(self) -> int:
        """Larger than any before, also those of writers that have died."""
        return time.time_ns()

    def put(self, table: str, df: DataFrame, version: int) -> DataFrame:
        """Write df as a part of table; nobody sees it before commit(). Returns it, read back."""
        path = f"{self.root}/{table}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, stage: str, version: int, videos: DataFrame) -> None:
        """From now on what `version` has of stage counts for videos (video_id)."""
        rows = videos.select("video_id", F.lit(stage).alias("stage"), F.lit(version).cast("long").alias("version"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        """video_id, stage, version: the newest committed one of each stage."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() not in _MISSING:
                raise
            return self.spark.createDataFrame([], self.schema)
        return rows.groupBy("video_id", "stage").agg(F.max("version").alias("version"))

    def valid(self, stages: tuple[str, ...]) -> DataFrame:
        """video_id, stage, version of the stages whose result is newer than those of all stages before:
        once a stage has run again, what was made from its old result has to be made anew."""
        at = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
        rows = self.manifest().withColumn("at", at).filter("at > 0")
        every = F.sort_array(F.collect_list(F.struct("at", "stage", "version")))  # one for each stage
        rows = rows.groupBy("video_id").agg(every.alias("s")).select("video_id", F.explode("s").alias("x"), "s")
        newer = F.forall("s", lambda y: (y["at"] >= F.col("x.at")) | (y["version"] < F.col("x.version")))
        return rows.filter(newer).select("video_id", "x.stage", "x.version")

    def read(self, table: str, committed: DataFrame) -> DataFrame:
        """Rows of table in the versions of committed (video_id, version). Folders of no such version are not read."""
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        wanted = committed.select("video_id", F.col("version").cast(dict(rows.dtypes)["version"]).alias("version"))
        return rows.join(wanted, ["video_id", "version"], "left_semi").drop("version")

    def parts(self, table: str, versions: list[int], schema: str) -> DataFrame:
        """Rows of table in these versions (one for each batch or round) with their version."""
        if not versions:
            return self.spark.createDataFrame([], f"{schema}, version long")
        rows = self.spark.read.schema(f"{schema}, version long").option("basePath", f"{self.root}/{table}")
        return rows.parquet(*[f"{self.root}/{table}/version={v}" for v in versions])
