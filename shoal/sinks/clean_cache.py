"""The cache of commits in which a scan found nothing: an append-only Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

CLEAN = "owner string, repo_name string, sha string, tag string"


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The cache; empty where nothing was written yet."""
    try:
        return spark.read.schema(CLEAN).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CLEAN)


def append_clean(clean: DataFrame, path: str) -> None:
    """Adds commits that the cache doesn't hold; of one commit's tags the first by name stays."""
    known = read_clean(clean.sparkSession, path).select("owner", "repo_name", "sha")
    new = clean.groupBy("owner", "repo_name", "sha").agg({"tag": "min"}).withColumnRenamed("min(tag)", "tag")
    new.join(known, ["owner", "repo_name", "sha"], "left_anti").write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> bool:
    """Removes the cache; whether there was one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
