"""References as a stream: each owner/repo@ref once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.refs import parse_uses


def new_refs(lines: DataFrame, delay: str = "1 day") -> DataFrame:
    """From a stream of (seen_at timestamp, repo, workflow, raw_line): the first use of each action and
    ref; state older than the watermark is dropped."""
    rows = lines.withWatermark("seen_at", delay).withColumn("u", parse_uses(F.col("raw_line"))).where("u is not null")
    return rows.select("seen_at", "repo", "workflow", "u.*").dropDuplicatesWithinWatermark(["owner", "repo_name", "ref_string"])
