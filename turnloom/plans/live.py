"""Queries of the streaming operators, run over the whole table as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import views
from ..streaming import turns
from .registry import MERGED, SEGMENTS, query


@query("merge_turns_live", f"WITH {MERGED} SELECT rec, speaker, channel, start_us, end_us, parts FROM merged")
def merge_turns_live(spark: SparkSession, d: str) -> DataFrame:
    return turns.merge_live(views.segments(spark, d))


@query("talk_time", f"""WITH {SEGMENTS} SELECT speaker, CAST(start_us // 3600000000 * 3600000000 AS BIGINT) AS from_us, count(*) AS segments, CAST(sum(dur_us) AS BIGINT) AS talk_us
FROM v_segments GROUP BY 1, 2""")
def talk_time(spark: SparkSession, d: str) -> DataFrame:
    return turns.talk_time(views.segments(spark, d))
