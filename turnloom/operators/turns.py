"""Turn-taking: gaps between neighbouring segments, their types, and the fit of a transition model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLD, SWITCH, INTERRUPTION, BACKCHANNEL = range(4)
NAMES = ["hold", "switch", "interruption", "backchannel"]
#: Means used for types that never occur, and the class probabilities of a fresh model.
DEFAULT_BETAS = [0.57, 0.40, 0.44, 0.67]
BACKCHANNEL_US = 20_000_000


def gaps(segments: DataFrame) -> DataFrame:
    """Each segment but a recording's first, with the one before it and the gap between (negative: overlap)."""
    w = Window.partitionBy("rec").orderBy("start_us", "id")
    before = segments.withColumn("prev_speaker", F.lag("speaker").over(w)).withColumn("prev_end_us", F.lag(F.col("start_us") + F.col("dur_us")).over(w))
    return before.where("prev_end_us is not null").withColumn("gap_us", F.col("start_us") - F.col("prev_end_us"))


def turn_type(threshold_us: int = BACKCHANNEL_US) -> Column:
    return (
        F.when(F.col("speaker") == F.col("prev_speaker"), HOLD)
        .when(F.col("gap_us") >= 0, SWITCH)
        .when(F.col("dur_us") <= threshold_us, BACKCHANNEL)
        .otherwise(INTERRUPTION)
    )


def types(segments: DataFrame, threshold_us: int = BACKCHANNEL_US) -> DataFrame:
    """Type and metric of each transition: seconds of pause, or the share of the segment that overlaps."""
    seconds = F.col("gap_us") / 1e6
    share = F.when(F.col("dur_us") > 0, F.least(F.lit(1.0), -F.col("gap_us") / F.col("dur_us"))).otherwise(0.0)
    metric = F.when(F.col("type") == HOLD, F.greatest(F.lit(0.0), seconds)).when(F.col("type") == SWITCH, seconds).otherwise(share)
    return gaps(segments).withColumn("type", turn_type(threshold_us)).withColumn("metric", F.round(metric, 6))


def all_types(df: DataFrame) -> DataFrame:
    """One row a type: a side of fixed size."""
    return df.sparkSession.range(0, 4).select(F.col("id").cast("int").alias("type"))


def fit_probabilities(segments: DataFrame, threshold_us: int = BACKCHANNEL_US) -> DataFrame:
    counted = types(segments, threshold_us).groupBy("type").agg(F.count("*").alias("n"))
    every = all_types(segments).join(F.broadcast(counted), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return every.select("type", "n", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.25), 6).alias("p"))


def fit_betas(segments: DataFrame, threshold_us: int = BACKCHANNEL_US) -> DataFrame:
    """Mean metric of each type; the default where a type doesn't occur."""
    mean = types(segments, threshold_us).groupBy("type").agg(F.avg("metric").alias("beta"))
    default = F.element_at(F.array(*map(F.lit, DEFAULT_BETAS)), F.col("type") + 1)
    return all_types(segments).join(F.broadcast(mean), "type", "left").select("type", F.round(F.coalesce("beta", default), 6).alias("beta"))


def fit_transitions(segments: DataFrame, threshold_us: int = BACKCHANNEL_US) -> DataFrame:
    """P(next type | type before): rows without data fall back on the overall probabilities."""
    w = Window.partitionBy("rec").orderBy("start_us", "id")
    pair = types(segments, threshold_us).withColumn("prev_type", F.lag("type").over(w)).where("prev_type is not null")
    counted = pair.groupBy("prev_type", F.col("type").alias("next_type")).agg(F.count("*").alias("n"))
    grid = all_types(segments).toDF("prev_type").crossJoin(all_types(segments).toDF("next_type"))
    every = grid.join(F.broadcast(counted), ["prev_type", "next_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("prev_type"))
    prior = fit_probabilities(segments, threshold_us).select(F.col("type").alias("next_type"), F.col("p").alias("prior"))
    return every.join(F.broadcast(prior), "next_type").select("prev_type", "next_type", "n", F.round(F.when(row > 0, F.col("n") / row).otherwise(F.col("prior")), 6).alias("p"))


def boost_overlap(probabilities: DataFrame, factor: float, by: list[str] | None = None) -> DataFrame:
    """Interruptions and backchannels made ``factor`` times as likely, then normalised (within ``by``)."""
    if factor < 0:
        raise ValueError("the factor can't be negative")
    kind = "next_type" if "next_type" in probabilities.columns else "type"
    raised = F.when(F.col(kind) >= INTERRUPTION, F.col("p") * float(factor)).otherwise(F.col("p"))
    own = Window.partitionBy(*(by or [F.lit(0)]))
    raw = probabilities.withColumn("raw", raised)
    total = F.sum("raw").over(own)
    # nothing left of a row of overlaps: holds
    boosted = F.when(total > 0, F.col("raw") / total).otherwise((F.col(kind) == HOLD).cast("double"))
    return raw.withColumn("boosted", F.round(boosted, 6)).drop("raw")
