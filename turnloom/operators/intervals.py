"""Intervals (start_us, dur_us), half-open: merging, overlaps and concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Overlapping pairs that are made at once, besides those of one segment.
PAIRS = 1 << 18


def merge(segments: DataFrame, gap_us: int = 200_000, keys: tuple[str, ...] = ("rec", "speaker", "channel")) -> DataFrame:
    """Intervals of the same keys at most ``gap_us`` apart as one: keys, start_us, end_us, parts."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = segments.withColumn("end_us", F.col("start_us") + F.col("dur_us")).withColumn("reach", reach)
    opens = (F.col("reach").isNull() | (F.col("start_us") - F.col("reach") > gap_us)).cast("int")
    island = F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.withColumn("island", island).groupBy(*keys, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("parts")).drop("island")


def overlaps(segments: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """Pairs of segments of a recording that overlap: rec, a, b, overlap_us.

    A segment is in every time bucket that it touches, and a pair counts in the bucket where it
    begins, so each pair is found once.  In a bucket's order of starts, those that begin before a
    segment ends are the next ones, so nothing but pairs is made, some at a time.  Segments move once.
    """
    bucket_us = bucket_us or 300_000_000
    bucket = lambda t: F.expr(f"({t} - pmod({t}, {bucket_us}L)) div {bucket_us}L")
    s = segments.where("dur_us > 0 AND id IS NOT NULL AND rec IS NOT NULL AND start_us IS NOT NULL").selectExpr("rec", "id", "start_us", "start_us + dur_us AS end_us")
    spread = s.withColumn("bucket", F.explode(F.sequence(bucket("start_us"), bucket("(end_us - 1)"))))
    parts = max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole buckets."""
        rec, number, ids, start, end = rows.column("rec").combine_chunks(), *(rows.column(c).to_numpy() for c in ("bucket", "id", "start_us", "end_us"))
        new = _changes(rows)
        group = np.cumsum(new)
        low = number * bucket_us
        # starts on one axis, bucket after bucket; those that begin before theirs are its first
        base = group * (bucket_us + 1)
        at, until = base + np.maximum(start - low, 0), base + np.minimum(end - low, bucket_us)
        own = np.searchsorted(group, np.arange(1, group[-1] + 1)) + np.bincount(group - 1, weights=start < low).astype(np.int64)
        lo = np.maximum(np.arange(len(at)) + 1, own[group - 1])
        count = np.maximum(np.searchsorted(at, until) - lo, 0)
        total = np.concatenate(([0], np.cumsum(count)))
        first = 0
        while first < len(count):
            last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, side="right")) - 1)
            n = count[first:last]
            x = np.repeat(np.arange(first, last), n)
            y = np.arange(len(x)) - np.repeat(total[first:last] - total[first] - lo[first:last], n)
            differ = ids[x] != ids[y]
            x, y, first = x[differ], y[differ], last
            if len(x):
                yield pa.RecordBatch.from_arrays([rec.take(pa.array(x)), pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(np.minimum(end[x], end[y]) - start[y])], names=["rec", "a", "b", "overlap_us"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            # the last bucket may go on in the next batch
            news = np.flatnonzero(_changes(pa.Table.from_batches([held[0].slice(held[0].num_rows - 1), b] if len(held) > 1 else [b]))[1:])
            if len(news):
                here = int(news[-1]) + (len(held) == 1)
                yield from pairs(pa.Table.from_batches([*held[:-1], b.slice(0, here)]))
                held = [b.slice(here)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    rows = spread.select("rec", "bucket", "id", "start_us", "end_us").repartition(parts, "rec", "bucket").sortWithinPartitions("rec", "bucket", "start_us")
    return rows.mapInArrow(run, f"rec {segments.schema['rec'].dataType.simpleString()}, a bigint, b bigint, overlap_us bigint")


def _changes(rows: pa.Table) -> np.ndarray:
    """Whether each row has another recording or bucket than the one before; the first has."""
    new = np.ones(rows.num_rows, bool)
    for c in ("rec", "bucket"):
        x = rows.column(c).combine_chunks()
        changed = pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = changed if c == "rec" else new[1:] | changed
    return new


def concurrency(segments: DataFrame) -> DataFrame:
    """rec, start_us, end_us, active: how many speakers speak at once, from a sweep over starts and ends."""
    m = merge(segments.where("dur_us > 0"), 0, ("rec", "speaker"))
    step = m.select("rec", F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("s"))
    at = step.groupBy("rec", F.col("s.t").alias("start_us")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy("rec").orderBy("start_us")
    active = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at.select("rec", "start_us", F.lead("start_us").over(w).alias("end_us"), active.alias("active")).where("end_us is not null")


def overlap_statistics(segments: DataFrame) -> DataFrame:
    """A recording's speech, time with two or more speakers, and their share."""
    c = concurrency(segments).withColumn("d", F.col("end_us") - F.col("start_us"))
    g = c.groupBy("rec").agg(F.sum(F.when(F.col("active") > 0, F.col("d")).otherwise(0)).alias("speech_us"), F.sum(F.when(F.col("active") > 1, F.col("d")).otherwise(0)).alias("overlap_us"), F.max("active").alias("max_active"))
    return g.withColumn("overlap_share", F.round(F.col("overlap_us") / F.col("speech_us"), 6))


def place(existing: DataFrame, proposals: DataFrame, limit: int | None) -> DataFrame:
    """proposal, rec, offset_us: the earliest allowed start of each proposal (proposal, rec, speaker, offset_us, dur_us).

    The proposal itself, or the least end of an existing segment after it, at which no more than
    ``limit`` speakers speak at once while it lasts; without an offset, behind the last segment.  Proposals
    are told apart by ``proposal`` and don't see each other; without that column there is one a recording.

    The times at which the limit is reached by others than a proposal's speaker come from one sweep a
    recording and speaker; a proposal is compared with the free times between them, not with segments.
    """
    if "proposal" not in proposals.columns:
        return place(existing, proposals.withColumn("proposal", F.col("rec")), limit).drop("proposal")
    if limit is None or limit <= 0:
        return proposals.select("proposal", "rec", "offset_us")
    e = existing.where("dur_us > 0")
    # who is kept out of the count is a proposal's speaker; those that are the same person share a timeline
    asked = proposals.where("dur_us > 0").select("rec", F.col("speaker").alias("own")).distinct()
    others = merge(e, 0, ("rec", "speaker")).join(asked, "rec").where("speaker <> own").select("rec", "own", "start_us", "end_us")
    step = others.select("rec", "own", F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))).alias("s"))
    level = step.groupBy("rec", "own", F.col("s.t").alias("t")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy("rec", "own").orderBy("t")
    full = level.withColumn("full", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) >= limit)
    # full times and free ones alternate; what is free before the first and after the last has no end
    turns = full.withColumn("was", F.lag("full", 1, False).over(w)).where("full <> was")
    ends = turns.withColumn("until", F.lead("t").over(w)).where("not full").select("rec", F.col("own").alias("speaker"), F.col("t").alias("since"), "until")
    head = turns.where("full").groupBy("rec", "own").agg(F.min("t").alias("until")).select("rec", F.col("own").alias("speaker"), F.lit(None).cast("bigint").alias("since"), "until")
    # a free time begins with the end of a segment, so it or the proposal is the earliest candidate within
    at = F.greatest("offset_us", "since")
    fits = proposals.join(ends.union(head), ["rec", "speaker"]).where(F.col("offset_us").isNotNull() & (F.col("dur_us") > 0) & (F.col("until").isNull() | (at + F.col("dur_us") <= F.col("until"))))
    allowed = fits.groupBy("proposal", "rec").agg(F.min(at).alias("free_at"))
    last = existing.join(proposals.where("offset_us is null").select("rec").distinct(), "rec", "left_semi").groupBy("rec").agg(F.max_by(F.col("start_us") + F.col("dur_us"), F.struct("start_us", "id")).alias("last_end"))
    out = proposals.join(allowed, ["proposal", "rec"], "left").join(last, "rec", "left")
    # nothing full, or nothing to place: the proposal itself
    return out.select("proposal", "rec", F.coalesce("free_at", "offset_us", F.greatest("offset_us", F.coalesce("last_end", F.lit(0)))).alias("offset_us"))
