"""From recognised events to cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import text_key
from cuelake.operators.ordered import BLOCK, lag, last_set, lead, scan
from cuelake.operators.sampling import unseen_change

HALF_SECOND_US = 500_000
TRACK = ["track_id"]


def transition_backdate(context: DataFrame) -> DataFrame:
    """Kept samples as events; a change the gate did not see moves back to the midpoint.

    The prior sample always exists where a prior kept one does, so the midpoint does too.
    """
    kept = context.where("kept")
    middle = (F.col("prior_sample_us") + F.col("ts_us")) / 2
    return (kept.withColumn("backdated", unseen_change())
            .withColumn("event_us", F.when(F.col("backdated"),
                                           F.greatest(F.col("prior_kept_us"), F.rint(middle).cast("long")))
                        .otherwise(F.col("ts_us")))
            .select("track_id", BLOCK, "n", "event_us", "text", "backdated", "last_us"))


def event_intervals(events: DataFrame, tail_us: int = HALF_SECOND_US, durations: DataFrame | None = None) -> DataFrame:
    """Each event with its end: the next event, or the end of the track for the last one.

    The end of a track is its ``duration_us`` in ``durations``; without that, ``tail_us`` (one sample step) after its
    last sample at ``last_us``.
    """
    linked = scan(events.withColumn("key", text_key(F.col("text"))), TRACK, ["n"],
                  next_us=lead(F.col("event_us")),
                  before=lag(F.struct("text", "key")))
    close = F.col("last_us") + tail_us
    if durations is not None:
        # Only a track's last event looks its duration up; the others carry a number of their own, so that a long
        # track spreads over the join.
        ends = durations.select("track_id", F.lit(0).cast("long").alias("_last"), "duration_us")
        last = F.when(F.col("next_us").isNull(), F.lit(0).cast("long")).otherwise(F.col("n"))
        linked = linked.withColumn("_last", last).join(ends, ["track_id", "_last"], "left").drop("_last")
        close = F.coalesce("duration_us", close)
    end = F.coalesce(F.col("next_us"), close)
    made = linked.withColumn("end_us", F.when(end <= F.col("event_us"),
                                              F.col("event_us") + HALF_SECOND_US).otherwise(end))
    return made.drop("duration_us")


def cue_build(intervals: DataFrame) -> DataFrame:
    """Merge neighbouring events with one key; an empty event in between keeps them apart."""
    shown = intervals.where(F.col("text") != "")
    starts = ~F.coalesce((F.col("before.text") != "") & (F.col("before.key") == F.col("key")),
                         F.lit(False))
    grouped = scan(shown, TRACK, ["n"], cue_n=last_set(F.when(starts, F.col("n"))))
    return grouped.groupBy("track_id", "cue_n").agg(
        F.min_by("event_us", "n").alias("start_us"), F.max_by("end_us", "n").alias("end_us"),
        F.min_by("text", "n").alias("text"))
