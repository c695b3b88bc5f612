"""Normalising cue tracks and scoring their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import fixed
from cuelake.functions.text import at_most_two, exact_forms, is_stable, squeeze, strip_body
from cuelake.operators.ordered import BLOCK, lag, long_tracks, number_rows, scan, total

TRACK = ["track_id"]
ORDER = ["pos"]


def order_checks(cues: DataFrame) -> DataFrame:
    """Per cue: broken time order, overlap with the cue before, number unlike its position."""
    return (scan(cues, TRACK, ORDER, before=lag(F.struct("start_ms", "end_ms")))
            .withColumn("broken", (F.col("end_ms") <= F.col("start_ms"))
                        | F.coalesce(F.col("start_ms") < F.col("before.start_ms"), F.lit(False)))
            .withColumn("overlaps", F.coalesce(F.col("start_ms") < F.col("before.end_ms"), F.lit(False)))
            .withColumn("renumbered", F.col("cue_no") != F.col("pos"))
            .drop("before"))


def track_validate(cues: DataFrame) -> DataFrame:
    return order_checks(cues).groupBy("track_id").agg((~F.bool_or("broken")).alias("valid"))


def overlap_count(cues: DataFrame) -> DataFrame:
    return order_checks(cues).groupBy("track_id").agg(F.count_if("overlaps").alias("overlaps"))


def drop_empty(cues: DataFrame) -> DataFrame:
    return cues.withColumn("text", strip_body(F.col("text"))).where(F.col("text") != "")


def body_normalise(cues: DataFrame) -> DataFrame:
    """Body in NFC and the form duplicates are compared in.

    Only texts outside the stable characters reach Python; for the others it gets nulls.
    """
    trimmed = cues.withColumn("body", strip_body(F.col("text"))).withColumn("stable", is_stable(F.col("body")))
    return (trimmed.withColumn("exact", exact_forms(F.when(~F.col("stable"), F.col("body"))))
            .withColumn("norm", F.when(F.col("stable"), F.lower(squeeze(F.col("body")))).otherwise(F.col("exact.norm")))
            .withColumn("body", F.when(F.col("stable"), F.col("body")).otherwise(F.col("exact.body")))
            .drop("exact", "stable"))


def renumber(cues: DataFrame) -> DataFrame:
    return number_rows(cues, TRACK, ORDER, "new_no")


def duplicate_merge(cues: DataFrame, gap_ms: int = fixed.MERGE_GAP_MS) -> DataFrame:
    """Merge neighbouring cues with one normalised body that follow within ``gap_ms``.

    Merging is associative over consecutive pieces: first every block merges inside
    itself, then the cues of the run that opens a block are tested against the
    latest end of that run in earlier blocks, then what still continues an
    earlier cue is added to it.  Needs ``pos, start_ms, end_ms, body, norm``.
    """
    keys = ["track_id", BLOCK]
    block = Window.partitionBy(*keys).orderBy("pos")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(*keys, "run").orderBy("pos")
    in_run_before = run.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("track_id").orderBy(BLOCK)
    blocks_upto = blocks.rowsBetween(Window.unboundedPreceding, 0)
    blocks_before = blocks.rowsBetween(Window.unboundedPreceding, -1)

    new_run = F.when(F.lag("norm").over(block) == F.col("norm"), 0).otherwise(1)
    far = F.coalesce(F.col("start_ms") > F.col("reach") + gap_ms, F.lit(True))

    def merge_inside(rows):
        return (rows.withColumn("new_run", new_run)
                .withColumn("run", F.sum("new_run").over(upto))
                .withColumn("reach", F.max("end_ms").over(in_run_before))
                .withColumn("piece", F.max(F.when(far, F.col("pos"))).over(upto))
                .groupBy(*keys, "run", "piece")
                .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
                     F.min_by("body", "pos").alias("body"), F.first("norm").alias("norm"),
                     F.count(F.lit(1)).alias("parts")))

    merged = merge_inside(cues)
    long = long_tracks(cues)

    # one row per block: its first and last body and the reach of its last run
    edge = (merge_inside(long).groupBy(*keys)
            .agg(F.min_by("norm", "run").alias("first_norm"), F.max_by("norm", "run").alias("last_norm"),
                 F.max("run").alias("runs"),
                 F.max(F.struct("run", "end_ms"))["end_ms"].alias("last_reach")))
    linked = F.coalesce(F.lag("last_norm").over(blocks) == F.col("first_norm"), F.lit(False))
    edge = (edge.withColumn("linked", linked)
            # a stretch is a chain of blocks through which one run goes on
            .withColumn("stretch", F.sum(F.when(F.col("linked") & (F.col("runs") == 1), 0).otherwise(1))
                        .over(blocks_upto))
            .withColumn("_reach", F.max(F.struct("stretch", "last_reach")).over(blocks_before)["last_reach"])
            .where("linked")
            .select(*keys, F.col("_reach").alias("carried_reach")))

    opening = Window.partitionBy(*keys, "run").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    piece_order = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.greatest("carried_reach", F.max("end_ms").over(opening))
    alone = ((F.col("run") > 1) | F.col("carried_reach").isNull() | (F.col("start_ms") > reach + gap_ms))

    def settle(pieces):
        return (pieces.join(edge, keys, "left").withColumn("own", F.when(alone, F.col("piece")))
                .withColumn("cue_pos", F.max("own").over(piece_order)))

    # rows before the first own cue of a block belong to the last cue of an earlier block
    tail = (settle(merge_inside(long)).groupBy(*keys).agg(F.max("cue_pos").alias("_last"))
            .select(*keys, F.max("_last").over(blocks_before).alias("_carried")))
    settled = settle(merged)
    return (settled.join(tail, keys, "left")
            .withColumn("cue_pos", F.coalesce("cue_pos", "_carried"))
            .groupBy("track_id", "cue_pos")
            .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
                 F.min_by("body", "piece").alias("body"), F.sum("parts").alias("parts")))


def _lines(body):
    return F.split(body, r"\r\n|[\n-\r\x1C-\x1E\x85\u2028\u2029]")


def quality_stats(cues: DataFrame) -> DataFrame:
    """Counters of merged cues per track."""
    lines = _lines(F.col("body"))
    return cues.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("cue_count"),
        F.sum(F.col("parts") - 1).alias("duplicates_merged"),
        F.count_if(at_most_two(F.col("body"), 0)).alias("suspect_cues"),
        F.count_if(F.exists(lines, lambda x: at_most_two(x, 1))).alias("short_line_cues"),
        F.max(F.size(lines)).cast("long").alias("max_lines"),
        F.max(F.array_max(F.transform(lines, F.length))).cast("long").alias("max_line_chars"))


def quality_label(stats: DataFrame) -> DataFrame:
    return stats.withColumn("quality", F.when(F.greatest("suspect_cues", "short_line_cues") > 0,
                                              "REVIEW_REQUIRED")
                            .when(F.col("cue_count") > 0, "READY_FOR_REVIEW").otherwise(""))


def summary_quality(summary: DataFrame) -> DataFrame:
    """Verdict of the user interface: ``good``, ``review`` or ``error``."""
    failed = (F.col("pipeline") != "COMPLETE") | (F.coalesce("error", F.lit("")) != "")
    return summary.withColumn("verdict", F.when(F.coalesce(failed, F.lit(True)), "error")
                              .when(F.coalesce(F.col("suspect_cues"), F.lit(0)) > 0, "review")
                              .otherwise("good"))


def fault_checks(cues: DataFrame) -> DataFrame:
    """`order_checks` with the fault of each cue: INVALID_FORMAT, INVALID_TIMECODE, INVALID_ORDER or null.

    A parser's ``status`` column counts if there is one; without it, missing times are bad timecodes.
    """
    said = F.coalesce("status", F.lit("OK")) if "status" in cues.columns else F.lit("OK")
    timeless = (said == "INVALID_TIMECODE") | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    return order_checks(cues).withColumn(
        "fault", F.when(said == "INVALID_FORMAT", said).when(timeless, "INVALID_TIMECODE").when(F.col("broken"), "INVALID_ORDER"))


def normalize_cues(cues: DataFrame) -> DataFrame:
    """Merged cues of the valid tracks."""
    checked = fault_checks(cues)
    sound = scan(checked, TRACK, ORDER, faults=total(F.col("fault").isNotNull().cast("int"))).where("faults = 0")
    return duplicate_merge(body_normalise(drop_empty(sound)))


def normalize_track(cues: DataFrame) -> DataFrame:
    """The whole pass: one row per track with its status and counters.

    The status is that of the first faulty cue, else NO_TEXT or OK; cues may come straight from ``srt_parse_strict``.
    """
    counters = fault_checks(cues).groupBy("track_id").agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("pos"))).alias("fault"), F.count_if("overlaps").alias("overlapping_cues"),
        F.count_if("renumbered").alias("renumbered_cues"),
        F.count_if(strip_body(F.col("text")) == "").alias("empty_dropped"))
    merged = duplicate_merge(body_normalise(drop_empty(cues)))
    stats = quality_stats(merged)
    kept = ["cue_count", "duplicates_merged", "suspect_cues", "short_line_cues", "max_lines",
            "max_line_chars"]
    status = (F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("cue_count").isNull(), "NO_TEXT")
              .otherwise("OK"))
    return (counters.join(stats, "track_id", "left").withColumn("status", status)
            .select("track_id", "status",
                    *[F.when(F.col("status") == "OK", F.col(c)).alias(c)
                      for c in ("overlapping_cues", "renumbered_cues", "empty_dropped", *kept)]))
