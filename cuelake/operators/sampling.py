"""Sampling, time repair and the recognition gate."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from cuelake import fixed
from cuelake.functions.text import text_key
from cuelake.functions.thumbnails import changed
from cuelake.operators.folds import block_entries
from cuelake.operators.ordered import BLOCK, lag, last_before, long_tracks, scan, total_max

TRACK = ["track_id"]


def stride_sample(frames: DataFrame) -> DataFrame:
    """Every k-th frame, k from the frame rate with half-even rounding."""
    stride = F.greatest(F.lit(1), F.rint(F.col("fps") / fixed.SAMPLES_PER_SECOND).cast("long"))
    return frames.where(F.pmod(F.col("idx"), stride) == 0)


def usable_pts(pts_ms):
    return (pts_ms >= 0) & (pts_ms <= fixed.MAX_MEDIA_TIME_S * 1000)


def decoded_high_water(frames: DataFrame) -> DataFrame:
    """Largest plausible presentation time of every decoded frame, sampled or not."""
    return frames.groupBy("track_id").agg(
        F.max(F.when(usable_pts(F.col("pts_ms")), F.col("pts_ms"))).alias("decoded_ms"))


# Folds.  Both folds below run on one bounded block at a time.  For tracks of several
# blocks a first pass reduces each block to one row: its exit state as a function of
# its entry state.  Those functions combine as a tree and give each block its entry.

# Time repair: entries below ``below`` end at ``exit_at``, later ones at
# max(floor, entry + shift).  Times are whole picoseconds, so that sums do not depend on
# where blocks begin; a step is off by half a picosecond at most.

PICOSECONDS = 10 ** 12
BEFORE_ALL = -(1 << 62)
BEFORE_FIRST = -PICOSECONDS


def _clock(idx, pts, fps):
    """(presentation time or None where it is unusable, time by frame number, one frame's time)."""
    usable = 0 <= pts <= fixed.MAX_MEDIA_TIME_S * 1000
    return int(round(pts * 10 ** 9)) if usable else None, int(round(idx * PICOSECONDS / fps)), int(round(PICOSECONDS / fps))


def _repair_summary(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("idx")
    below = exit_at = floor = BEFORE_ALL
    shift = 0
    for row in zip(pdf["idx"], pdf["pts_ms"], pdf["fps"]):
        time, nominal, step = _clock(*row)
        if time is not None and time > exit_at:
            if time > floor:
                below = max(below, time - shift)
            exit_at = time
        else:
            exit_at = max(nominal, exit_at + step)
        floor, shift = max(floor + step, nominal), shift + step
    first = pdf.iloc[0]
    return pd.DataFrame({"track_id": [first["track_id"]], BLOCK: [first[BLOCK]], "fn": [[below, exit_at, floor, shift]]})


def _repair_exit(f, last):
    below, exit_at, floor, shift = f
    return exit_at if last < below else max(floor, last + shift)


def _repair_both(f, g):
    """One function of the same shape: an exit for low entries never lies above the one for high entries."""
    below, exit_at, floor, shift = f
    below_g, exit_g, floor_g, shift_g = g
    if exit_at < below_g:
        # What leaves f below g's bound ends at g's exit, low entries and the high ones that stay under it.
        below, exit_at = max(below, below_g - shift) if floor < below_g else below, exit_g
    else:
        exit_at = max(floor_g, exit_at + shift_g)
    return [below, exit_at, max(floor_g, floor + shift_g), shift + shift_g]


def repair_times(rows, last=BEFORE_FIRST):
    """Times in microseconds and replaced flags of ordered (idx, pts_ms, fps) rows, and the last time in picoseconds."""
    times, replaced = [], []
    for row in rows:
        time, nominal, step = _clock(*row)
        keep = time is not None and last < time
        last = time if keep else max(nominal, last + step)
        times.append((last + 500_000) // 1_000_000)
        replaced.append(not keep)
    return times, replaced, last


def _walk_blocks(batches, walk, start, columns, out):
    """Run ``walk(rows, state)`` along sorted batches; the state restarts at each new block.

    A batch may hold many small blocks and a block may span batches; nothing is collected.
    """
    block = state = None
    for pdf in batches:
        keys = list(zip(pdf["track_id"], pdf[BLOCK]))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        rows = list(zip(*(pdf[c].tolist() for c in columns)))
        entries, results = pdf["entry"].tolist(), [[] for _ in out]
        for first, past in zip(cuts, cuts[1:]):
            if first < past:
                if keys[first] != block:
                    block, state = keys[first], start(entries[first])
                *found, state = walk(rows[first:past], state)
                for result, values in zip(results, found):
                    result.extend(values)
        yield pdf.drop(columns="entry").assign(**dict(zip(out, results)))


def _sorted_blocks(rows: DataFrame, entries: DataFrame | None, start: int, order: list[str]) -> DataFrame:
    keys = ["track_id", BLOCK]
    begin, rows = F.lit(start).cast("long"), rows.repartition(*keys)
    known = (rows.withColumn("entry", begin) if entries is None
             else rows.join(entries, keys, "left").withColumn("entry", F.coalesce("entry", begin)))
    return known.sortWithinPartitions(*keys, *order)


def pts_repair(samples: DataFrame) -> DataFrame:
    """Strictly rising sample times; an unusable presentation time is replaced, never dropped."""
    keys = ["track_id", BLOCK]
    rows = samples.select(*keys, "idx", F.col("pts_ms").cast("double").alias("pts_ms"), "fps")
    functions = long_tracks(rows).groupBy(*keys).applyInPandas(_repair_summary, f"track_id long, {BLOCK} long, fn array<long>")
    entries = block_entries(functions, _repair_both, _repair_exit, BEFORE_FIRST)

    def run(batches):
        return _walk_blocks(batches, repair_times, int, ["idx", "pts_ms", "fps"], ["ts_us", "repaired"])
    return _sorted_blocks(rows, entries, BEFORE_FIRST, ["idx"]).mapInPandas(
        run, f"track_id long, {BLOCK} long, idx long, pts_ms double, fps double, ts_us long, repaired boolean")


def track_duration(frames: DataFrame, repaired: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Longest of the counted, decoded and sampled end of each track, in microseconds.

    ``reported`` (track_id, fps, reported_frames) names tracks and the frame counts that their files state, which stand
    in where no frame was counted.
    """
    seen = frames.groupBy("track_id").agg(
        (F.max("idx") + 1).alias("frames"), F.max("fps").alias("fps"),
        F.max(F.when(usable_pts(F.col("pts_ms")), F.col("pts_ms"))).alias("decoded_ms"))
    if reported is not None:
        said = reported.select("track_id", F.col("fps").alias("_fps"), "reported_frames")
        seen = (said.join(seen, "track_id", "full_outer").withColumn("fps", F.coalesce("fps", "_fps"))
                .withColumn("frames", F.when(F.col("frames") > 0, F.col("frames")).otherwise(F.coalesce("reported_frames", F.lit(0)))))
    sampled = repaired.groupBy("track_id").agg(F.max("ts_us").alias("last_us"))
    step = 1_000_000 / F.col("fps")
    end = F.greatest(F.col("frames") * step, F.col("decoded_ms") * 1000 + step,
                     F.col("last_us") + step)
    return (seen.join(sampled, "track_id", "left")
            .select("track_id", F.rint(end).cast("long").alias("duration_us")))


# Gate: a block's exit (time of its last kept row) depends only on which of its rows is
# the first kept one.  ``upper``/``exits`` list those choices, equal exits merged;
# ``sure`` says that the last choice is kept whatever came before.  As a function they
# stand in one list: sure, the bounds, the exits.  Before the first kept row stands NEVER.

NEVER = -(1 << 62)


def gate_walk(rows, last, interval):
    """Kept flags of ordered (time, changed) rows after a last kept time (None before the first)."""
    kept = []
    for time, change in rows:
        keep = last is None or change or time - last >= interval
        if keep:
            last = time
        kept.append(keep)
    return kept, last


def _gate_summary(interval):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_us", "n"])
        times, changed = pdf["ts_us"].tolist(), pdf["changed"].tolist()
        size = len(times)
        ends, far, next_change = [0] * size, size, size
        for i in range(size - 1, -1, -1):
            while far > i + 1 and times[far - 1] - times[i] >= interval:
                far -= 1
            following = min(far, next_change)
            ends[i] = ends[following] if following < size else times[i]
            if changed[i]:
                next_change = i
        upper, exits, sure = [], [], False
        for time, change, end in zip(times, changed, ends):
            sure = change or time - times[0] >= interval
            if exits and exits[-1] == end:
                upper[-1] = time
            else:
                upper.append(time)
                exits.append(end)
            if sure:
                break
        head = pdf.iloc[0]
        return pd.DataFrame({"track_id": [head["track_id"]], BLOCK: [head[BLOCK]], "fn": [[int(sure), *upper, *exits]]})
    return run


def _gate_exit(interval):
    def run(f, last):
        choices = len(f) // 2
        at = bisect_left(f, last + interval, 1, choices + 1)
        return f[at + choices] if at <= choices else f[-1] if f[0] else last
    return run


def _gate_both(interval):
    """Choices of two blocks in a row: those of the first, and behind it, unless it is sure, those of the second."""
    exit_of = _gate_exit(interval)

    def run(f, g):
        n, m = len(f) // 2, len(g) // 2
        upper, exits = f[1:n + 1], [exit_of(g, x) for x in f[n + 1:]]
        if not f[0]:
            upper, exits = upper + g[1:m + 1], exits + g[m + 1:]
        last = [i for i, x in enumerate(exits) if i + 1 == len(exits) or exits[i + 1] != x]
        return [int(f[0] or g[0]), *(upper[i] for i in last), *(exits[i] for i in last)]
    return run


def ocr_interval_gate(samples: DataFrame, interval_us: int) -> DataFrame:
    """Flag the samples to recognise: the first, changed ones, and one per interval."""
    keys = ["track_id", BLOCK]
    rows = samples.select(*keys, "n", "ts_us", "text", "changed")
    order = rows.select(*keys, "n", "ts_us", "changed")
    functions = long_tracks(order).groupBy(*keys).applyInPandas(_gate_summary(interval_us), f"track_id long, {BLOCK} long, fn array<long>")
    entries = block_entries(functions, _gate_both(interval_us), _gate_exit(interval_us), NEVER)

    def run(batches):
        return _walk_blocks(batches, lambda rows, last: gate_walk(rows, last, interval_us),
                            lambda entry: None if entry == NEVER else int(entry), ["ts_us", "changed"], ["kept"])
    return _sorted_blocks(rows, entries, NEVER, ["ts_us", "n"]).mapInPandas(
        run, f"track_id long, {BLOCK} long, n long, ts_us long, text string, changed boolean, kept boolean")


def gate_context(gated: DataFrame) -> DataFrame:
    """What the rules after the gate need of earlier rows of the track."""
    kept = F.when(F.col("kept"), F.struct("ts_us", "text"))
    return (scan(gated, TRACK, ["n"], prior_sample_us=lag(F.col("ts_us")),
                 prior_kept=last_before(kept), last_us=total_max(F.col("ts_us")))
            .withColumn("prior_kept_us", F.col("prior_kept.ts_us"))
            .withColumn("prior_text", F.col("prior_kept.text")).drop("prior_kept"))


def unseen_change():
    """A kept sample whose text is new although the gate saw no change of the picture."""
    return (F.col("prior_kept_us").isNotNull() & ~F.col("changed")
            & (text_key(F.col("text")) != text_key(F.col("prior_text"))))


def gate_metrics(context: DataFrame, interval_us: int) -> DataFrame:
    """Counters of the gate per track."""
    first = F.col("prior_sample_us").isNull()
    forced = F.col("prior_kept_us").isNull() | (F.col("ts_us") - F.col("prior_kept_us") >= interval_us)
    return context.withColumn("forced", forced).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~first).alias("checks"),
        F.count_if("changed").alias("triggers"),
        F.count_if("forced").alias("forced_checks"),
        F.count_if(F.col("forced") & ~F.col("changed") & F.col("prior_kept_us").isNotNull())
        .alias("forced_only"),
        F.count_if(~F.col("kept")).alias("skipped"),
        F.count_if("kept").alias("recognised"),
        F.count_if(F.col("kept") & unseen_change()).alias("backdates"))


def signal_shift_gate(vectors: DataFrame, threshold: float, share: float, shift: float,
                      scale: float = 1.0) -> DataFrame:
    """Hard-cut rule on any numeric vector: many elements moved, and in one direction."""
    rows = scan(vectors, ["crop_id"], ["step"], previous=lag(F.col("scores")))
    delta = F.zip_with("scores", "previous", lambda a, b: (a - b) * scale)
    moved = F.size(F.filter("delta", lambda d: F.abs(d) > threshold))
    mean = F.aggregate("delta", F.lit(0.0), lambda s, d: s + d) / F.size("delta")
    return (rows.withColumn("delta", delta)
            .select("crop_id", "step", moved.cast("long").alias("moved"),
                    F.round(mean, 6).alias("mean_shift"),
                    F.coalesce((moved > F.size("delta") * share) & (F.abs(mean) > shift), F.lit(False))
                    .alias("cut"))
            .withColumn("moved", F.when(F.col("mean_shift").isNotNull(), F.col("moved"))))


def thumbnail_downsample(images: DataFrame) -> DataFrame:
    """Every k-th row and column, so that the view fits the gate's thumbnail; channel mean."""
    step = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("height") / fixed.THUMB_HEIGHT,
                                                  F.col("width") / fixed.THUMB_WIDTH))).cast("int")
    rows = F.expr("ceil(height / step)").cast("int")
    columns = F.expr("ceil(width / step)").cast("int")
    pixel = F.expr("""transform(sequence(0, rows * columns - 1), i ->
        cast(aggregate(slice(pixels, ((i div columns) * step * width + (i % columns) * step)
                             * channels + 1, channels), 0L, (s, v) -> s + v) div channels as int))""")
    return (images.withColumn("step", step).withColumn("rows", rows).withColumn("columns", columns)
            .withColumn("gray", pixel)
            .drop("step", "pixels", "height", "width", "channels")
            .withColumnsRenamed({"rows": "height", "columns": "width"}))


@F.pandas_udf(BooleanType())
def _changed_band(now: pd.Series, height: pd.Series, width: pd.Series, before: pd.Series,
                  height_before: pd.Series, width_before: pd.Series) -> pd.Series:
    """Pictures of one size are compared as one stack; a first picture is no change, another size is one."""
    first = before.isna()
    out = ~first & ((height != height_before) | (width != width_before))
    same = ~first & ~out
    for (h, w), own in pd.DataFrame({"h": height[same], "w": width[same]}).groupby(["h", "w"]):
        # Some hundred pictures at once, so that a batch of large ones stays small.
        for at in range(0, len(own), 256):
            part = own.index[at:at + 256]
            stack = [np.stack([np.asarray(x, dtype=np.int32) for x in v[part]]).reshape(len(part), int(h), int(w))
                     for v in (before, now)]
            out[part] = changed(*stack)
    return out.astype(bool)


def frame_change_gate(frames: DataFrame) -> DataFrame:
    """Flag frames whose thumbnail shows a changed band of text against the frame before."""
    picture = F.struct("gray", "height", "width")
    return (scan(frames, TRACK, ["n"], before=lag(picture))
            .withColumn("changed", _changed_band("gray", "height", "width", "before.gray",
                                                 "before.height", "before.width"))
            .drop("before"))
