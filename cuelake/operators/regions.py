"""Picture regions: bounds as fractions, vertical ones counted from the bottom."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake import fixed

BOUNDS = ("top", "bottom", "left", "right")


def _plain(value):
    """Six decimals without trailing zeros or a trailing point."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")


def region_validate(regions: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when valid) and the canonical strings of the bounds."""
    bounds = [F.col(b) for b in BOUNDS]
    bad = F.lit(False)
    for b in bounds:
        bad = bad | b.isNull() | F.isnan(b) | ~b.between(0, 1)
    reason = (F.when(bad, "BOUNDS")
              .when(F.col("top") - F.col("bottom") < fixed.REGION_MIN_SPAN, "HEIGHT")
              .when(F.col("right") - F.col("left") < fixed.REGION_MIN_SPAN, "WIDTH"))
    return (regions.withColumn("reason", reason)
            .withColumns({f"{b}_text": F.when(F.col("reason").isNull(), _plain(F.col(b)))
                          for b in BOUNDS}))


def profiles(spark) -> DataFrame:
    return spark.createDataFrame(fixed.REGION_PROFILES,
                                 "profile string, p_top string, p_bottom string, p_left string, p_right string")


def region_resolve(requests: DataFrame, width: int, height: int) -> DataFrame:
    """Bounds from a named profile or the custom values, flipped to image rows, in pixels.

    The profile table has three fixed rows, so it is always safe to broadcast.
    """
    named = requests.join(F.broadcast(profiles(requests.sparkSession)), "profile", "left")
    custom = F.col("profile") == "custom"
    chosen = {b: F.when(custom, F.col(b)).otherwise(F.col(f"p_{b}").cast("double")) for b in BOUNDS}
    checked = region_validate(named.withColumns(chosen))
    unknown = F.col("p_top").isNull() & ~F.coalesce(custom, F.lit(False))
    reason = F.when(unknown, "PROFILE").otherwise(F.col("reason"))
    return (checked.withColumn("reason", reason)
            .withColumn("y1", F.floor(height * (1 - F.col("top"))))
            .withColumn("y2", F.floor(height * (1 - F.col("bottom"))))
            .withColumn("x1", F.floor(width * F.col("left")))
            .withColumn("x2", F.floor(width * F.col("right")))
            .drop("p_top", "p_bottom", "p_left", "p_right"))


def region_box_filter(boxes: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Boxes (``bx1, by1, bx2, by2``) cut to the resolved region of their source; empty ones go."""
    inside = boxes.join(regions.where("reason is null").select(key, "x1", "y1", "x2", "y2"), key)
    return (inside.withColumn("cx1", F.greatest("bx1", "x1")).withColumn("cx2", F.least("bx2", "x2"))
            .withColumn("cy1", F.greatest("by1", "y1")).withColumn("cy2", F.least("by2", "y2"))
            .where("cx2 > cx1 and cy2 > cy1").drop("x1", "x2", "y1", "y2"))


def region_frame_map(boxes: DataFrame, target_width: float, target_height: float) -> DataFrame:
    """Boxes (``x, y, w, h`` fractions of a ``video_width`` x ``video_height`` picture) placed in a
    letterboxed target; the whole target when a size is unusable."""
    usable = ((F.col("video_width") > 0) & (F.col("video_height") > 0)
              & F.lit(target_width > 0) & F.lit(target_height > 0))
    scale = F.least(target_width / F.col("video_width"), target_height / F.col("video_height"))
    fw = F.when(usable, F.col("video_width") * scale / target_width).otherwise(1.0)
    fh = F.when(usable, F.col("video_height") * scale / target_height).otherwise(1.0)
    return (boxes.withColumn("frame_w", fw).withColumn("frame_h", fh)
            .withColumn("frame_x", (1 - F.col("frame_w")) / 2)
            .withColumn("frame_y", (1 - F.col("frame_h")) / 2)
            .withColumn("out_x", F.col("frame_x") + F.col("x") * F.col("frame_w"))
            .withColumn("out_y", F.col("frame_y") + F.col("y") * F.col("frame_h"))
            .withColumn("out_w", F.col("w") * F.col("frame_w"))
            .withColumn("out_h", F.col("h") * F.col("frame_h")))
