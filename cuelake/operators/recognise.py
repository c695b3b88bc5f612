"""Work around a text recogniser: boxes, score decoding, reading order, batching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuelake import fixed
from cuelake.functions.text import WIDE_BLANK_CHARS, alnum_count, strip_body
from cuelake.operators.ordered import BLOCK, div, lag, numbered, running_sum, scan, total, total_max

PART_ROWS = 4096


def join_in_order(rows: DataFrame, keys: list[str], rank: str, text: str, separator: str,
                  name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Ordered texts of a key joined into parts of at most ``part_rows`` rows.

    A key normally has one part.  Parts keep one huge key from being collected whole;
    writing them one after another gives the full text.
    """
    return (rows.withColumn("part_no", div(F.col(rank) - 1, part_rows))
            .groupBy(*keys, "part_no")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))),
                                          lambda r: r[text]), separator).alias(name)))


def box_expand_filter(boxes: DataFrame, mask: tuple[int, int], frame: tuple[int, int]) -> DataFrame:
    """Polygon (``xs``, ``ys`` in mask pixels, mean ``score``) to an integer box in the frame."""
    def mean(name):
        return F.aggregate(name, F.lit(0.0), lambda s, v: s + v) / F.size(name)

    def grown(name):
        return F.transform(name, lambda v: (v - F.col(f"{name}_mid")) * fixed.BOX_GROWTH
                           + F.col(f"{name}_mid"))

    def scaled(name, source, target):
        return F.transform(name, lambda v: F.least(F.lit(target - 1.0),
                                                   F.greatest(F.lit(0.0), v * target / source)))

    area = F.abs(F.expr("""aggregate(sequence(0, size(xs) - 1), 0.0D, (s, i) ->
        s + xs[i] * ys[(i + 1) % size(xs)] - xs[(i + 1) % size(xs)] * ys[i])""")) / 2
    return (boxes.where(area >= fixed.BOX_MIN_AREA)
            .withColumn("xs_mid", mean("xs")).withColumn("ys_mid", mean("ys"))
            .withColumn("xs", scaled(grown("xs"), mask[0], frame[0]))
            .withColumn("ys", scaled(grown("ys"), mask[1], frame[1]))
            .withColumn("x1", F.floor(F.array_min("xs"))).withColumn("x2", F.floor(F.array_max("xs")) + 1)
            .withColumn("y1", F.floor(F.array_min("ys"))).withColumn("y2", F.floor(F.array_max("ys")) + 1)
            .where((F.col("x2") - F.col("x1") >= fixed.BOX_MIN_SIDE)
                   & (F.col("y2") - F.col("y1") >= fixed.BOX_MIN_SIDE)
                   & (F.col("score") >= fixed.BOX_MIN_SCORE))
            .drop("xs", "ys", "xs_mid", "ys_mid"))


def score_normalise(steps: DataFrame) -> DataFrame:
    """Softmax all steps of a crop when any of them is not a probability row."""
    sums = F.aggregate("scores", F.lit(0.0), lambda s, v: s + v)
    odd = (F.exists("scores", lambda v: (v < 0) | (v > 1))
           | ~sums.between(fixed.SCORE_SUM_LOW, fixed.SCORE_SUM_HIGH))
    flagged = scan(steps, ["crop_id"], ["step"], odd=total_max(odd.cast("int")))
    # A list of one binds a value once; inside the inner function it would be worked out for every class again.
    powers = F.transform(F.array(F.array_max("scores")), lambda top: F.transform("scores", lambda v: F.exp(v - top)))[0]
    total_of = F.aggregate("powers", F.lit(0.0), lambda s, v: s + v)
    soft = F.transform(F.array(total_of), lambda whole: F.transform("powers", lambda v: v / whole))[0]
    return (flagged.withColumn("powers", powers)
            .withColumn("scores", F.when(F.col("odd") == 1, soft).otherwise(F.col("scores")))
            .drop("powers", "odd"))


def step_argmax(steps: DataFrame) -> DataFrame:
    """Best class per step, the lowest index on ties, with its score."""
    return (steps.withColumn("score", F.array_max("scores"))
            .withColumn("class", F.array_position("scores", F.col("score")) - 1))


def collapse_steps(steps: DataFrame, blank) -> DataFrame:
    """Steps that start a symbol: not blank and unlike the step before."""
    linked = scan(steps, ["crop_id"], ["step"], before=lag(F.col("class")))
    return linked.where((F.col("class") != F.lit(blank))
                        & ~F.coalesce(F.col("class") == F.col("before"), F.lit(False))).drop("before")


def ctc_collapse(steps: DataFrame, blank, symbol: str = "class") -> DataFrame:
    """Text and mean score per crop; texts of very long crops come in parts."""
    kept = scan(collapse_steps(steps, blank), ["crop_id"], ["step"], rank=running_sum(F.lit(1)),
                symbols=total(F.lit(1)), score_sum=total(F.col("score")))
    confidence = kept.groupBy("crop_id", div(F.col("rank") - 1, PART_ROWS).alias("part_no")).agg(
        (F.first("score_sum") / F.first("symbols")).alias("confidence"),
        F.first("symbols").alias("symbols"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(symbol).alias("s")))),
                                 lambda r: r["s"]), "").alias("text"))
    # Blanks go at both ends of a text, which are those of its first and last part.
    text = F.when(F.col("part_no") == 0, F.ltrim("text", F.lit(WIDE_BLANK_CHARS))).otherwise(F.col("text"))
    text = F.when(F.col("part_no") == div(F.col("symbols") - 1, PART_ROWS), F.rtrim(text, F.lit(WIDE_BLANK_CHARS))).otherwise(text)
    confidence = confidence.withColumn("text", text)
    empty = (steps.groupBy("crop_id").agg(F.bool_and(F.col("class") == F.lit(blank)).alias("none"))
             .where("none").select("crop_id", F.lit(0).cast("long").alias("part_no"),
                                   F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("symbols"),
                                   F.lit("").alias("text")))
    return confidence.unionByName(empty)


def dictionary(spark, lines: list[str]) -> DataFrame:
    """Symbol table of a recogniser: blank, the listed symbols, space."""
    symbols = ["", *lines, " "]
    return spark.createDataFrame(list(enumerate(symbols)), "class long, symbol string")


#: Classes of a dictionary that every task may get a copy of; larger ones are joined with the steps spread over salts.
COPIED_CLASSES = 100_000
SALTS = 64


def dictionary_decode(steps: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps with their symbol, and the steps whose class the dictionary lacks.

    Few classes hold most steps, so steps are never shuffled by their class alone: a dictionary whose counted size
    allows it goes to every task, a larger one is repeated for each salt and joined on (class, salt).
    """
    if symbols.count() <= COPIED_CLASSES:
        joined = steps.join(F.broadcast(symbols), "class", "left")
    else:
        salted = symbols.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = steps.withColumn("_salt", F.pmod(F.xxhash64("crop_id", "step"), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, ["class", "_salt"], "left").drop("_salt")
    return joined.where(F.col("symbol").isNotNull()), joined.where(F.col("symbol").isNull())


def confidence_threshold(text):
    return (F.when(alnum_count(text) <= fixed.SHORT_TEXT_CHARS, fixed.SHORT_TEXT_CONFIDENCE)
            .otherwise(fixed.TEXT_CONFIDENCE))


def accepted(text, confidence):
    return (text != "") & (confidence >= confidence_threshold(text))


def confidence_filter(results: DataFrame) -> DataFrame:
    return results.where(accepted(F.col("text"), F.col("confidence")))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Text of each frame: lines by height band, then from the left, then as detected (``seq``)."""
    band = F.rint(F.col("y1") / F.greatest(F.lit(1.0), F.col("height") * fixed.LINE_BAND_SHARE)).cast("long")
    placed = (boxes.withColumn("text", strip_body(F.col("text"))).where(F.col("text") != "")
              .select("frame", band.alias("band"), "x1", "seq", "text"))
    return join_in_order(numbered(placed, ["frame"], ["band", "x1", "seq"], "rank"), ["frame"], "rank", "text", "\n", "text")


def target_width(width, height):
    raw = F.ceil(F.lit(fixed.CROP_HEIGHT) * width / height / fixed.WIDTH_STEP) * fixed.WIDTH_STEP
    return F.least(F.lit(fixed.MAX_WIDTH), F.greatest(F.lit(fixed.MIN_WIDTH), raw)).cast("long")


def _pack(batch_size):
    """Fill batches over the at most 253 distinct widths of one source."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target")
        heads, head_batches, next_batches = [], [], []
        batch, first, room = -1, 0, 0
        for target, count in zip(pdf["target"], pdf["rows"]):
            head = min(room, count) if target <= first * fixed.BATCH_WIDTH_RATIO else 0
            heads.append(head)
            head_batches.append(batch)
            next_batches.append(batch + 1)
            room -= head
            rest = count - head
            if rest:
                fresh = -(-rest // batch_size)
                batch, first, room = batch + fresh, target, fresh * batch_size - rest
        return pdf.assign(head=heads, head_batch=head_batches, next_batch=next_batches).drop(columns="rows")
    return run


def length_bucket_pack(crops: DataFrame, batch_size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Batches of similar width per source.

    The greedy rule only sees widths, and there are at most 253 of them, so it runs on
    the width counts of a source; each crop then finds its batch from its rank.
    """
    rows = crops.withColumn("target", target_width(F.col("width"), F.col("height")))
    group = ["source", "target"]
    counted = rows.groupBy(*group, BLOCK).agg(F.count(F.lit(1)).alias("n"))
    plan = (counted.groupBy(*group).agg(F.sum("n").alias("rows"))
            .groupBy("source").applyInPandas(_pack(batch_size), "source string, target long, head long, "
                                                                "head_batch long, next_batch long"))
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (counted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
              .join(plan, group))
    local = Window.partitionBy(*group, BLOCK).orderBy("seq")
    rank = F.col("local_rank") + F.col("offset")
    return (rows.withColumn("local_rank", F.row_number().over(local) - 1)
            .join(pieces, [*group, BLOCK])
            .withColumn("batch_id", F.when(rank < F.col("head"), F.col("head_batch"))
                        .otherwise(F.col("next_batch") + div(rank - F.col("head"), batch_size)))
            .select("source", "seq", "target", "batch_id"))


def batch_histogram(packed: DataFrame) -> DataFrame:
    sizes = packed.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("batch_size"))
    return sizes.groupBy("source", "batch_size").agg(F.count(F.lit(1)).alias("batches"))


def frame_batch_plan(frames: DataFrame) -> DataFrame:
    """Groups of four frames; crops are recognised together only when they are few enough.

    Needs ``track_id, frame, crops`` with one row per frame.
    """
    ranked = numbered(frames, ["track_id"], ["frame"], "rank")
    plan = (ranked.groupBy("track_id", div(F.col("rank") - 1, fixed.FRAMES_PER_BATCH).alias("group_no"))
            .agg(F.count(F.lit(1)).alias("frames"), F.sum("crops").alias("crops")))
    return plan.withColumn("combined", F.col("crops") <= fixed.CROPS_PER_BATCH)


def decision_parity(baseline: DataFrame, candidate: DataFrame, run: str, seq: str) -> DataFrame:
    """Do two result tables hold the same rows, texts and keep decisions?"""
    def side(df, mark):
        return df.select(run, seq, F.col("text").alias(f"{mark}_text"),
                         (F.col("confidence") >= confidence_threshold(F.col("text"))).alias(f"{mark}_keep"))
    both = side(baseline, "a").join(side(candidate, "b"), [run, seq], "full_outer")
    same = (F.coalesce(F.col("a_text") == F.col("b_text"), F.lit(False))
            & F.coalesce(F.col("a_keep") == F.col("b_keep"), F.lit(False)))
    return (both.withColumn("same", same).groupBy(run)
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("same")).alias("differing"))
            .withColumn("verdict", F.when(F.col("differing") == 0, "match").otherwise("output_mismatch")))


def infer(df: DataFrame, fn, schema: str) -> DataFrame:
    """Plug in any recogniser or model: ``fn`` maps pandas batches to pandas batches."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)


def infer_beside(df: DataFrame, fn, inputs: list[str], made: str) -> DataFrame:
    """``infer`` for a model that reads only ``inputs``: ``made`` is what it puts beside them, rows in the same order.

    The other columns of a row wait for its answer where they are, so nothing has to be joined again.
    """
    names = [f.name for f in StructType.fromDDL(made)]

    @F.pandas_udf(made)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows)[names]
    # Not deterministic: a model is asked once for a row, wherever its answer is used.
    return df.withColumn("_made", run.asNondeterministic()(F.struct(*inputs))).select("*", "_made.*").drop("_made")
