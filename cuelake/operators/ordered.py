"""Ordered work on tracks of any length.

A plain window over ``track_id`` puts a whole track in one task, so one track
that holds a third of the rows stops the job.  Every ordered operator here works
on *blocks* instead: ``blk`` numbers bounded, consecutive pieces of a track.
Windows run inside (track, blk).  What a block must know of its neighbours is
reduced to one row per block, scanned over the block rows of the track (thousands
of times fewer than the data) and joined back on (track, blk), which the windows
are already hashed on.  Blocks are numbered from 0; where the length of a track is
known, a track of one block has the number -1 and contributes nothing to that join.

Rows without a position get one by `numbered`, which deals them by ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.plans.cut import durable

BLOCK = "blk"
BLOCK_ROWS = 16384


def div(a, b) -> Column:
    """Whole-number division that stays in 64-bit integers."""
    return F.call_function("div", *(F.lit(x) if isinstance(x, int) else x for x in (a, b)))


def with_blocks(df: DataFrame, position: str, rows: int = BLOCK_ROWS, length: str | None = None) -> DataFrame:
    """Block number from a position that counts rows of the track from 1, and the track's length if it is known."""
    block = div(F.col(position) - 1, rows)
    return df.withColumn(BLOCK, block if length is None else F.when(F.col(length) <= rows, F.lit(-1).cast("long")).otherwise(block))


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column


def lag(value) -> Step:
    """Value of the previous row of the track."""
    return Step("lag", value)


def lead(value) -> Step:
    """Value of the next row of the track."""
    return Step("lead", value)


def running_sum(value) -> Step:
    """Sum over all rows up to and including this one."""
    return Step("sum", value)


def earlier_max(value) -> Step:
    """Maximum over all rows before this one."""
    return Step("max", value)


def last_set(value) -> Step:
    """Last non-null value at or before this row."""
    return Step("last", value)


def last_before(value) -> Step:
    """Last non-null value strictly before this row."""
    return Step("last_before", value)


def total(value) -> Step:
    """Sum over the whole track."""
    return Step("total", value)


def total_max(value) -> Step:
    """Maximum over the whole track."""
    return Step("total_max", value)


def long_tracks(df: DataFrame) -> DataFrame:
    """Rows of the tracks that may have more than one block: the only ones that need carrying."""
    return df.where(F.col(BLOCK) >= 0)


def scan(df: DataFrame, keys: list[str], order: list[str], **steps: Step) -> DataFrame:
    """Add one column per step, each computed in track order across blocks."""
    block_keys = [*keys, BLOCK]
    rank = F.struct(*order)
    local = Window.partitionBy(*block_keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*block_keys)
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks_before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    track = Window.partitionBy(*keys)

    summary, carried, here, joined = [], [], [], []
    for name, step in steps.items():
        s, c, h = f"_s_{name}", f"_c_{name}", f"_h_{name}"
        boxed = F.struct(step.value.alias("v"))
        if step.kind == "lag":
            summary.append(F.max_by(boxed, rank).alias(s))
            carried.append(F.lag(s).over(blocks).alias(c))
            here.append(F.lag(boxed).over(local).alias(h))
            joined.append(F.coalesce(F.col(h), F.col(c))["v"].alias(name))
        elif step.kind == "lead":
            summary.append(F.min_by(boxed, rank).alias(s))
            carried.append(F.lead(s).over(blocks).alias(c))
            here.append(F.lead(boxed).over(local).alias(h))
            joined.append(F.coalesce(F.col(h), F.col(c))["v"].alias(name))
        elif step.kind == "sum":
            summary.append(F.sum(step.value).alias(s))
            carried.append(F.sum(s).over(blocks_before).alias(c))
            here.append(F.sum(step.value).over(upto).alias(h))
            joined.append((F.coalesce(F.col(h), F.lit(0))
                           + F.coalesce(F.col(c), F.lit(0))).alias(name))
        elif step.kind == "max":
            summary.append(F.max(step.value).alias(s))
            carried.append(F.max(s).over(blocks_before).alias(c))
            here.append(F.max(step.value).over(before).alias(h))
            joined.append(F.greatest(F.col(h), F.col(c)).alias(name))
        elif step.kind in ("last", "last_before"):
            frame = upto if step.kind == "last" else before
            summary.append(F.max_by(step.value, F.when(step.value.isNotNull(), rank)).alias(s))
            carried.append(F.last(s, ignorenulls=True).over(blocks_before).alias(c))
            here.append(F.last(step.value, ignorenulls=True).over(frame).alias(h))
            joined.append(F.coalesce(F.col(h), F.col(c)).alias(name))
        elif step.kind == "total":
            summary.append(F.sum(step.value).alias(s))
            carried.append(F.sum(s).over(track).alias(c))
            here.append(F.sum(step.value).over(whole).alias(h))
            joined.append(F.coalesce(F.col(c), F.col(h), F.lit(0)).alias(name))
        elif step.kind == "total_max":
            summary.append(F.max(step.value).alias(s))
            carried.append(F.max(s).over(track).alias(c))
            here.append(F.max(step.value).over(whole).alias(h))
            joined.append(F.coalesce(F.col(c), F.col(h)).alias(name))
        else:
            raise ValueError(step.kind)

    carry = long_tracks(df).groupBy(*block_keys).agg(*summary).select(*block_keys, *carried)
    return (df.select("*", *here)
            .join(carry, block_keys, "left")
            .select(*df.columns, *joined))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Position of each row of blocked tracks, from 1."""
    return scan(df, keys, order, **{name: running_sum(F.lit(1))})


#: Bits of a row's place inside its partition in `monotonically_increasing_id`.
PLACE_BITS = 33
#: Counts per (partition, key) that every task may get a copy of; beyond that they are joined.
COPIED_COUNTS = 100_000


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, length: str | None = None) -> DataFrame:
    """Position of each row among the rows of its keys, from 1, by ``order``; nulls of a key are one group.

    Rows are dealt by ranges of (keys, order), so a key of any size spreads over as many tasks as it needs, however
    its rows lie in time.  A row's place inside its partition is stored with it; what is summed over partitions is
    one count per (partition, key).  ``order`` should tell rows apart: rows equal in it meet in one partition, in any
    order.  The sorted rows are cut by a durable copy, because a second run of the ranges could draw other bounds.
    ``length`` names a column for the number of rows of the keys.
    """
    placed = durable(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                     .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
                   .select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
                           (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_rows").over(group).alias("_length")))
    if runs.count() <= COPIED_COUNTS:
        runs = F.broadcast(runs)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    made = [(F.col("_at") + F.col("_shift") + 1).alias(name), *([] if length is None else [F.col("_length").alias(length)])]
    return placed.join(runs, same).select(*(c for c in df.columns if c not in (name, length)), *made)


def in_blocks(df: DataFrame, keys: list[str], order: list[str], name: str, length: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``numbered`` rows with their blocks."""
    return with_blocks(numbered(df, keys, order, name, length), name, rows, length)
