"""Sequential rules over blocks: every block learns the state it starts from, by combining block functions as a tree.

What a block does to the state of a sequential rule is a function from the state before it to the state after it.  Two
such functions in a row are one again, so neighbouring blocks combine in groups of eight, those groups in groups of
eight, and so on; on the way back each node hands its own start to its parts.  A task meets eight functions at a time,
however long the track is, and there are as many rounds as the longest track's block count has digits to base eight.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators.ordered import BLOCK, div
from cuelake.plans.cut import durable

FAN_IN = 8
KEYS = ["track_id", BLOCK]


def block_entries(functions: DataFrame, compose, apply, start: int) -> DataFrame | None:
    """``entry`` of each block of ``functions`` (track_id, blk from 0, fn array<long>); None where there are no blocks.

    ``compose(f, g)`` is the function of f's block followed by g's, ``apply(f, state)`` the state after f's block,
    ``start`` the state before the first block of a track.
    """
    levels = [durable(functions)]
    high = levels[0].agg(F.max(BLOCK)).first()[0]
    if high is None:
        return None

    def combined(key, pdf):
        functions = [f.tolist() for f in pdf.sort_values(BLOCK)["fn"]]
        return pd.DataFrame({"track_id": [key[0]], BLOCK: [key[1]], "fn": [reduce(compose, functions)]})

    def handed(key, pdf):
        pdf, entries = pdf.sort_values(BLOCK), []
        state = int(pdf["entry"].iloc[0])
        for f in pdf["fn"]:
            entries.append(state)
            state = apply(f.tolist(), state)
        return pd.DataFrame({"track_id": pdf["track_id"], BLOCK: pdf[BLOCK], "entry": entries})

    node = div(F.col(BLOCK), FAN_IN)
    while high > 0:
        levels.append(durable(levels[-1].groupBy("track_id", node.alias("node")).applyInPandas(combined, f"track_id long, {BLOCK} long, fn array<long>")))
        high //= FAN_IN
    entries = levels[-1].select(*KEYS, F.lit(start).cast("long").alias("entry"))
    for level in reversed(levels[:-1]):
        above = entries.select("track_id", F.col(BLOCK).alias("node"), "entry")
        entries = (level.withColumn("node", node).join(above, ["track_id", "node"])
                   .groupBy("track_id", "node").applyInPandas(handed, f"track_id long, {BLOCK} long, entry long"))
    return entries
