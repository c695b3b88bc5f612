"""Shards of vectors: each stays in one task, and what is asked of it streams past."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vector="embedding"):
    """True where a vector is not null and holds no null and no non-finite component."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def by_shard(held: DataFrame, asked: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """Rows of `held` (role 0) in shards of about `rows`, each followed by all rows of `asked` (role 1) in `order`.

    A row of `held` moves once, to the partition of its shard, whatever the number of questions; a question goes to
    every shard.  Both need a column vec_id; columns that one side lacks are null there.
    """
    shards = max(1, -(-held.count() // rows))
    kept = held.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("role", F.lit(0))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("role", F.lit(1))
    return (kept.unionByName(sent, allowMissingColumns=True).repartitionById(shards, "shard")
            .sortWithinPartitions("shard", "role", *order))


def matrix(column: pa.Array, dtype, width=0) -> np.ndarray:
    """List column as rows of a matrix, at least `width` wide; shorter lists are filled up with zeros."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    made = np.zeros((len(column), max(width, int(sizes.max(initial=0)))), dtype)
    made[np.arange(made.shape[1])[None] < sizes[:, None]] = np.asarray(column.flatten()).astype(dtype, copy=False)
    return made


def answers(batches, build, answer, names: list[str], types: list[pa.DataType], asked_at_once: int):
    """Batches of results: `build(batch)` makes a shard of its held rows, `answer(shard, batch)` columns for questions.

    The rows are as `by_shard` deals them, so a task holds one shard and one batch of questions at a time.
    """
    own, held, shard = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([np.asarray(batch.column("shard"), np.int64), np.asarray(batch.column("role"), np.int64)])
        cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            number, role = marks[:, start]
            if number != own:
                own, held, shard = number, [], None
            part = batch.slice(start, end - start)
            if role == 0:
                held.append(part)
                continue
            if not held:
                continue
            if shard is None:
                shard = build(pa.Table.from_batches(held).combine_chunks())
            for at in range(0, part.num_rows, asked_at_once):
                columns = answer(shard, part.slice(at, asked_at_once))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
