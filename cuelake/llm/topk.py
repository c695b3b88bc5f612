"""Exact top-k search by MaxScore over shards of signed-dimension postings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.plans.cut import durable

#: Vectors of a shard and queries of a block, about; a task keeps one shard and reads query blocks as they come.
SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
#: Partitions of (shard, block) groups, at most; beyond that a task has several groups, one after another.
MOST_TASKS = 50_000
#: Vectors at the head of the strongest postings that are scored whole, for a first threshold.
SEEDS = 64
RESULT = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale=256) -> DataFrame:
    """(vec_id, v): components turned into floor(scale * x), x as double.

    Rows whose id or vector is null, or that hold a null or non-finite component, take no part.  Rows that repeat an
    id are one vector, the least.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


class Shard:
    """Postings of one shard: for each dimension and sign, the rows by falling size of the component."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids = np.array(ids, np.int64)[order]
        self.width = max(map(len, vectors), default=0)
        self.rows = np.zeros((len(ids), self.width), np.int64)
        for at, k in enumerate(order):
            self.rows[at, :len(vectors[k])] = vectors[k]
        self.postings = {}
        for d in range(self.width):
            column = self.rows[:, d]
            for sign in (1, -1):
                own = np.flatnonzero(column * sign > 0)
                own = own[np.argsort(-column[own] * sign, kind="stable")]
                self.postings[d, sign] = own, column[own] * sign

    def best(self, query: list[int], k: int, leave_out: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows without `leave_out`; ties go to smaller ids.

        The terms of a query are its non-zero components; a term's postings are the rows of the same sign, which it
        can only raise, by at most its bound.  Rows of the other sign only lose by it, so the sum of bounds is a bound
        of the score.  Terms whose bounds together stay under the k-th best score so far are non-essential: a row in
        no essential posting cannot get in.  Essential postings are traversed strongest first; rows whose gains and
        remaining bounds stay under the threshold drop out, and rows that are left are probed in full.
        """
        q = np.zeros(self.width, np.int64)
        q[:min(len(query), self.width)] = query[:self.width]
        beyond = np.searchsorted(self.ids, leave_out)
        own = beyond if beyond < len(self.ids) and self.ids[beyond] == leave_out else -1
        terms = []
        for d in np.flatnonzero(q):
            rows, sizes = self.postings[d, 1 if q[d] > 0 else -1]
            if len(rows):
                terms.append((int(abs(q[d]) * sizes[0]), rows, sizes * abs(q[d])))
        terms.sort(key=lambda t: -t[0])

        bounds = np.array([t[0] for t in terms] + [0], np.int64)
        after = np.append(np.cumsum(bounds[::-1])[::-1], 0)[1:]
        total = int(bounds.sum())
        kth = None
        seeds = np.unique(np.concatenate([t[1][:SEEDS // 4] for t in terms[:8]])) if terms else np.zeros(0, np.int64)
        seeds = seeds[seeds != own]
        if len(seeds) >= k:
            kth = int(np.partition(self.rows[seeds] @ q, len(seeds) - k)[len(seeds) - k])

        if kth is None or kth <= 0 or total < kth:
            # No row in a posting need be among the best: rows outside all postings score 0 or less.
            left = np.arange(len(self.ids))
        else:
            essential = int(np.searchsorted(-after, -(kth - 1), "left")) + 1
            gains = np.zeros(len(self.ids), np.int64)
            met = np.zeros(len(self.ids), bool)
            for at, (_, rows, sizes) in enumerate(terms[:essential]):
                gains[rows] += sizes
                met[rows] = True
            left = np.flatnonzero(met & (gains + after[essential - 1] >= kth))
            for at, (_, rows, sizes) in enumerate(terms[essential:], essential):
                if len(left) < 64:
                    break
                gains[rows] += sizes
                left = left[gains[left] + after[at] >= kth]
        left = left[left != own]
        scores = self.rows[left] @ q
        if len(left) > 4 * k:
            least = np.partition(scores, len(left) - k)[len(left) - k]
            left, scores = left[scores >= least], scores[scores >= least]
        order = np.lexsort((self.ids[left], -scores))[:k]
        return [(int(scores[i]), int(self.ids[left[i]])) for i in order]


def top_k(vectors: DataFrame, queries: DataFrame, k=5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of `vectors` for each row of `queries` (vec_id, v).

    Both are as `quantised` makes them; a query's own id is no candidate.  Every block of queries meets every shard
    once: the shard's rows go to each group of blocks, the queries to each shard, and a shard's k best of each query
    are merged by rank.  Shorter vectors count as filled up with zeros.
    """
    groups = lambda rows, size: max(1, -(-rows.count() // size))
    sizes, blocks = groups(vectors, SHARD_ROWS), groups(queries, BLOCK_QUERIES)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(sizes)).cast("int").alias("shard"), spread(blocks).alias("block"),
                          F.lit(0).alias("role"), "vec_id", "v")
    asked = queries.select(spread(sizes).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                           F.lit(1).alias("role"), "vec_id", "v")
    rows = held.union(asked).repartition(min(sizes * blocks, MOST_TASKS), "shard", "block").sortWithinPartitions("shard", "block", "role")

    def run(batches):
        own, ids, kept, shard = None, [], [], None
        for batch in batches:
            found = []
            for s, b, role, vec_id, v in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "role", "vec_id", "v"))):
                if (s, b) != own:
                    own, ids, kept, shard = (s, b), [], [], None
                if role == 0:
                    ids.append(vec_id)
                    kept.append(v)
                    continue
                if shard is None:
                    shard = Shard(ids, kept)
                    kept = []
                found += [(vec_id, other, score) for score, other in shard.best(v, k, vec_id)]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = rows.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k=5, every=50) -> DataFrame:
    """The k best rows for each row whose id is divisible by `every`."""
    rows = durable(quantised(vectors))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)


SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
