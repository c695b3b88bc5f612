"""Approximate nearest neighbours by a permutation index: vectors told by the order of their nearest pivots."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.shards import answers, by_shard, finite, matrix
from cuelake.plans.cut import durable

#: Vectors of a shard, about, and queries that a task answers at once.
SHARD_ROWS = 4096
QUERIES_AT_ONCE = 64
#: Pivots, taken from a sample of about `PIVOT_SAMPLE` rows by hash of their ids, and how many nearest ones tell a vector.
PIVOTS = 256
PIVOT_SAMPLE = 1024
NEAREST_PIVOTS = 64
#: Share of a shard's rows, the nearest by footrule, whose distances are worked out.
RERANKED = 0.2


def searchable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with components as doubles.

    Rows whose id or vector is null, whose vector is all zeros (or empty) or holds a null or non-finite component take
    no part.  Rows that repeat an id are one vector, the least.  Other columns are left behind.
    """
    v = F.transform("embedding", lambda c: c.cast("double"))
    return (vectors.where(F.col("vec_id").isNotNull()).where(finite()).where(F.exists("embedding", lambda c: c != 0))
            .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v")))


def choose_pivots(vectors: DataFrame) -> np.ndarray:
    """At most `PIVOTS` different vectors of a sample of about `PIVOT_SAMPLE` rows, which has that bound at every size.

    The hash decides which rows are sampled before anything moves, so no task sends more than its share of them.
    """
    hashed = vectors.select("v", F.xxhash64("vec_id").alias("hash"), "vec_id")
    part = max(1, vectors.count() // PIVOT_SAMPLE)
    rows = hashed.where(F.pmod("hash", F.lit(part)) == 0).orderBy("hash", "vec_id").limit(2 * PIVOT_SAMPLE).collect()
    chosen = list(dict.fromkeys(tuple(r["v"]) for r in rows))[:PIVOTS]
    made = np.zeros((len(chosen), max(map(len, chosen), default=0)))
    for at, v in enumerate(chosen):
        made[at, :len(v)] = v
    return made


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances, scaled first where squares would leave the range of doubles."""
    away = rows - point
    with np.errstate(over="ignore", invalid="ignore"):
        made = np.sqrt((away * away).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(made) | (made < 1e-140))
        if len(odd):
            half = np.where(np.isfinite(made[odd]), 1.0, 0.5)
            away = rows[odd] * half[:, None] - point * half[:, None]
            most = np.abs(away).max(axis=1, initial=0)
            part = away / np.where(most > 0, most, 1)[:, None]
            made[odd] = np.sqrt((part * part).sum(axis=1)) * most / half
    return made


def permutations(rows: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """[row, place] numbers of the k nearest pivots, nearest first, ties to smaller numbers.

    Only the order matters, so rows and pivots are scaled together and |pivot|^2 - 2 row.pivot stands for the distance.
    """
    width = max(rows.shape[1], pivots.shape[1])
    rows, pivots = widened(rows, width), widened(pivots, width)
    scale = max(np.abs(rows).max(initial=0), np.abs(pivots).max(initial=0)) or 1.0
    rows, pivots = rows / scale, pivots / scale
    away = (pivots * pivots).sum(axis=1)[None] - 2 * rows @ pivots.T
    return np.argsort(away, axis=1, kind="stable")[:, :k].astype(np.int32)


class InvertedFiles:
    """Index of a shard: for each pivot, the rows that have it among their nearest, with its place there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k=NEAREST_PIVOTS, reranked=RERANKED):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots = ids[order], vectors[order], pivots
        self.k, self.reranked = min(k, len(pivots)), reranked
        found = permutations(self.vectors, pivots, self.k)
        by_pivot = np.argsort(found, axis=None, kind="stable")
        self.rows, self.places = (by_pivot // self.k).astype(np.int32), (by_pivot % self.k).astype(np.int32)
        self.starts = np.searchsorted(found.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, permutation: np.ndarray) -> np.ndarray:
        """Spearman's footrule between the query's order of pivots and every row's.

        A pivot not among the k nearest counts as standing at place k.  Two orders without a common pivot are
        k * (k + 1) apart; each common one at places a and b takes 2 * (k - max(a, b)) off, so only the files of the
        query's own pivots are read.
        """
        apart = np.full(len(self.ids), self.k * (self.k + 1), np.int64)
        for place, pivot in enumerate(permutation):
            start, end = self.starts[pivot], self.starts[pivot + 1]
            apart[self.rows[start:end]] -= 2 * (self.k - np.maximum(self.places[start:end], place))
        return apart

    def nearest(self, name: int, point: np.ndarray, permutation: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest rows found, without `name`; ties go to smaller ids.

        The rows with the smallest footrule, ties by id, are measured: a share of the shard, and k at least.
        """
        apart = self.footrule(permutation)
        at = np.searchsorted(self.ids, name)
        own = at if at < len(self.ids) and self.ids[at] == name else None
        if own is not None:
            apart[own] = np.iinfo(np.int64).max
        others = len(self.ids) - (own is not None)
        take = min(others, max(k, int(np.ceil(self.reranked * len(self.ids)))))
        if not take:
            return []
        limit = np.partition(apart, take - 1)[take - 1]
        near = np.flatnonzero(apart < limit)
        near = np.concatenate([near, np.flatnonzero(apart == limit)[:take - len(near)]])
        width = max(self.vectors.shape[1], len(point))
        away = distances(widened(self.vectors[near], width), np.pad(point, (0, width - len(point))))
        best = np.lexsort((self.ids[near], away))[:k]
        return [(float(away[i]), int(self.ids[near[i]])) for i in best]


def search(vectors: DataFrame, queries: DataFrame, k=10, nearest_pivots=NEAREST_PIVOTS, reranked=RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest rows found for each row of `queries`.

    Both as `searchable` makes them; a query's own id is no candidate.  Every vector is indexed, in a shard that stays
    in one task; queries go to all shards, and what shards find is merged by distance.  Approximate is only which rows
    are measured: in each shard the share `reranked` with the smallest footrule.  Shorter vectors count as filled up
    with zeros.
    """
    pivots = choose_pivots(vectors)

    def build(rows: pa.Table) -> InvertedFiles:
        return InvertedFiles(np.asarray(rows["vec_id"], np.int64), matrix(rows["v"].chunk(0), np.float64), pivots, nearest_pivots, reranked)

    def answer(shard: InvertedFiles, batch: pa.RecordBatch):
        points = matrix(batch.column("v"), np.float64)
        orders = permutations(points, pivots, shard.k)
        found = [(name, other, away) for name, point, order in zip(batch.column("vec_id").to_pylist(), points, orders)
                 for away, other in shard.nearest(name, point, order, k)]
        return list(zip(*found)) or [[], [], []]

    dealt = by_shard(vectors, queries.select("vec_id", "v"), SHARD_ROWS, ["vec_id"])
    found = dealt.mapInArrow(lambda batches: answers(batches, build, answer, ["query_id", "vec_id", "score"],
                                                     [pa.int64(), pa.int64(), pa.float64()], QUERIES_AT_ONCE),
                             "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, k=10, every=100) -> DataFrame:
    """The k nearest rows found for each row whose id is divisible by `every`."""
    rows = durable(searchable(embeddings))
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)
