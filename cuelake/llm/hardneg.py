"""Hard negatives with exact integer scores by the Four-Russians method."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.shards import answers, by_shard, finite, matrix
from cuelake.plans.cut import durable

#: Vectors of a shard, about, and anchors that a task scores at once.
SHARD_ROWS = 4096
ANCHORS_AT_ONCE = 64
#: Dimensions of a group: one byte of a bit plane addresses all subsets of the group's components.
GROUP = 8


def labelled(vectors: DataFrame, scale=256) -> DataFrame:
    """(vec_id, label, v): labelled vectors, components turned into floor(scale * x), x as double.

    Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part.  Rows that
    repeat an id are one row, the least by (label, v).  Other columns are left behind.
    """
    v = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(finite())
            .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
            .agg(F.min(F.struct(F.col("label").cast("long").alias("label"), v.alias("v"))).alias("r"))
            .select("vec_id", "r.label", "r.v"))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Sums of every subset of each group of eight components: [group, subset, anchor].

    A group's table doubles with each of its dimensions: the subsets with that dimension are those without it,
    plus its component.
    """
    groups = anchors.shape[1] // GROUP
    tables = np.zeros((groups, 1 << GROUP, len(anchors)), anchors.dtype)
    for g in range(groups):
        for j in range(GROUP):
            tables[g, 1 << j:2 << j] = tables[g, :1 << j] + anchors[:, g * GROUP + j]
    return tables


class Planes:
    """Candidates of a shard as packed bit planes: a byte per plane and group of eight dimensions.

    Components are whole numbers in two's complement of `bits` bits, so plane b counts 2^b and the highest one
    -2^(bits - 1).  Rows are ordered by (label, id), so the rows of a label lie together.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, vectors = ids[order], labels[order], vectors[order]
        self.width = -(-vectors.shape[1] // GROUP) * GROUP
        vectors = np.pad(vectors, ((0, 0), (0, self.width - vectors.shape[1])))
        low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
        self.bits = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
        self.planes = [np.ascontiguousarray(np.packbits((vectors >> b & 1).astype(np.uint8), axis=1, bitorder="little").T)
                       for b in range(self.bits)]

    def scores(self, anchors: np.ndarray, start: int, end: int) -> np.ndarray:
        """[row, anchor] inner products of rows start to end: looked-up sums of each plane, shifted and added."""
        anchors = np.pad(anchors, ((0, 0), (0, max(0, self.width - anchors.shape[1]))))[:, :self.width]
        # Sums inside stay under |anchor| * 2^bits; without room for that in 32 bits, 64 are used.
        reach = int(np.abs(anchors).sum(axis=1).max(initial=0)) << self.bits
        tables = subset_sums(anchors.astype(np.int32 if reach < 2 ** 31 else np.int64))
        total = np.zeros((end - start, len(anchors)), tables.dtype)
        plane, looked_up = np.empty_like(total), np.empty_like(total)
        for b in reversed(range(self.bits)):
            plane[:] = 0
            for g, table in enumerate(tables):
                np.take(table, self.planes[b][g, start:end], axis=0, out=looked_up, mode="clip")
                plane += looked_up
            total <<= 1
            if b == self.bits - 1:
                total -= plane
            else:
                total += plane
        return total.astype(np.int64)

    def of_label(self, label: int) -> tuple[int, int]:
        """First row of a label and the row after its last."""
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def shard_of(rows: pa.Table) -> Planes:
    return Planes(np.asarray(rows["vec_id"], np.int64), np.asarray(rows["label"], np.int64), matrix(rows["v"].chunk(0), np.int64))


def label_runs(batch: pa.RecordBatch):
    """(label, first, after last) of the runs of equal labels in a batch."""
    labels = np.asarray(batch.column("label"), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)]
    return [(int(labels[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


def best_of_label(shard: Planes, batch: pa.RecordBatch, k: int):
    """(anchor_id, vec_id, score) of the k best other rows of an anchor's label in the shard."""
    anchors, out = matrix(batch.column("v"), np.int64), []
    names = np.asarray(batch.column("vec_id"), np.int64)
    for label, a, b in label_runs(batch):
        start, end = shard.of_label(label)
        if start == end:
            continue
        scores, ids = shard.scores(anchors[a:b], start, end), shard.ids[start:end]
        for at in range(a, b):
            own = scores[:, at - a]
            near = np.flatnonzero(own >= np.partition(own, max(len(own) - k - 1, 0))[max(len(own) - k - 1, 0)])
            near = near[ids[near] != names[at]]
            near = near[np.lexsort((ids[near], -own[near]))[:k]]
            out += [(names[at], ids[i], own[i]) for i in near]
    return list(zip(*out)) or [[], [], []]


def best_below(shard: Planes, batch: pa.RecordBatch, k: int, low: int, high: int):
    """(anchor_id, positive_id, negative_id, positive_score, negative_score) of the k best allowed rows of other labels.

    Allowed is a score s with low * p <= 100 * s <= high * p, p the positive's score.
    """
    anchors, out = matrix(batch.column("v"), np.int64), []
    names, wanted = np.asarray(batch.column("vec_id"), np.int64), batch.column("positives").to_pylist()
    for label, a, b in label_runs(batch):
        start, end = shard.of_label(label)
        ranges = [(x, y) for x, y in ((0, start), (end, len(shard.ids))) if x < y]
        if not ranges:
            continue
        scores = np.concatenate([shard.scores(anchors[a:b], x, y) for x, y in ranges])
        ids = np.concatenate([shard.ids[x:y] for x, y in ranges])
        for at in range(a, b):
            own = scores[:, at - a] * 100
            known = {}
            for positive in wanted[at]:
                p = positive["score"]
                if p not in known:
                    near = np.flatnonzero((own >= low * p) & (own <= high * p))
                    if len(near) > k:
                        near = near[own[near] >= np.partition(own[near], len(near) - k)[len(near) - k]]
                    known[p] = near[np.lexsort((ids[near], -own[near]))[:k]]
                out += [(names[at], positive["vec_id"], ids[i], p, scores[i, at - a]) for i in known[p]]
    return list(zip(*out)) or [[], [], [], [], []]


def mine(rows: DataFrame, anchors: DataFrame, positives=5, negatives=5, low=80, high=100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for `rows` as `labelled` makes them.

    `anchors` are some of the rows; both are read three times, so give a stored table.  A row's score is its inner product with the anchor; higher scores come first, ties
    by smaller id.  The positives of an anchor are its first other rows of the same label; for each of them the first
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned.
    Anchors without positives, and positives without such rows, give none.

    Every row is scored against every anchor once: rows of the anchor's label in the first pass, the rest in the
    second.  Both deal rows into shards of mixed labels, so a common label spreads like any other, and a shard's best
    of each anchor are merged by rank.  Shorter vectors count as filled up with zeros.  Scores must fit 64 bits with
    room for the factor 100, else the call is refused.
    """
    reach = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")) * F.abs(x.cast("double"))))).first()[0]
    if (reach or 0.0) * 100 * max(low, high) / 100 >= 2.0 ** 62:
        raise ValueError("scores of these vectors do not fit 64 bits; use a smaller scale")
    rank = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "other"))
    names, whole = ["anchor_id", "other", "score"], pa.int64()

    dealt = by_shard(rows, anchors.select("vec_id", "label", "v"), SHARD_ROWS, ["label", "vec_id"])
    first = dealt.mapInArrow(lambda batches: answers(batches, shard_of, lambda s, b: best_of_label(s, b, positives), names,
                                                     [whole] * 3, ANCHORS_AT_ONCE), "anchor_id bigint, other bigint, score bigint")
    found = (first.withColumn("rank", rank("anchor_id")).where(F.col("rank") <= positives)
             .groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("other").alias("vec_id"), "score")).alias("positives")))

    asked = durable(anchors.select("vec_id", "label", "v").join(found, "vec_id"))
    dealt = by_shard(rows, asked, SHARD_ROWS, ["label", "vec_id"])
    names = ["anchor_id", "positive_id", "other", "positive_score", "score"]
    second = dealt.mapInArrow(lambda batches: answers(batches, shard_of, lambda s, b: best_below(s, b, negatives, low, high), names,
                                                      [whole] * 5, ANCHORS_AT_ONCE),
                              "anchor_id bigint, positive_id bigint, other bigint, positive_score bigint, score bigint")
    return (second.withColumn("rank", rank("anchor_id", "positive_id")).where(F.col("rank") <= negatives)
            .selectExpr("anchor_id", "positive_id", "rank", "other AS negative_id", "positive_score", "score AS negative_score"))


SQL = """
WITH f AS (SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END,
    'v': list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))}) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.r.label = c.r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.r.v, c.r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM f a JOIN f c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
