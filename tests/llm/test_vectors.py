"""Hard negatives, permutation index and Merkle manifest."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm import hardneg, merkle, permindex
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
#: Clashing extra columns stand beside the three the operators read.
VECTORS = "vec_id long, embedding array<double>, label int, v string, shard int, role string, rank int, score double, positives int"
ODD = [(None, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [NAN, 1.0], 1), (400, [INF, 1.0], 1), (500, [1.0, 1.0], None),
       (600, [0.0, 0.0], 1), (700, [], 2), (800, [0.5], 1), (900, [0.5, 0.25, 0.125], 2), (1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1),
       (3, [0.5, 0.25], 2), (3, [0.5, 0.25], 2), (4, [-0.5, 0.25], 3), (0, [0.75, -0.25], 1), (0, [0.75, -0.25], 1), (5, [0.5, 0.25], 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 9, "y", 3, 0.5, 1) for r in ODD], VECTORS)


@pytest.mark.parametrize("name", ["op11_hardneg", "op13_merkle"])
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, folder):
    from __spark_entry__ import oracle_sql, queries
    assert difference(spark, connect(folder), queries()[name], oracle_sql()[name], folder) is None


# Hard negatives

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 19), st.integers(1, 12), st.sampled_from([1, 7, 300, 2 ** 20, 2 ** 27]), st.integers(0, 9))
def test_looked_up_scores_are_inner_products(width, rows, size, seed):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-size, size + 1, (rows, width))
    anchors = draw.integers(-size, size + 1, (3, draw.integers(1, 24)))
    shard = hardneg.Planes(np.arange(rows), np.zeros(rows, np.int64), vectors)
    common = min(width, anchors.shape[1])
    assert (shard.scores(anchors, 0, rows) == vectors[:, :common] @ anchors[:, :common].T).all()


def test_subset_sums():
    tables = hardneg.subset_sums(np.arange(1, 17, dtype=np.int64)[None])
    for subset in range(256):
        for g in range(2):
            assert tables[g, subset, 0] == sum(g * 8 + j + 1 for j in range(8) if subset >> j & 1)


def mined_by_hand(rows, anchors):
    """The rule, row by row, over {vec_id: (label, v)}."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for anchor in anchors:
        label, own = rows[anchor]
        scored = sorted((-dot(own, v), i, other) for i, (other, v) in rows.items() if i != anchor)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(n, i) for n, i, other in scored if other != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out |= {(anchor, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(fit)}
    return out


def test_mining_by_hand(spark, monkeypatch):
    """Few values, so ties are many; shards of 16 rows, a label with most rows, anchors of every label."""
    monkeypatch.setattr(hardneg, "SHARD_ROWS", 16)
    draw = np.random.default_rng(3)
    data = [(i, [int(x) / 256 for x in draw.integers(-3, 6, 5)], int(min(3, draw.integers(0, 9)))) for i in range(160)]
    rows = hardneg.labelled(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    found = hardneg.mine(rows, rows.where("vec_id % 8 = 0"))
    want = mined_by_hand({i: (label, [round(x * 256) for x in v]) for i, v, label in data}, range(0, 160, 8))
    assert {tuple(r) for r in found.collect()} == want and want


def test_mining_of_odd_rows(spark, odd):
    rows = hardneg.labelled(odd)
    kept = {r.vec_id: (r.label, r.v) for r in rows.collect()}
    assert set(kept) == {0, 1, 2, 3, 4, 5, 600, 700, 800, 900} and kept[4][1] == [-128, 64]
    got = {tuple(r) for r in hardneg.mine(rows, rows.where("vec_id % 100 = 0")).collect()}
    assert got == mined_by_hand(kept, [i for i in kept if i % 100 == 0])
    assert hardneg.mine(rows.limit(0), rows.limit(0)).collect() == []
    with pytest.raises(ValueError):
        hardneg.mine(rows.withColumn("v", F.array(F.lit(2 ** 40))), rows)


# Permutation index

def exact(points, queries, k=10):
    """Nearest rows by brute force: {query: [(distance, id)]}."""
    ids, width = sorted(points), max(map(len, points.values()))
    X = np.array([list(points[i]) + [0.0] * (width - len(points[i])) for i in ids])
    out = {}
    for q in queries:
        away = np.sqrt(((X - X[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = [(away[j], ids[j]) for j in sorted(range(len(ids)), key=lambda j: (away[j], ids[j])) if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_against_brute_force(spark, folder):
    from __spark_entry__ import queries
    points = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    want = exact(points, [i for i in points if i % 100 == 0])
    got = {}
    for r in queries()["op12_permutation"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        distance = dict((i, float(np.sqrt(((np.array(points[i]) - np.array(points[q])) ** 2).sum()))) for _, i in found)
        assert all(abs(s - distance[i]) <= 1e-12 for s, i in found) and found == sorted(found) and len(found) == 10
        hits += len({i for _, i in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_every_row_measured_is_exact(spark, odd, monkeypatch):
    """With all rows reranked the search is exact; ties, repeats, other lengths and zero vectors among them."""
    monkeypatch.setattr(permindex, "SHARD_ROWS", 4)
    rows = permindex.searchable(odd)
    points = {r.vec_id: r.v for r in rows.collect()}
    assert set(points) == {0, 1, 2, 3, 4, 5, 500, 800, 900}
    got = {}
    for r in permindex.search(rows, rows, k=3, reranked=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == exact(points, points, 3)
    assert permindex.search(rows.limit(0), rows.limit(0)).collect() == []
    assert permindex.search(rows, rows.limit(0)).collect() == []


def test_footrule_from_files():
    draw = np.random.default_rng(5)
    rows, pivots = draw.normal(size=(50, 6)), draw.normal(size=(12, 6))
    index = permindex.InvertedFiles(np.arange(50), rows, pivots, k=5)
    orders = permindex.permutations(rows, pivots, 5)
    place = lambda order, p: list(order).index(p) if p in order else 5
    for a in range(0, 50, 7):
        want = [sum(abs(place(orders[a], p) - place(orders[b], p)) for p in range(12)) for b in range(50)]
        assert index.footrule(orders[a]).tolist() == want


def test_many_equal_vectors_give_the_smallest_ids(spark):
    data = [(i, [1.0, 2.0] if i % 3 else [float(i), -1.0], 0) for i in range(300)]
    rows = permindex.searchable(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    got = [r.vec_id for r in permindex.search(rows, rows.where("vec_id = 100"), k=4).orderBy("rank").collect()]
    assert got == [1, 2, 4, 5]


@pytest.mark.parametrize("big", [1e200, 1e308, 5e-324])
def test_distances_at_the_ends_of_doubles(big):
    got = permindex.distances(np.array([[big, 0.0], [0.0, 0.0]]), np.array([0.0, 0.0]))
    assert got[1] == 0 and abs(got[0] / big - 1) < 1e-9


# Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_by_hand(leaves, fanout):
    """Top and, for each leaf, the steps (before, after)."""
    paths, groups, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        parents, joined = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for slot, node in enumerate(run):
                for leaf in groups[at + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            parents.append(H(*run))
            joined.append([leaf for g in groups[at:at + fanout] for leaf in g])
        level, groups = parents, joined
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest_by_hand(spark, fanout):
    """Groups of 0 letters to 70 leaves, a null group, null and repeated keys."""
    sizes = {None: 5, "": 1, "Z": 2, "a": 70, "é": 9, "z": 8}
    rows = [(None if i == 3 else i // 2, g, f"t{i % 7}") for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("tree", F.lit(1)).withColumn("n", F.lit("x"))
    found = merkle.manifest(df, merkle.digest(merkle.field("doc_id"), merkle.field("text")), "lang", ["doc_id"], {"doc_id": F.col("doc_id"), "lang": F.col("lang")}, fanout)
    got = sorted((str(r.lang), str(r.doc_id), r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in found.collect())
    groups = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted(((d is not None, d or 0, H(written(d), written(t))), d) for d, lang, t in rows if lang == g)
        trees[g] = own, *tree_by_hand([k[2] for k, _ in own], fanout)
    root, upper = tree_by_hand([trees[g][1] for g in groups], fanout)
    want = []
    for g, above in zip(groups, upper):
        own, subroot, paths = trees[g]
        want += [(str(g), str(d), k[2], subroot, root, tuple(path + above)) for (k, d), path in zip(own, paths)]
    assert got == sorted(want)
    folds = found.select((merkle.folded("leaf", "path") == F.col("root")).alias("same")).distinct().collect()
    assert [r.same for r in folds] == [True]


def test_audit_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, path string, leaf int, digest string, row string"
    rows = [(None, "No Id", None, None, None), (1, None, "en", "a", 3), (2, "", "en", "a", 0), (3, "MiXed É", "en", "a", 7), (3, "MiXed É", "en", "a", 7),
            (4, "lower only", "fr", "b", 1), (7, "Long " * 200_000, "fr", "b", 1)]
    docs = spark.createDataFrame([(*r, "p", 1, "d", "r") for r in rows], schema)
    found = merkle.audit(docs).collect()
    assert len(found) == len(rows) and len({r.root for r in found}) == 1
    leaf = {H(written(d), written(s), written(lang), written(n), written(t)): (d, t) for d, t, lang, s, n in rows}
    for r in found:
        d, t = leaf[r.leaf]
        assert d == r.doc_id
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        lowered = t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        assert r.verified == (not hit or lowered == t) == (r.folded_root == r.root)
    assert any(not r.verified for r in found) and any(r.verified for r in found)
    assert merkle.audit(docs.limit(0)).collect() == []
    (one,) = merkle.audit(docs.where("doc_id = 4")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("") and one.verified == (zlib.crc32(b"4") % 3 != 0)
