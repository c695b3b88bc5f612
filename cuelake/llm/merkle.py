"""Merkle manifest of a table: trees of digests by group, joined under one root, with a proof for every row."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.ordered import div, numbered
from cuelake.plans.cut import durable

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value; whole numbers are written in decimal."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def sibling_places(n: Column, fanout: int) -> Column:
    """Numbers of the other places in a node's run: XOR for pairs, offsets of the slot otherwise."""
    if fanout == 2:
        return F.array(n.bitwiseXOR(F.lit(1)))
    slot = n % fanout
    return F.array(*(n - slot + (slot + k) % fanout for k in range(1, fanout)))


def linked(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (tree, n, digest, ...) with the digests of their siblings: those before them and those after, concatenated.

    A self-join on (tree, computed place); a run has at most `fanout` nodes, so that is what a node gathers.
    """
    asked = nodes.select("tree", "n", F.explode(sibling_places(F.col("n"), fanout)).alias("place"))
    others = nodes.select("tree", F.col("n").alias("place"), F.col("digest").alias("other"))
    met = (asked.join(others, ["tree", "place"]).groupBy("tree", "n")
           .agg(F.sort_array(F.collect_list(F.struct("place", "other"))).alias("siblings")))
    side = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("siblings", keep), lambda s: s["other"]), ""), F.lit(""))
    return (nodes.join(met, ["tree", "n"], "left")
            .withColumn("before", side(lambda s: s["place"] < F.col("n"))).withColumn("after", side(lambda s: s["place"] > F.col("n")))
            .withColumn("alone", F.col("siblings").isNull() & (F.col("n") == 0)).drop("siblings"))


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels of linked nodes, lowest first; `nodes` (tree, n from 0, digest, ...) are the leaves.

    Rows of slot zero emit the parents; a tree ends at the level where its only node is alone.  There is one round per
    level of the highest tree, each on a fanout-th of the rows before.
    """
    last = nodes.agg(F.max("n")).first()[0] or 0
    levels = [durable(linked(nodes, fanout))]
    while last > 0:
        nodes = (levels[-1].where((F.col("n") % fanout == 0) & ~F.col("alone"))
                 .select("tree", div(F.col("n"), fanout).alias("n"), digest("before", "digest", "after").alias("digest")))
        levels.append(durable(linked(nodes, fanout)))
        last //= fanout
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of all trees."""
    return functools.reduce(DataFrame.unionByName, [level.where("alone").select("tree", "digest") for level in levels])


def descend(levels: list[DataFrame], above: DataFrame, carried: list[str], kept: list[str], fanout: int) -> DataFrame:
    """Columns `kept` and digest of the leaves, their path, lowest step first, and the columns `carried` of their tree.

    `above` has (tree, path, *carried): the path that goes on above a tree's top.  The nodes of a level join their
    parents by (tree, n div fanout) and put their own siblings before the parent's path.
    """
    parents = None
    for level in reversed(levels):
        own = ["digest", *kept] if level is levels[0] else []
        found = level.where("alone").join(above, "tree").select("tree", "n", "path", *carried, *own)
        if parents is not None:
            held = parents.select("tree", F.col("n").alias("parent"), F.col("path").alias("rest"), *carried)
            path = F.concat(F.array(F.struct("before", "after")), "rest").alias("path")
            found = found.unionByName(level.where("NOT alone").withColumn("parent", div(F.col("n"), fanout)).join(held, ["tree", "parent"])
                                      .select("tree", "n", path, *carried, *own))
        parents = found
    return parents.select("digest", "path", *carried, *kept)


def manifest(rows: DataFrame, leaf: Column, group: str, order: list[str], keep: dict[str, Column], fanout=FANOUT) -> DataFrame:
    """Columns `keep`, then leaf, path, subroot and root for every row.

    The leaves of a group stand by `order`, then by digest; every `fanout` consecutive nodes become one, until one is
    left, the group's subroot.  The subroots in the order of their groups (null first, others by their UTF-8 bytes)
    likewise give the root.  path is an array of (before, after), the concatenated digests of a node's siblings on each
    side, from the leaf's level to the root.

    Null values are leaves like others, a null group is a group of its own, repeated rows are leaves each, in any
    order among themselves; an empty table gives no rows.  Other columns are left behind.  No group is gathered:
    leaves are numbered by ranges, and a node only meets the nodes of its run.
    """
    # Group as a string that is never null and keeps the order of groups.
    tree = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit(""))
    names = [f"order{i}" for i in range(len(order))]
    leaves = durable(rows.select(tree.alias("tree"), *(F.col(c).alias(n) for c, n in zip(order, names)), leaf.alias("digest"),
                                 F.struct(*(c.alias(n) for n, c in keep.items())).alias("row"))
                     .withColumn("arrival", F.monotonically_increasing_id()))
    nodes = numbered(leaves, ["tree"], [*names, "digest", "arrival"], "n").select("tree", (F.col("n") - 1).alias("n"), "digest", "row")
    levels = climb(nodes, fanout)

    subroots = tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    subroots = numbered(subroots, ["tree"], ["group"], "n").withColumn("n", F.col("n") - 1)
    upper = climb(subroots, fanout)
    root = tops(upper).select("tree", F.array().cast("array<struct<before string, after string>>").alias("path"), F.col("digest").alias("root"))
    above = durable(descend(upper, root, ["root"], ["group"], fanout)
                    .select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
    return descend(levels, above, ["subroot", "root"], ["row"], fanout).select("row.*", F.col("digest").alias("leaf"), "path", "subroot", "root")


def proof_digest(path) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf, path) -> Column:
    """Root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every document.

    A document is tampered with, its letters A-Z lower-cased, where 3 divides the crc32 of its decimal id (a null id
    never); its root is then recomputed from the tampered leaf and the original siblings.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    tampered = F.when(hit, digest(*(field(lowered if f == "text" else f) for f in FIELDS)))
    found = manifest(docs, digest(*map(field, FIELDS)), "lang", ["doc_id"], {"doc_id": F.col("doc_id"), "tampered": tampered})
    return (found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), "path"))
            .select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql(levels=7, upper_levels=4) -> str:
    """The audit in SQL, for groups of up to 8^levels leaves and 8^upper_levels groups."""
    part = lambda x: f"coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)), '-')" if x is None else         f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(part(text if f == "text" else f) for f in FIELDS) + "))"
    crc = ("xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: "
           "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda h, z: CASE WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END, xor(a, b)), "
           "CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))")

    def tree(name, source, depth):
        """Levels name0.. with the concatenated siblings of each node, from a source (g, n, d, size)."""
        made, before = [], source
        for i in range(depth + 1):
            run = "PARTITION BY g, n // 8 ORDER BY n ROWS BETWEEN"
            made.append(f"{name}{i} AS (SELECT *, CASE WHEN size > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lo, "
                        f"CASE WHEN size > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS hi FROM ({before}))")
            before = (f"SELECT g, n // 8 AS n, sha256(string_agg(d, '' ORDER BY n)) AS d, (max(size) + 7) // 8 AS size FROM {name}{i} WHERE size > 1 GROUP BY g, n // 8 "
                      f"UNION ALL SELECT g, n, d, size FROM {name}{i} WHERE size = 1")
        return made

    def path(name, depth, inner):
        """Steps of `inner` (g, n, acc, pf, ...) along the levels of a tree: folded digest and concatenated siblings."""
        for i in range(depth):
            inner = (f"SELECT x.* EXCLUDE (n, acc, pf), CASE WHEN y.size > 1 THEN x.n // 8 ELSE x.n END AS n, "
                     f"CASE WHEN y.size > 1 THEN sha256(concat(y.lo, x.acc, y.hi)) ELSE x.acc END AS acc, concat(x.pf, y.lo, y.hi) AS pf "
                     f"FROM ({inner}) x JOIN {name}{i} y ON x.g IS NOT DISTINCT FROM y.g AND x.n = y.n")
        return inner

    parts = [f"leaves AS (SELECT doc_id, lang AS g, {leaf('text')} AS leaf, CASE WHEN coalesce({crc} % 3 = 0, false) "
             f"THEN {leaf(f'translate(text, {UPPER!r}, {LOWER!r})')} ELSE {leaf('text')} END AS used FROM documents)",
             "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n, count(*) OVER (PARTITION BY g) AS size FROM leaves)",
             *tree("a", "SELECT g, n, leaf AS d, size FROM placed", levels),
             f"subs AS (SELECT g AS lang, d, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS n, count(*) OVER () AS size FROM a{levels})",
             *tree("b", "SELECT 0 AS g, n, d, size FROM subs", upper_levels),
             f"low AS ({path('a', levels, 'SELECT doc_id, leaf, g, n, used AS acc, CAST(NULL AS VARCHAR) AS pf FROM placed')})",
             "mid AS (SELECT low.doc_id, low.leaf, subs.d AS subroot, 0 AS g, subs.n, low.acc, low.pf FROM low JOIN subs ON low.g IS NOT DISTINCT FROM subs.lang)",
             f"top AS ({path('b', upper_levels, 'SELECT * FROM mid')})"]
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, d AS root, sha256(concat(pf, '')) AS proof_sha256, "
            f"acc AS folded_root, acc = d AS verified FROM top, (SELECT d FROM b{upper_levels})")


SQL = _sql()
