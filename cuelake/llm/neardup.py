"""Near-duplicates by circulant MinHash: signatures from two permutations, bands, and full sets to confirm."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import WordTable, fresh, per_text
from cuelake.llm.components import components
from cuelake.plans.cut import durable

#: Positions that both permutations order.
POSITIONS = 1 << 20
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40, about 1e-7.
BANDS, BAND_ROWS = 40, 5
COORDINATES = BANDS * BAND_ROWS
#: A pair at 0.8 agrees in fewer of its 200 coordinates than this with probability below 1e-8.
LEAST_AGREEING = 124
#: Least similarity that bands, LEAST_AGREEING and the size test of a pair are whole for.
LEAST_PERCENT = 80
#: Documents of a part of a tile and of a block, and documents checked against one block in one task, about.
TILE = 512
ASKED_ROWS = 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "n_shingles bigint, set_key binary, bands array<bigint>, low binary"


class Shingler:
    """The set of a text's shingles, as sorted 64-bit hashes.

    A-Z are lowered and words end at white space of ASCII; bytes.lower() and bytes.split() do just that.
    """

    def __init__(self, width: int):
        self.width, self.words = width, WordTable(xxhash.xxh3_64_intdigest)

    def __call__(self, text):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        rows = len(words) - width + 1
        mixed = np.full(rows, width, np.uint64)
        for k in range(width):
            mixed = (mixed ^ codes[k:k + rows]) * MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


class Circulant:
    """Coordinate k of a set is the least second-permutation value of its first-permuted positions, shifted by k."""

    def __init__(self):
        draw = np.random.default_rng(9)
        self.first = draw.permutation(POSITIONS).astype(np.uint32)
        second = draw.permutation(POSITIONS).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([second, second[:COORDINATES]]), COORDINATES)

    def __call__(self, shingles):
        at = self.first[(shingles >> np.uint64(20)) & np.uint64(POSITIONS - 1)]
        least = np.full(COORDINATES, POSITIONS, np.uint32)
        for k in range(0, len(at), 1024):
            least = np.minimum(least, self.shifted[at[k:k + 1024]].min(axis=0))
        return least


def sketcher(width: int):
    """Function from texts to [size, key of the set, band keys, low bytes of the signature], for `per_text`."""
    shingler, circulant = Shingler(width), Circulant()
    numbers = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def one(text):
        shingles = shingler(text)
        if not len(shingles):
            return 0, None, None, None
        least = circulant(shingles)
        keys = numbers.copy()
        for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
            keys = (keys ^ column) * MULTIPLIER
            keys ^= keys >> np.uint64(32)
        return (len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), keys.view(np.int64),
                least.astype(np.uint8).tobytes())

    def work(texts):
        made = [one(t) for t in texts]
        return [list(c) for c in zip(*made)] if made else [[], [], [], []]

    return work


def keyer(width: int):
    """Function from texts to the keys of their sets alone, for `per_text`."""
    shingler = Shingler(width)

    def one(text):
        shingles = shingler(text)
        return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None

    return lambda texts: [[one(t) for t in texts]]


def tiles(members: DataFrame) -> DataFrame:
    """What to confirm, (x, family, part, ys), among members (bucket, rep, component, n, low, family, part).

    Two members of one bucket but two components are asked for if their sizes and signatures allow a link; those that
    a document x is to be compared with come as one list for each block (family, part) of theirs.

    The commonest component of a bucket is its core.  Core and other members are dealt into parts of about TILE; a
    core part meets every other part, other parts meet each other and themselves, core parts never meet.  So a large
    core with few others costs little, and no tile holds more than two parts.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    bucket = (sizes.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("core"),
                                          F.max("c").alias("in_core"), F.sum("c").alias("all"))
              .select("bucket", "core", F.ceil(F.col("in_core") / TILE).alias("core_parts"),
                      F.ceil((F.col("all") - F.col("in_core")) / TILE).alias("other_parts")).where("other_parts > 0"))
    rows = members.join(bucket, "bucket").withColumn("in_core", F.expr("component = core"))
    cut = F.pmod(F.xxhash64("rep"), F.when(F.col("in_core"), F.col("core_parts")).otherwise(F.col("other_parts")))
    rows = rows.withColumn("cut", cut)
    # A cell is (-1 - core part, other part) or (lower other part, higher other part).
    cells = F.when(F.col("in_core"), F.expr("transform(sequence(0L, other_parts - 1), j -> struct(-1 - cut AS x, j AS y))")).otherwise(
        F.concat(F.expr("transform(sequence(0L, core_parts - 1), i -> struct(-1 - i AS x, cut AS y))"),
                 F.expr("transform(sequence(0L, other_parts - 1), j -> struct(least(cut, j) AS x, greatest(cut, j) AS y))")))
    kept = ["rep", "component", "n", "low", "family", "part", "in_core"]
    rows = rows.select("bucket", F.explode(cells).alias("cell"), *kept)
    rows = (rows.select("bucket", "cell.x", "cell.y", *kept)
            .repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y"))

    def compare(group):
        rep, component, n, family, part = (np.array([r[k] for r in group], np.int64) for k in (3, 4, 5, 7, 8))
        low = np.frombuffer(b"".join(r[6] for r in group), np.uint8).reshape(len(group), COORDINATES)
        # The core first: its members are then found by the few others, not each of them by itself.
        order = np.lexsort((rep, [not r[9] for r in group]))
        rep, component, n, family, part, low = (v[order] for v in (rep, component, n, family, part, low))
        for i in range(1, len(group)):
            ok = (component[:i] != component[i]) & (100 * np.minimum(n[:i], n[i]) >= LEAST_PERCENT * np.maximum(n[:i], n[i]))
            at = np.flatnonzero(ok)
            if len(at):
                at = at[(low[at] == low[i]).sum(axis=1) >= LEAST_AGREEING]
            blocks = {}
            for j in at:
                blocks.setdefault((int(family[j]), int(part[j])), []).append(int(rep[j]))
            for (f, p), ys in blocks.items():
                yield int(rep[i]), f, p, ys

    def batch_of(found):
        columns = list(zip(*found)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["x", "family", "part", "ys"])

    def run(batches):
        group, own = [], None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", *kept))):
                if row[:3] != own:
                    found += compare(group)
                    group, own = [], row[:3]
                group.append(row)
            yield batch_of(found)
        yield batch_of(list(compare(group)))

    return (rows.mapInArrow(run, "x bigint, family bigint, part bigint, ys array<bigint>").groupBy("x", "family", "part")
            .agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys")))


class Block:
    """The sets of up to some hundred documents, and how many shingles another set shares with each."""

    def __init__(self, ids, sets):
        self.place = {x: i for i, x in enumerate(ids)}
        self.sizes = np.array([len(s) for s in sets])
        codes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owner = codes[order], owner[order]

    def shared(self, own):
        first, last = np.searchsorted(self.codes, own, "left"), np.searchsorted(self.codes, own, "right")
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def confirmed(asked: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) of `asked` (x, family, part, ys) whose full sets reach `percent` of Jaccard similarity.

    `texts` (rep, text) has a text of every class.  `members` (family, part, y) names the documents of each block.  What is asked of a block is dealt into parts of
    about ASKED_ROWS; a task keeps the sets of one block at a time.
    """
    keys = ["family", "part"]
    use = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ASKED_ROWS).alias("deals"))
    needed = asked.select(*keys, F.explode("ys").alias("y")).distinct()
    known = (members.join(needed, [*keys, "y"], "left_semi").join(use, keys)
             .select(F.col("y").alias("rep"), *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"),
                     F.lit(0).alias("role"), F.lit(None).cast("array<bigint>").alias("ys")))
    other = (asked.join(use, keys).select(F.col("x").alias("rep"), *keys, F.pmod(F.xxhash64("x"), "deals").alias("deal"),
                                          F.lit(1).alias("role"), "ys"))
    rows = (known.union(other).join(texts, "rep").repartition(*keys, "deal")
            .sortWithinPartitions(*keys, "deal", "role").select(*keys, "deal", "role", "rep", "ys", "text"))

    def run(batches):
        shingler, own, ids, sets, block = Shingler(width), None, [], [], None
        for batch in batches:
            a, b = [], []
            for f, p, deal, role, x, ys, text in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (f, p, deal) != own:
                    own, ids, sets, block = (f, p, deal), [], [], None
                found = shingler(text)
                if role == 0:
                    ids.append(x)
                    sets.append(found)
                    continue
                if block is None and ids:
                    block, sets = Block(ids, sets), []
                if block is None:
                    continue
                both = block.shared(found)
                for y in ys:
                    at = block.place.get(y)
                    if at is not None and both[at] and 100 * both[at] >= percent * (len(found) + block.sizes[at] - both[at]):
                        a.append(y)
                        b.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width=5, percent=80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents.

    Equal sets are one class, numbered by a 64-bit hash of its key, so texts under one id stay apart.  Classes that share a band are candidates.  Each is
    first checked against the leader it shares most bands with; the links found make components.  What is left, pairs
    in one bucket but two components, is compared by signatures in tiles and then on full sets, block by block.  So
    every pair that shares a band is either joined already or checked, and no group is expanded into rows of pairs.

    Null and empty texts have no shingles, link with nothing and are kept.  Rows with a null id take no part: they get
    a null component and are kept.  Each row is linked by its own text.  A component is named by its smallest id; of the
    rows with that id, those of one class are kept.  Components with one smallest id have the same name, but are kept each.
    A `percent` below LEAST_PERCENT would lose links and is refused.
    """
    return _judged(docs, width, percent).drop("rep")


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`near_duplicates` with the number of each row's class, `rep`; one number stands for all texts without shingles."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"bands, sizes and signatures are tested for {LEAST_PERCENT} percent and more, not for {percent}")
    number = F.xxhash64("set_key")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = durable(per_text(ids, ["doc_id"], lambda: sketcher(width), SKETCH))
    classes = durable(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
        .withColumn("rep", number))
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = durable(banded.join(sizes, "bucket"))
    # The original of a family of copies is in more and larger buckets than any copy, so it leads where it occurs.
    central = crowd.groupBy("rep").agg(F.sum("size").alias("central"))
    ranked = crowd.select("bucket", "rep").join(central, "rep")
    leaders = ranked.groupBy("bucket").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("leader"))
    led = (crowd.select("bucket", "rep").join(leaders, "bucket").where("rep <> leader").groupBy("rep", "leader")
           .agg(F.count(F.lit(1)).alias("c")).groupBy("rep").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader")))
    led = durable(crowd.select("rep").distinct().join(led, "rep", "left"))
    first = led.where("leader IS NOT NULL").select(F.col("rep").alias("x"), F.col("leader").alias("family"), F.lit(-1).cast("long").alias("part"),
                                                   F.array("leader").alias("ys"))
    # An id may have several texts; the set of each tells which class it belongs to.
    named = classes.join(led.select("rep"), "rep", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    texts = per_text(ids.join(named, "doc_id", "left_semi"), ["text"], lambda: keyer(width), "set_key binary")
    texts = durable(texts.where("set_key IS NOT NULL").select(number.alias("rep"), "text"))
    heads = first.select("family", "part", F.col("family").alias("y")).distinct()
    links = durable(confirmed(first, heads, texts, width, percent))

    # Blocks of those that have one leader: what is alike is compared with what is alike.
    families = led.select("rep", F.coalesce("leader", "rep").alias("family"))
    counts = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    families = families.join(counts, "family").select("rep", "family", F.pmod(F.xxhash64("rep"), "parts").alias("part"))
    joined = components(links).withColumnRenamed("node", "rep")
    known = durable(families.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    mixed = crowd.select("bucket", "rep").join(known.select("rep", "component"), "rep")
    split = durable(mixed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket"))
    left = durable(crowd.select("bucket", "rep").join(split, "bucket").join(known, "rep").join(classes.select("rep", "n", "low"), "rep"))
    asked = durable(tiles(left))
    found = links.union(confirmed(asked, known.select("family", "part", F.col("rep").alias("y")), texts, width, percent))

    whole = components(found).withColumnRenamed("node", "rep")
    of_class = (classes.select("set_key", "rep", "least").join(whole, "rep", "left")
                .withColumn("component", F.coalesce("component", "rep")))
    heads = of_class.groupBy("component").agg(F.min(F.struct("least", "rep")).alias("head"))
    of_class = of_class.join(heads, "component").select("set_key", F.col("head.least").alias("component_id"),
                                                        (F.col("rep") == F.col("head.rep")).alias("leads"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (sketches.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
                    F.when(alone, True).otherwise(F.col("leads") & (F.col("doc_id") == F.col("component_id"))).alias("kept"),
                    number.alias("rep")))


def distinct_documents(docs: DataFrame, width=5, percent=80) -> DataFrame:
    """The rows of `docs` that stay: one of each component, and all with a null id.

    Of rows that repeat an id with equal sets of shingles, the least by its columns stays; other texts under the id are
    judged by themselves.
    """
    stay = _judged(docs, width, percent).where("kept AND doc_id IS NOT NULL").select("doc_id", "rep").distinct()
    rest, key = [c for c in docs.columns if c != "doc_id"], fresh("set_key", docs.columns)
    number = fresh("rep", docs.columns)
    known = per_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL"), docs.columns,
                     lambda: keyer(width), f"{key} binary").withColumn(number, F.xxhash64(key))
    known = known.join(stay.withColumnRenamed("rep", number), ["doc_id", number], "left_semi")
    known = known.groupBy("doc_id", number).agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return known.select(*docs.columns).union(docs.where("doc_id IS NULL"))
