"""Mixing sources to target weights: certain whole copies, then Pareto order samples of fixed size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.llm.common import WORD_PATTERN, fresh
from cuelake.plans.cut import durable

#: Weights of sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, in percent of all words; no source beyond LIMIT times its own.
PERCENT, LIMIT = 150, 2
#: Slices of the random order that running sums are taken in.
SLICES = 256
#: Passes that fill what the sample leaves short, each with documents that still fit.
FILLS = 2


def draw(salt: str):
    """Uniform number below 2**52 and above 0 that only the id (null: empty) decides."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 1


def targets(sizes: DataFrame, weights=WEIGHTS, percent=PERCENT, limit=LIMIT) -> DataFrame:
    """(number, source, source_size, target) from one row (source, source_size) for each source.

    Sources in order of code points, null last, take the weights in turn.  A source stops at `limit` times its size
    and what it leaves goes to the others by weight, until none is above: with sources in order of size by weight,
    those stop that lie before the first whose share of the rest fits.
    """
    sizes = sizes.withColumn("source_size", F.coalesce("source_size", F.lit(0)).cast("long"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("number", F.row_number().over(named))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(percent))
            .withColumn("rest", F.col("total") - 100 * limit * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
            .withColumn("shares", F.sum("weight").over(later)))
    rows = rows.withColumn("fits", (F.col("rest") * F.col("weight") <= 100 * limit * F.col("source_size") * F.col("shares")).cast("int"))
    rows = rows.withColumn("open", F.max("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = (rows.withColumn("level_rest", F.first(F.when(F.col("open") == 1, F.col("rest")), True).over(first))
            .withColumn("level_shares", F.first(F.when(F.col("open") == 1, F.col("shares")), True).over(first)))
    share = F.col("level_rest").cast("double") * F.col("weight") / (F.col("level_shares") * 100)
    return rows.select("number", "source", "source_size", F.when(F.col("open") == 1, share)
                       .otherwise((F.col("source_size") * limit).cast("double")).alias("target"))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows of its key up to and with its own, in the order of (slice, `order`).

    Sums of slices come first, so a common key is as many tasks as it has slices.
    """
    parts = rows.groupBy(*keys, "slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_own", F.sum(value).over(inside)).join(parts, [*keys, "slice"])
            .withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before"))


def mix(docs: DataFrame, weights=WEIGHTS, percent=PERCENT, limit=LIMIT, salt="mix:", keep=()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and `keep`) of every document.

    A source's target over its size is the copies that each of its documents should have: the whole part is certain.
    For the fraction, documents are ranked by random odds over inclusion odds (Pareto order sampling) and taken in
    that order while the words still to take last; then, in the same order, those that still fit, FILLS times.  So a
    source misses its target by less than its smallest document left out, as a rule.

    Sizes count words; null texts have none and null sources are one source.  A repeated id draws the same number;
    its rows are ordered by size, and rows equal in both may swap places.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), *keep, F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    rows = durable(rows)
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, limit)
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(limit))).otherwise(0)
    aims = durable(aims.withColumn("copies", copies).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
                   .withColumn("part", F.col("need") / F.greatest("source_size", F.lit(1))).withColumnRenamed("source", "_source"))

    rows = rows.withColumn("drawn", draw(salt)).withColumn("slice", F.floor(F.col("drawn") * SLICES / F.lit(2 ** 52 + 1)).cast("int"))
    spread = sliced(aims.drop("target", "source_size"))
    rows = rows.join(spread, rows["source"].eqNullSafe(spread["_source"]) & (rows["slice"] == spread["_slice"])).drop("source", "_source", "_slice")
    # Within a source the inclusion odds are one number, so slices of the draw are slices of the rank.
    part = F.greatest(F.least(F.col("part"), F.lit(1 - 1e-9)), F.lit(1e-9))
    odds = F.col("drawn") / (F.lit(2.0 ** 52 + 2) - F.col("drawn"))
    rows = rows.withColumn("rank", odds / (part / (1 - part))).withColumn("chosen", F.lit(0)).drop("part")
    for turn in range(1 + FILLS):
        got = rows.groupBy("number").agg(F.sum(F.col("size") * F.col("chosen")).alias("got"))
        short = sliced(aims.join(got, "number").select(F.col("number").alias("_number"), (F.col("need") - F.col("got")).alias("short")))
        rows = rows.join(short, (rows["number"] == short["_number"]) & (rows["slice"] == short["_slice"])).drop("_number", "_slice")
        # The first pass stops at the document that goes beyond; the fills see only documents that fit.
        fits = (F.col("chosen") == 0) & (F.col("size") > 0)
        fits = fits & (F.col("size") <= F.col("short")) if turn else fits
        rows = running(rows.withColumn("fits", F.when(fits, F.col("size")).otherwise(0)), ["number"],
                       ["rank", "drawn", "doc_id", "size"], "fits", "reach")
        chosen = F.when((F.col("fits") > 0) & (F.col("reach") <= F.col("short")), 1).otherwise(F.col("chosen"))
        rows = durable(rows.withColumn("chosen", chosen).drop("fits", "reach", "short"))
    last = sliced(aims.select(F.col("number").alias("_number"), "source_size", "target"))
    rows = rows.join(last, (rows["number"] == last["_number"]) & (rows["slice"] == last["_slice"]))
    return rows.select("doc_id", *keep, "size", "source_size", "target", ((F.col("copies") + F.col("chosen")) * F.col("size")).alias("taken"),
                       (F.col("copies") + F.col("chosen")).cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them.

    Texts stay out of the sampling; they meet their copies by id and a hash of the row.
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    row, copies = fresh("row_hash", docs.columns), fresh("row_copies", docs.columns)
    marked = docs.withColumn(row, F.xxhash64(*rest))
    taken = (mix(marked, keep=(row,), **options).groupBy("doc_id", row).agg(F.sum("copies").alias(copies))
             .where(F.col(copies) > 0).withColumnRenamed("doc_id", "_id").withColumnRenamed(row, "_row"))
    once = marked.groupBy("doc_id", row).agg(F.first(F.struct(*rest)).alias("_rest"))
    found = once.join(taken, once["doc_id"].eqNullSafe(taken["_id"]) & (once[row] == taken["_row"]))
    repeated = found.select("doc_id", "_rest.*", F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))).alias(copies))
    return repeated.select(*docs.columns)


def sliced(rows: DataFrame) -> DataFrame:
    """One copy of each row for every slice, so that a common source joins in as many tasks."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLICES))).alias("_slice"))
