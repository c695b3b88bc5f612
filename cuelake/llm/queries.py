"""One query for each corpus operator, over its whole table, and the SQL of those that SQL can express."""

from pyspark.sql import functions as F

from cuelake.llm import (credentials, hardneg, langid, merkle, mixing, neardup, packing, permindex, quality, toolcalls, topk, toxicity,
                         warc)
from cuelake.plans.cut import durable

ORACLES = {"op3_maxscore": topk.SQL, "op5_warc": warc.SQL, "op10_toolcalls": toolcalls.SQL,
           "op11_hardneg": hardneg.SQL, "op13_merkle": merkle.SQL}


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark, folder):
    """Toxicity of every document; `offending` counts its offending sentences."""
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.selectExpr("doc_id", "held_out", "score", "predicted", "size(offending) AS offending")


def op2_packing(spark, folder):
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.best_fit(table(spark, folder, "documents"))


def op3_maxscore(spark, folder):
    """The five best vectors for each vector whose id is divisible by 50."""
    return topk.search(table(spark, folder, "embeddings"))


def op4_language(spark, folder):
    """Language of every document."""
    return langid.languages(table(spark, folder, "documents"))


def op5_warc(spark, folder):
    """Every page's record after writing archives and reading them by byte ranges."""
    return warc.round_trip(table(spark, folder, "pages"))


def op6_secrets(spark, folder):
    """Secrets of every document: counts and digest of fixed formats, spans with the learned ones."""
    return credentials.secrets(table(spark, folder, "documents"))


def op7_quality(spark, folder):
    """Counts, fixed verdict and calibrated verdict of every document."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_mixing(spark, folder):
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, folder, "documents"))


def op9_minhash(spark, folder):
    """Components of documents whose sets of two-word shingles reach 0.8; every row of a component's smallest id is kept."""
    found = neardup.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), "kept"))


def op10_toolcalls(spark, folder):
    """Calls and results that the turns of conversations stand for, linked, ordered, checked and written as JSON."""
    return toolcalls.tool_calls(table(spark, folder, "conversations"))


def op11_hardneg(spark, folder):
    """Hard negatives for the vectors whose id is divisible by 100; labels of every seventh id are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = durable(hardneg.labelled(table(spark, folder, "embeddings").withColumn("label", moved)))
    return hardneg.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


def op12_permutation(spark, folder):
    """The ten nearest vectors found for each vector whose id is divisible by 100."""
    return permindex.neighbours(table(spark, folder, "embeddings"))


def op13_merkle(spark, folder):
    """Leaf, roots, proof and check of every document, a third of them tampered with."""
    return merkle.audit(table(spark, folder, "documents"))


QUERIES = {query.__name__: query for query in (
    op1_toxicity, op2_packing, op3_maxscore, op4_language, op5_warc, op6_secrets, op7_quality, op8_mixing, op9_minhash, op10_toolcalls,
    op11_hardneg, op12_permutation, op13_merkle)}
