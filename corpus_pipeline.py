"""Five stages that turn `documents` into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the
columns of documents; `run` writes each result as Parquet in the shared folder and reads it again.
"""

import uuid

from cuelake.llm import credentials, mixing, neardup, packing, toxicity
from cuelake.plans.cut import shared_folder


def toxic_documents(spark, docs, sf_dir):
    """Documents below the toxicity threshold; the model learns from the labels of the folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.learn(docs, labels))


def near_duplicates(spark, docs, sf_dir):
    """One document of each component of near copies, by five-word shingles at 0.8."""
    return neardup.distinct_documents(docs, width=5, percent=80)


def secrets(spark, docs, sf_dir):
    """All documents, their secrets replaced by a mark."""
    return credentials.redact(docs, credentials.learn(docs))


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences."""
    return packing.best_fit(docs)


STAGES = [("toxicity", toxic_documents), ("near duplicates", near_duplicates), ("secrets", secrets),
          ("source mix", source_mix), ("packing", packed)]


def run(spark, sf_dir):
    """The result of all stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models and hashing have no SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
