"""Helpers that the corpus operators share: folds, bounded samples, per-text work on Arrow batches."""

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators of words: space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that a worker turns at once, so that a batch of long texts stays small.
ROWS_AT_ONCE = 256
#: Entries of a worker's table of words; a word beyond it is worked out each time.
CACHED_WORDS = 250_000


def held_out(doc_id="doc_id"):
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2.  False for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_by_hash(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, label) of the `rows` ids of `known` (doc_id, label) with the smallest hashes.

    The ids are chosen first, so the broadcast side has at most `rows` ids and the texts of other rows
    stay where they are.  A repeated id gives one row (its least text).
    """
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """Sample of documents with a 0/1 label outside the held-out fold; of conflicting labels the larger counts."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label")))
    return sample_by_hash(docs, known, rows)


def fit_in_task(sample: DataFrame, fit):
    """`fit(texts, labels)` of a bounded sample in one task, with near copies left out; the model comes back."""
    def run(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"]))
        rows = [rows[i] for i in distinct_texts([r["text"] for r in rows])]
        model = fit([r["text"] for r in rows], [r["label"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "model binary").first()
    return fit([], []) if found is None else pickle.loads(bytes(found[0]))


def distinct_texts(texts: list[str], bands=8, rows=8) -> list[int]:
    """Positions of texts that are no near copy of an earlier one: no band of word minima in common.

    Copies would otherwise pass off the chance words of one document as evidence.
    """
    draw = np.random.default_rng(17)
    a = draw.integers(1, 2 ** 61, bands * rows, dtype=np.uint64) | np.uint64(1)
    seen, keep = set(), []
    for at, text in enumerate(texts):
        words = set(text.split())
        codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
        if not len(codes):
            continue
        codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        least = np.concatenate([(codes[i:i + 4096, None] * a[None]).min(axis=0)[None]
                                for i in range(0, len(codes), 4096)]).min(axis=0)
        marks = {(k, least[k * rows:(k + 1) * rows].tobytes()) for k in range(bands)}
        if not marks & seen:
            keep.append(at)
        seen |= marks
    return keep


class WordTable(dict):
    """A worker's bounded table word -> value, filled by `work` when a word is met."""

    def __init__(self, work, most=CACHED_WORDS):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, word):
        value = self.work(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def fresh(name: str, columns: list[str]) -> str:
    """`name` with underscores before it until no column is called that, in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def per_text(df: DataFrame, keep: list[str], start, fields: str, rows=ROWS_AT_ONCE) -> DataFrame:
    """Columns `keep` of every row, followed by `fields` (DDL) worked out from its text.

    `start()` runs once in a task and returns a function from a list of texts (None for null) to a list
    of one Arrow array or Python list per field.
    """
    kept = df.select(*keep).schema
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}, {fields}"
    types = df.sparkSession.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = [to_arrow_type(f.dataType) for f in types]
    names = [*keep, *types.names]

    def run(batches):
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(part.column("text").to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], names)

    return df.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)
