"""Packing token pieces into sequences by minimum bin slack: the fullest combination of lengths, bin by bin."""

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.plans.cut import durable

CAPACITY = 1024
END_ID = 2
#: A length is ranked in blocks, so that a common length is not one task: as many as rows over this, LEAST_BLOCKS at least.
BLOCK_ROWS = 20_000
LEAST_BLOCKS = 64
#: Chunks whose ids a worker keeps.
KEPT_CHUNKS = 600_000
#: New chunks that are encoded as one text.
RUN = 256
#: Before chunks without a space before them; no text of Arrow holds this lone surrogate.
START = "\ud800"
PUNCTUATION = ".,;:!?"
TWO_SPACES = re.compile(r"\s\s")
GAP = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit numbers; array("I") has four bytes wherever Python runs Arrow."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Numbered(dict):
    """Numbers keys as they are asked for, and lists those not yet seen to."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer always cuts before a single space that stands between other characters, and between
    letters and punctuation.  So a text may be encoded in chunks cut there, and a worker keeps the ids of chunks that
    it has met.  A chunk's key leaves out the space before it; START marks chunks that have none.  New chunks that begin
    and end without white space are encoded in runs, and the bytes that tokens stand for tell where each one ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # A token of a byte-level vocabulary has one character for each byte.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.forget()

    def forget(self):
        self.place, self.ids = Numbered(), []

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > KEPT_CHUNKS:
            self.forget()
        rows = []
        for text in texts:
            # A special token's string may hold no space, but keep such texts whole to be safe.
            chunks = [text] if "<|" in text else GAP.split(text) if TWO_SPACES.search(text) else text.split(" ")
            chunks[0] = START + chunks[0]
            rows.append(list(map(self.place.__getitem__, chunks)))
        self.encode_new()
        return [b"".join(map(self.ids.__getitem__, row)) for row in rows]

    def encode_new(self):
        """Ids of the chunks met since the last call; letters and the punctuation after them are chunks themselves."""
        alone, linked, joined = [], [], []
        for chunk in self.place.new:
            word = chunk.rstrip(PUNCTUATION)
            if len(word) < len(chunk) and word.isalpha():
                joined.append((self.place[chunk], self.place[word], self.place[START + chunk[len(word):]]))
            elif not chunk or chunk[0] == START or chunk[0].isspace() or chunk[-1].isspace():
                alone.append(chunk)
            else:
                linked.append(chunk)
        self.place.new = []
        self.ids += [None] * (len(self.place) - len(self.ids))
        runs = [linked[k:k + RUN] for k in range(0, len(linked), RUN)]
        for run, ids in zip(runs, self.encoded([" " + " ".join(run) for run in runs])):
            if not self.divide(run, np.array(ids, "<u4")):
                alone += run
        texts = [c[1:] if c[:1] == START else " " + c for c in alone]
        for chunk, ids in zip(alone, self.encoded(texts)):
            self.ids[self.place[chunk]] = little_endian(ids)
        for chunk, word, rest in joined:
            self.ids[chunk] = self.ids[word] + self.ids[rest]

    def encoded(self, texts: list[str]):
        return (found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)) if texts else ()

    def divide(self, run: list[str], ids) -> bool:
        """Gives each chunk of a run its share of the run's ids; False, and nothing given, if a token spans two chunks."""
        ends = np.cumsum(self.widths[ids])
        wanted = np.cumsum([len(c.encode()) + 1 for c in run])
        last = np.searchsorted(ends, wanted)
        if last[-1] != len(ends) - 1 or (ends[last] != wanted).any():
            return False
        raw, at = ids.tobytes(), 0
        for chunk, end in zip(run, (4 * last + 4).tolist()):
            self.ids[self.place[chunk]] = raw[at:end]
            at = end
        return True


def pieces(docs: DataFrame, path: str | None = None, capacity=CAPACITY, end_id=END_ID, with_ids=False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document.

    A document is the ids of its text (null: none) and the end id.  A longer one than `capacity` is cut so that only
    the first piece is shorter.  Repeated rows are separate documents.
    """
    path = path or tokenizer_path()
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches):
        encoder, last = ChunkEncoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_all(texts)):
                    ids += last
                    size = len(ids) // 4
                    start, k = 0, 0
                    while start < size:
                        length = (size - start - 1) % capacity + 1 if start == 0 else capacity
                        own = ids[4 * start:4 * (start + length)]
                        rows.append((doc_id, k, start, length, zlib.crc32(own), own))
                        start, k = start + length, k + 1
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest feasible combination [(length, how often)] that holds the longest length left.

    Bit s of a set says that some combination of the lengths so far sums to s; a length that occurs n times is
    added in doublings, 1, 2, 4 ... of it at once, and the sets are walked back from the largest sum.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        size = 1
        while left > 0:
            take = min(size, left)
            after = (reach | reach << (take * length)) & mask
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity=CAPACITY) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length, runs (first rank, how many in a sequence, first sequence, sequences, offset of the first).

    Bins are filled one after another, each by `fullest`; a combination is used again for as many bins as its
    lengths allow, so at most about one combination for each length is searched, whatever the number of pieces.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    runs, given, sequence = {}, {k: 0 for k in counts}, 0
    while counts:
        combination = fullest(counts, capacity)
        bins = min(counts[k] // n for k, n in combination)
        offset = 0
        for k, n in combination:
            runs.setdefault(k, []).append((given[k], n, sequence, bins, offset))
            given[k] += n * bins
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
            offset += k * n
        sequence += bins
    return runs


def pack(rows: DataFrame, capacity=CAPACITY) -> DataFrame:
    """`rows` (any columns with `length`, 1 to `capacity`) with sequence_id and offset.

    Only the number of rows of each length goes to the driver, at most `capacity` numbers.  A row takes its place
    from its rank among the rows of its length; ranks come from counts of (length, block) and a window inside one,
    where a block is a hash of the row.  Rows that are equal in all columns take the places of their ranks in any order.
    """
    keys = [c for c in rows.columns if c != "ids"]
    rows = durable(rows)
    totals = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = max(LEAST_BLOCKS, sum(totals.values()) // BLOCK_ROWS)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    counted = rows.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    runs = {k: np.array(v, np.int64) for k, v in plan(totals, capacity).items()}
    by_length = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "_block", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy(*keys)
    ranked = (rows.withColumn("_rank", F.row_number().over(inside) - 1).join(before, ["length", "_block"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_block", "_before"))
    names = [*rows.drop("_block").columns, "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                run_of = runs[int(k)]
                found = run_of[np.searchsorted(run_of[:, 0], rank[own], "right") - 1]
                at = rank[own] - found[:, 0]
                sequence[own] = found[:, 2] + at // found[:, 1]
                offset[own] = found[:, 4] + at % found[:, 1] * k
            made = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([made.get(n) if n in made else batch.column(n) for n in names], names)

    fields = rows.drop("_block").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, fields)


def best_fit(docs: DataFrame, path: str | None = None, capacity=CAPACITY, end_id=END_ID, with_ids=False) -> DataFrame:
    """Every document's pieces with the sequence and the place that each takes; `with_ids` adds the ids themselves."""
    return pack(pieces(docs, path, capacity, end_id, with_ids), capacity)
