"""WARC archives: writing one gzip member per record, and a reader whose tasks own byte ranges."""

import hashlib
import posixpath
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.plans.cut import durable, shared_folder

#: Payloads below this are never written as revisits.
LEAST_REVISITED = 100
#: Bytes of the range that a reading task owns, and of one read.
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Reading tasks, at most; beyond that a task has several ranges.
MOST_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
RECORD = ("record_type string, record_id string, target_uri string, refers_to_id string, payload_digest string, "
          "payload_bytes bigint, payload binary, path string, start bigint, length bigint")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Only digests and ids are grouped; a digest of many pages is met by partial minima and by a join that AQE may
    split.  A page that shares the smallest page_id of its payload is a response, and so is one of a payload whose
    page_ids are all null.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("payload_digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = (rows.where(F.col("payload_bytes") >= LEAST_REVISITED).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    joined = rows.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first")).alias("refers_to"))


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record_id_column):
    """The page_id in a record id; null where it holds none."""
    return F.nullif(F.regexp_extract(record_id_column, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record.  A revisit carries its HTTP head only; its payload is named by digest and by record."""
    payload = (row["html"] or "").encode("utf-8")
    kind = row["record_type"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", " ".join((row["url"] or "").split())), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", "sha256:" + row["payload_digest"]), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(row["refers_to"]))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that a repeated task writes the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes `rows` of `record_types` as archives below `folder`; (path, bytes, records) of each file.

    A task writes one file under a name of its own; only files that finished tasks report are listed, so what lost or
    repeated attempts leave behind is never read.  The listing is checkpointed, which runs the writing once.
    """
    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, sink, size, records = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if sink is None:
                        sink = store.open_output_stream(posixpath.join(base, name), compression=None)
                    data = member(record_bytes(row))
                    sink.write(data)
                    size, records = size + len(data), records + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, name)]), pa.array([size], pa.int64()),
                                              pa.array([records], pa.int64())], ["path", "bytes", "records"])

    return durable(rows.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to")
                   .mapInArrow(run, "path string, bytes bigint, records bigint"))


class Tail:
    """Bytes of a file from `at` on, read on demand."""

    def __init__(self, file, at: int, size: int):
        self.file, self.base, self.size, self.data = file, at, size, b""

    def fill(self, to: int) -> bool:
        """Makes bytes up to position `to` of the file present; False where the file ends before."""
        while self.base + len(self.data) < to:
            self.file.seek(self.base + len(self.data))
            more = self.file.read(min(READ_BYTES, self.size - self.base - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def drop(self, to: int):
        """Forgets the bytes before position `to`."""
        if to - self.base >= READ_BYTES:
            self.data, self.base = self.data[to - self.base:], to


def unpacked(tail: Tail, start: int, most: int | None = None):
    """(bytes, end) of the gzip member at `start`, or None where none is.  With `most`, its first bytes only."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    got = 0
    while not unpacker.eof:
        if not tail.fill(at + 1):
            return None
        part = tail.data[at - tail.base:][:READ_BYTES if most is None else 4096]
        try:
            out.append(unpacker.decompress(part) if most is None else unpacker.decompress(part, most - got))
        except zlib.error:
            return None
        got += len(out[-1])
        at += len(part)
        if most is not None and got >= most:
            return b"".join(out), None
    return b"".join(out), at - len(unpacker.unused_data)


def parsed(data: bytes):
    """Head fields (lower-case names) and block of a record, or None where the bytes are no record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, rest[:int(fields["content-length"])]


def read(files: DataFrame, range_bytes=RANGE_BYTES) -> DataFrame:
    """Records of the archives that `files` (path, bytes) names, with their place.

    Files are cut into byte ranges, one task row each.  A range's task looks for the gzip magic from its first byte
    on; a candidate counts if its first bytes unpack to a WARC head and it unpacks whole, so chance matches inside
    compressed data fall out.  Records that start inside a range belong to it, wherever they end; the next candidate
    is sought from the end of the last record.
    """
    # Rows of ranges are small but each is much work, so their number, not their bytes, makes the tasks.
    tasks = files.select(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start")).repartition(min(int(tasks), MOST_TASKS), "path", "start")

    def records(path, size, start):
        from pyarrow import fs
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as file:
            tail, at, end = Tail(file, start, size), start, min(start + range_bytes, size)
            while at < end:
                tail.drop(at)
                if not tail.fill(at + len(MAGIC)):
                    return
                hit = tail.data.find(MAGIC, at - tail.base)
                if hit < 0:
                    at = max(at + 1, tail.base + len(tail.data) - len(MAGIC) + 1)
                    continue
                at = tail.base + hit
                if at >= end:
                    return
                first = unpacked(tail, at, 5)
                whole = unpacked(tail, at) if first and first[0][:5] == b"WARC/" else None
                record = parsed(whole[0]) if whole else None
                if record is None:
                    at += 1
                    continue
                fields, block = record
                payload = block
                if fields.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                kind, named = fields["warc-type"], fields.get("warc-payload-digest", "")
                said = None
                if kind == "revisit":
                    for line in block.split(b"\r\n"):
                        if line.lower().startswith(b"content-length:"):
                            said = int(line.split(b":")[1])
                yield (kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                       named.removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest(),
                       said if kind == "revisit" else len(payload), None if kind == "revisit" else payload,
                       path, at, whole[1] - at)
                at = whole[1]

    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        made, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for record in records(row["path"], row["bytes"], row["start"]):
                    made.append(record)
                    held += len(record[6] or b"")
                    if len(made) >= 1000 or held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)
                        made, held = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

    return ranges.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page's record, written to a new folder of the shared one and read back.

    Null html is an empty payload; repeated pages give a record each; null page_ids and urls come back null and empty.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    back = read(write(record_types(pages), folder))
    return back.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.when(F.col("record_type") == "revisit", page_of("refers_to_id")).alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISITED} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
