"""Track tables derived from the given parquet tables.

Every view spreads its rows over (track, blk) blocks as described in
``operators.ordered``; positions come from the source where it has them and from
numbering by ranges where it has not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators.ordered import BLOCK, in_blocks, with_blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each piece (128 MB at most) in which the texts are read, at least.
TASKS_PER_SPLIT = 8


def _by_document(texts):
    """Texts hashed on their document, over more tasks than the session names where those would grow with the table."""
    tasks = TASKS_PER_SPLIT * texts.rdd.getNumPartitions()
    if tasks > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return texts.repartition(tasks, "doc_id")
    return texts.repartition("doc_id")


def _lines(spark, sf_dir, separator, in_order=True):
    """Non-blank pieces of each text with place in the text and dense position.

    A track is one row here, so for ordered rules the compact texts are hashed on the track
    before they are split up: every later window and aggregate on the track finds its rows
    in place, and the much larger split rows are not shuffled.  No key can be hot, a key is
    one row.  Rules on single rows take `in_order=False` and move nothing.  The outer explode keeps the optimizer from
    splitting every text once more to look for empty ones.
    """
    numbered = F.transform(F.split("text", separator),
                           lambda t, i: F.struct((i + 1).cast("long").alias("cue_no"), t.alias("text")))
    kept = F.filter(numbered, lambda r: r["text"].rlike(r"\S"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ((_by_document(texts) if in_order else texts)
            .select(F.col("doc_id").alias("track_id"), kept.alias("_kept"))
            .select("track_id", F.size("_kept").alias("length"), F.posexplode_outer("_kept").alias("_p", "_r")).where("_p IS NOT NULL")
            .select("track_id", "length", (F.col("_p") + 1).cast("long").alias("pos"), "_r.cue_no", "_r.text"))


def _blocked(lines):
    return with_blocks(lines, "pos", length="length").drop("length")


def cues_v(spark, sf_dir, in_order=True) -> DataFrame:
    """Document lines as cues of two seconds' spacing."""
    n = F.length("text").cast("long")
    start = (F.col("cue_no") - 1) * 2000
    return _blocked(_lines(spark, sf_dir, "\n", in_order).select(
        "track_id", "length", "pos", "cue_no", start.alias("start_ms"),
        (start + 400 + (n % 13) * 200).alias("end_ms"), "text"))


def raw_cues_v(spark, sf_dir, in_order=True) -> DataFrame:
    """Cues with the faults of a raw file: empty bodies, odd numbers, times out of order."""
    n = F.length("text").cast("long")
    start = (F.col("cue_no") - 1) * 2000 - F.when(n % 499 == 0, 5000).otherwise(0)
    return _blocked(_lines(spark, sf_dir, "\n", in_order).select(
        "track_id", "length", "pos",
        (F.col("pos") + F.when(F.col("pos") % 10 == 0, 1).otherwise(0)).alias("cue_no"),
        start.alias("start_ms"), (start + 400 + (n % 13) * 200).alias("end_ms"),
        F.when(n % 17 == 0, "").otherwise(F.col("text")).alias("text")))


def tokens_v(spark, sf_dir, in_order=True) -> DataFrame:
    """Words as very short cues."""
    return _blocked(_lines(spark, sf_dir, r"[ \n]+", in_order)).drop("cue_no")


def _user_events(spark, sf_dir):
    # field by field, so that the session time zone plays no part
    ts_us = ((F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long") * 86_400
              + F.hour("ts") * 3600 + F.minute("ts") * 60) * 1_000_000
             + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "event_id", ts_us.alias("ts_us"), "event_type", "value")


def numbered_events(spark, sf_dir) -> DataFrame:
    """Events with their position ``n`` in the track and the track's ``length``."""
    return in_blocks(_user_events(spark, sf_dir), ["track_id"], ["ts_us", "event_id"], "n", "length")


def samples_v(spark, sf_dir) -> DataFrame:
    """Events as samples of a picture: text on screen and whether the picture changed."""
    return numbered_events(spark, sf_dir).select(
        "track_id", BLOCK, "n", "ts_us",
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"),
        ((F.col("n") > 1) & (F.floor("value") % 2 == 0)).alias("changed"))


def frames_v(spark, sf_dir) -> DataFrame:
    """Events as decoded frames at four per second with jittered presentation times."""
    return (numbered_events(spark, sf_dir)
            .select("track_id", BLOCK, (F.col("n") - 1).alias("idx"),
                    ((F.col("n") - 1) * 250 + F.floor("value")).alias("pts_ms"),
                    F.lit(4.0).alias("fps"), F.col("length").alias("reported")))


def film_v(spark, sf_dir) -> DataFrame:
    """Frames with the text on them and whether the picture changed."""
    e = numbered_events(spark, sf_dir)
    return e.select("track_id", BLOCK, "n", (F.col("n") - 1).alias("idx"), ((F.col("n") - 1) * 250 + F.floor("value")).alias("pts_ms"),
                    F.lit(4.0).alias("fps"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"),
                    ((F.col("n") > 1) & (F.floor("value") % 2 == 0)).alias("changed"))


def long_frames_v(spark, sf_dir) -> DataFrame:
    """Events of ten users each as frames of one track: tracks of many hundred frames and more."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("track_id"), "ts", "event_id")
    return in_blocks(events, ["track_id"], ["ts", "event_id"], "n", "reported").withColumn("idx", F.col("n") - 1)


def steps_v(spark, sf_dir) -> DataFrame:
    """Events as recognition steps; ``view`` is the blank class."""
    return numbered_events(spark, sf_dir).select(
        F.col("track_id").alias("crop_id"), BLOCK, F.col("n").alias("step"),
        F.col("event_type").alias("class"), (F.col("value") / 500).alias("score"))


def scores_v(spark, sf_dir) -> DataFrame:
    return with_blocks(table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("crop_id"), (F.col("vec_id") + 1).alias("step"),
        F.col("embedding").cast("array<double>").alias("scores")), "step")


def boxes_v(spark, sf_dir) -> DataFrame:
    flag = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("y1"),
        F.col("l_partkey").alias("x1"), F.lit(100.0).alias("height"),
        F.when(F.col("l_linenumber") % 2 == 0, flag).otherwise(F.repeat(flag, 3)).alias("text"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_linenumber").cast("long").alias("line_no"), F.col("l_suppkey").alias("crop_ref"))


def widths_v(spark, sf_dir) -> DataFrame:
    """Crop widths per source, 48 pixels high."""
    return with_blocks(table(spark, sf_dir, "documents").select(
        "source", (F.col("doc_id") + 1).alias("seq"), F.col("n_chars").alias("width"),
        F.lit(48).alias("height")), "seq")


def logs_v(spark, sf_dir) -> DataFrame:
    """Events as output lines of runs, with result markers around key=value lines."""
    e, kind = numbered_events(spark, sf_dir), F.col("event_type")
    line = (F.when(kind == "click", F.concat(F.lit("OCRProgress="), (F.floor(F.col("value") / 5)).cast("string")))
            .when(kind == "view", F.lit("1/2 Native engine"))
            .when(kind == "error", F.concat(F.lit("ERROR: e"), F.col("event_id").cast("string")))
            .when(kind == "signup", F.concat(F.lit("K"), (F.col("event_id") % 5).cast("string"),
                                             F.lit("=v="), F.floor("value").cast("string")))
            .when(F.col("event_id") % 2 == 0, F.lit("--- TRACK PIPELINE 1 RESULT START ---"))
            .otherwise(F.lit("--- TRACK PIPELINE 1 RESULT END ---")))
    return e.select(F.col("track_id").alias("run_id"), BLOCK, F.col("n").alias("line_no"),
                    "ts_us", line.alias("line"))


def assets_v(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "doc_id",
        F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


def manifest_v(spark, sf_dir) -> DataFrame:
    """Expected digests with gaps, wrong digests, upper case, malformed ones and extra paths."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    digest = (F.when(i % 7 == 0, F.sha2(F.concat(F.col("text"), F.lit("x")), 256))
              .when(i % 3 == 0, F.upper(F.sha2("text", 256)))
              .otherwise(F.sha2("text", 256)))
    digest = F.when(i % 11 == 0, F.left(digest, F.lit(60))).otherwise(digest)
    listed = d.where(i % 10 != 0).select(
        F.concat(F.lit("d/"), i.cast("string")).alias("path"), digest.alias("sha256"),
        F.when(i % 13 == 0, 100).otherwise(1 << 20).cast("long").alias("max_bytes"))
    extra = d.where(i % 50 == 0).select(
        F.concat(F.lit("m/"), i.cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"),
        F.lit(1 << 20).cast("long").alias("max_bytes"))
    return listed.unionByName(extra)


def paths_v(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "")
    tail = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".TXT", ".MKV", "")]),
                        (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(bare, tail).alias("path"))


def requests_v(spark, sf_dir) -> DataFrame:
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(role == "user", "clean").when(role == "assistant", "translate")
        .otherwise("system").alias("mode"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("language"),
        F.element_at(F.array(F.lit("light"), F.lit(" strong "), F.lit("extreme"), F.lit(None).cast("string")),
                     (F.col("turn") % 4 + 1).cast("int")).alias("strength"),
        F.repeat("text", 4).alias("guidance"), "text",
        F.when(role == "assistant", F.col("text")).alias("cleaned"))


def runs_v(spark, sf_dir) -> DataFrame:
    """One row per attempt of a run."""
    return (numbered_events(spark, sf_dir)
            .where(F.col("event_type").isin("error", "purchase"))
            .select(F.col("track_id").alias("run_id"), BLOCK, F.col("n").alias("attempt_no"),
                    F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE").alias("status"),
                    F.col("value").alias("seconds"),
                    F.when(F.col("event_type") == "error",
                           F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")))


def altered(boxes: DataFrame) -> DataFrame:
    """Results of another run: some confidences lower, some texts longer."""
    x = F.col("x1")
    return (boxes.withColumn("confidence", F.when(x % 50 == 0, F.col("confidence") - 0.02)
                             .otherwise(F.col("confidence")))
            .withColumn("text", F.when(x % 77 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))))


def telemetry_v(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    line = (F.when(kind == "purchase", F.concat(F.lit("Offloaded "), F.floor(F.col("value") / 10).cast("string"),
                                                F.lit("/65 layers to GPU")))
            .when(kind == "click", F.concat(F.lit("12288, "), F.floor(F.col("value") * 40).cast("string")))
            .otherwise(kind))
    return numbered_events(spark, sf_dir).select(
        F.col("track_id").alias("run_id"), BLOCK, F.col("n").alias("line_no"), line.alias("line"))


def regions_v(spark, sf_dir) -> DataFrame:
    """Four bounds, a profile name and a four-point box from every twelve components of a vector, the last ones included."""
    last = F.size("embedding") - 12
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(12)), F.array(last)))
    windows = table(spark, sf_dir, "embeddings").where(last >= 0).select(
        "vec_id", "label", F.size(starts).alias("windows"),
        F.posexplode(F.transform(starts, lambda s: F.transform(F.slice("embedding", s + 1, 12), lambda x: F.abs(x.cast("double")))))
        .alias("part", "e"))
    names = F.array(*[F.lit(x) for x in ("bottom", "lower-half", "full", "custom", "unknown")])
    return windows.select(
        (F.col("vec_id") * F.col("windows") + F.col("part")).alias("region_id"), F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("profile"),
        *[F.round(F.col("e")[i] * 3, 6).alias(n) for i, n in enumerate(("top", "bottom", "left", "right"))],
        F.transform(F.slice("e", 5, 4), lambda v: F.round(v * 400, 3)).alias("xs"),
        F.transform(F.slice("e", 9, 4), lambda v: F.round(v * 400, 3)).alias("ys"))


def responses_v(spark, sf_dir) -> DataFrame:
    """A reply per chunk of twelve cues, with one fault in most of them."""
    from cuelake.operators.planning import context_window
    chunks = context_window(cues_v(spark, sf_dir), "clean").select("track_id", "chunk_no", "targets")
    fault, t = F.pmod(F.col("track_id") + F.col("chunk_no"), F.lit(8)), F.col("targets")
    size = F.size(t)
    blank_first = F.transform(t, lambda c, i: F.struct(
        c["id"].alias("id"), F.when(i == 0, "").otherwise(c["text"]).alias("text")))
    extra = F.array(F.struct(F.lit(99999).cast("long").alias("id"), F.lit("extra").alias("text")))
    cues = (F.when(fault == 0, F.slice(t, F.lit(1), size - 1))
            .when(fault == 1, F.concat(F.slice(t, 1, 1), t))
            .when((fault == 2) & (size > 1),
                  F.concat(F.slice(t, 2, 1), F.slice(t, 1, 1), F.slice(t, F.lit(3), F.greatest(size - 2, F.lit(0)))))
            .when(fault == 3, blank_first)
            .when(fault == 4, F.concat(t, extra)).otherwise(t))
    failed = fault == 7
    return chunks.select("track_id", "chunk_no", F.when(~failed, F.to_json(cues)).alias("raw"),
                         F.when(failed, "Local AI request failed: closed").alias("error"))


def decisions_v(spark, sf_dir) -> DataFrame:
    """A decision per cue: removed, edited or kept by the length of its text."""
    n = F.length("text")
    return cues_v(spark, sf_dir).select(
        "track_id", "pos",
        F.when(n % 7 == 0, " ").when(n % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))


def cue_texts_v(spark, sf_dir) -> DataFrame:
    """Texts to save as cue files: some with CRLF, some without a time line, some empty."""
    i = F.col("doc_id")
    text = F.when(i % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    text = F.concat(F.when(i % 3 == 0, "").otherwise("00:00:01,000 --> 00:00:02,000\n"), text)
    return table(spark, sf_dir, "documents").select(
        i.alias("track_id"), F.when(i % 17 == 0, "").otherwise(text).alias("content"))


def stream_samples_v(spark, sf_dir) -> DataFrame:
    """Samples at four per second with jittered times, as they would arrive."""
    return numbered_events(spark, sf_dir).select(
        "track_id", "n", ((F.col("n") - 1) * 250 + F.floor("value")).cast("double").alias("pts_ms"),
        F.lit(4.0).alias("fps"), ((F.col("n") > 1) & (F.floor("value") % 2 == 0)).alias("changed"), "ts_us")
