"""Reading and writing cue files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake import fixed
from cuelake.functions.text import BLANK_CHARS, strip, strip_body
from cuelake.functions.timecode import parse_ms
from cuelake.operators.export import line_endings, srt_for_save
from cuelake.operators.ordered import with_blocks

HEADER = rf"(?m)^[ \t]*(\d+)[ \t]*\r?\n({fixed.CUE_TIME}) --> ({fixed.CUE_TIME})[ \t]*\r?\n"


def subtitle_file_guard(files: DataFrame) -> DataFrame:
    """Adds ``reason`` (null for usable files) and ``text``."""
    reason = (F.when(~F.lower("path").rlike(r"\.srt$"), "EXTENSION")
              .when((F.col("size") == 0) | (F.col("size") > fixed.MAX_CUE_FILE_BYTES), "SIZE")
              .when(~F.is_valid_utf8(F.col("content").cast("string")), "UTF8")
              .when(~F.contains(F.col("content").cast("string"), F.lit(fixed.ARROW)), "NO_TIMECODE"))
    return (files.withColumn("reason", reason)
            .withColumn("text", F.when(F.col("reason").isNull(), F.col("content").cast("string"))))


def video_path_filter(paths: DataFrame) -> DataFrame:
    return paths.where(F.lower("path").rlike(r"\.(" + "|".join(fixed.VIDEO_EXTENSIONS) + ")$"))


def source_changed_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources whose size or time differ between two listings (``path, size, mtime``)."""
    same = (F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime")))
    return (before.alias("a").join(after.alias("b"), F.col("a.path") == F.col("b.path"), "full_outer")
            .select(F.coalesce("a.path", "b.path").alias("path"), (~same).alias("changed")))


def _with_facts(parts: DataFrame, facts, defaults: dict) -> DataFrame:
    """Adds what a part must know of the other parts of its file: ``facts`` (a function of one small row per part).

    ``facts`` gives ``track_id, part_no`` and the columns of ``defaults``, which hold for a file of one part.
    """
    if "part_no" not in parts.columns:
        return parts.withColumns({"part_no": F.lit(0).cast("long"), **{c: F.lit(v) for c, v in defaults.items()}})
    known = facts(parts).select(F.col("track_id").alias("_t"), F.col("part_no").alias("_n"),
                                *[F.col(c).alias(f"_{c}") for c in defaults])
    return (parts.join(known, F.col("track_id").eqNullSafe(F.col("_t")) & (F.col("part_no") == F.col("_n")), "left")
            .withColumns({c: F.coalesce(f"_{c}", F.lit(v)) for c, v in defaults.items()})
            .drop("_t", "_n", *[f"_{c}" for c in defaults]))


def _strict_facts(parts):
    """Cues of earlier parts, whether part 0 opens a valid file, and text that later parts add to a part's last cue."""
    file, before = Window.partitionBy("track_id"), Window.partitionBy("track_id").orderBy("part_no").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = (parts.select("track_id", "part_no", (F.size("pieces") - 1).cast("long").alias("n"), "opens",
                         F.when(F.col("part_no") > 0, F.col("pieces")[0]).alias("head"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("valid", F.bool_or((F.col("part_no") == 0) & F.col("opens")).over(file))
            .withColumn("_n", F.max(F.when(F.col("n") > 0, F.col("part_no"))).over(before)))
    tails = (rows.where("head <> ''").groupBy(F.col("track_id").alias("_t"), "_n")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "head"))), lambda r: r["head"]), "").alias("tail")))
    return (rows.drop("_n").join(tails, F.col("track_id").eqNullSafe(F.col("_t")) & (F.col("part_no") == F.col("_n")), "left")
            .select("track_id", "part_no", "before", "valid", "tail").where("part_no > 0 OR tail IS NOT NULL"))


def srt_parse_strict(files: DataFrame) -> DataFrame:
    """Cues of numbered files; a file that is not one gives a row with status INVALID_FORMAT.

    Needs ``track_id, content``; with ``part_no`` as well, the parts of a track from 0 on, cut anywhere but inside a
    number and time line, are one file.  Cues carry ``status`` OK or INVALID_TIMECODE.
    """
    pieces = F.split("content", HEADER)
    fields = [F.regexp_extract_all("content", F.lit(HEADER), F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*[f.alias(n) for f, n in zip(fields, ("no", "start", "end"))]),
                       lambda r, i: F.struct(r["no"].alias("no"), r["start"].alias("start"),
                                             r["end"].alias("end"), F.get("pieces", i + 1).alias("body")))
    first = F.col("part_no") == 0 if "part_no" in files.columns else F.lit(True)
    parts = (files.withColumn("content", F.when(first, F.regexp_replace("content", "^\\x{FEFF}", "")).otherwise(F.col("content")))
             .withColumn("pieces", pieces).withColumn("opens", (F.size("pieces") > 1) & (strip_body(F.col("pieces")[0]) == "")))
    opened = F.when(F.col("part_no") > 0, F.col("valid")).otherwise(F.col("opens"))
    parsed = (_with_facts(parts, _strict_facts, {"before": 0, "valid": False, "tail": ""}).withColumn("valid", opened)
              .where("part_no = 0 OR (valid AND size(pieces) > 1)")
              .withColumn("pieces", F.transform("pieces", lambda x, i: F.when(i == F.size("pieces") - 1, F.concat(x, "tail")).otherwise(x)))
              .select("track_id", "before", "valid", F.posexplode_outer(F.when(F.col("valid"), rows)).alias("_p", "r")))
    start, end = parse_ms(F.col("r.start")), parse_ms(F.col("r.end"))
    return with_blocks(
        parsed.select("track_id", (F.col("before") + F.coalesce(F.col("_p") + 1, F.lit(1))).cast("long").alias("pos"),
                      F.col("r.no").try_cast("long").alias("cue_no"), start.alias("start_ms"),
                      end.alias("end_ms"), strip_body(F.col("r.body")).alias("text"),
                      F.when(~F.col("valid"), "INVALID_FORMAT")
                      .when(start.isNull() | end.isNull(), "INVALID_TIMECODE").otherwise("OK").alias("status")),
        "pos")


def _whole_blocks(text):
    """Blocks of a part that others follow: the blank rest behind its last separator is none."""
    blocks = F.split(text, "\n\n")
    return F.when(strip(F.element_at(blocks, -1)) == "", F.slice(blocks, F.lit(1), F.size(blocks) - 1)).otherwise(blocks)


def _lenient_facts(parts):
    """Blocks of earlier parts, whether parts follow, and whether the whole file may be read."""
    file, ordered = Window.partitionBy("track_id"), Window.partitionBy("track_id").orderBy("part_no")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select("track_id", "part_no", F.size(_whole_blocks(F.col("text"))).cast("long").alias("n"),
                        F.octet_length("content").cast("long").alias("size"), F.contains("content", F.lit(fixed.ARROW)).alias("timed"))
    size = F.sum("size").over(file)
    return rows.select("track_id", "part_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                       F.lead("part_no").over(ordered).isNotNull().alias("more"),
                       ((size > 0) & (size <= fixed.MAX_CUE_FILE_BYTES) & F.bool_or("timed").over(file)).alias("usable")
                       ).where("part_no > 0 OR more")


def srt_parse_lenient(files: DataFrame) -> DataFrame:
    """Blocks separated by a blank line; times stay text.  ``status`` NO_TIMECODE marks bad blocks.

    With ``part_no``, the parts of a track from 0 on, cut after a blank line, are one file.
    """
    text, end = line_endings(F.col("content")), F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    opened = F.ltrim(text, F.lit(BLANK_CHARS))
    if "part_no" in files.columns:
        opened = F.when(F.col("part_no") == 0, opened).otherwise(text)
    known = _with_facts(srt_for_save(files).withColumn("text", opened), _lenient_facts, {"before": 0, "more": False, "usable": None})
    saved = (known.where(F.coalesce("usable", F.col("reason").isNull())).where(F.col("more") | (F.col("part_no") == 0) | (end != ""))
             .withColumn("blocks", F.when(F.col("more"), _whole_blocks(F.col("text"))).otherwise(F.split(end, "\n\n"))))
    lines = F.split("block", "\n")
    at = F.expr("array_position(transform(lines, x -> contains(x, ' --> ')), true)").cast("int")
    return (saved.select("track_id", "before", F.posexplode("blocks").alias("_p", "block"))
            .withColumn("lines", lines).withColumn("at", at)
            .withColumn("time", F.when(F.col("at") > 0, F.get("lines", F.col("at") - 1)))
            .select("track_id", (F.col("before") + F.col("_p") + 1).cast("long").alias("pos"),
                    F.split("time", fixed.ARROW, 2)[0].alias("start"),
                    F.get(F.split("time", fixed.ARROW, 2), F.lit(1)).alias("end"),
                    F.expr("if(at > 0, slice(lines, at + 1, size(lines)), array())").alias("lines"),
                    F.when(F.col("at") > 0, "OK").otherwise("NO_TIMECODE").alias("status")))
