"""Cue tables to file text.

A track's file comes as rows (track_id, part_no, content) of at most ``part_cues``
cues; the parts of a track, in order, are the file.  Usual tracks have one part.
Cues need ``pos`` counting from 1 without gaps (``quality.renumber`` gives it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake import fixed
from cuelake.functions.timecode import format_ms
from cuelake.operators.ordered import lead, scan
from cuelake.operators.recognise import PART_ROWS, join_in_order

LF = "\n"


def line_endings(content):
    return F.regexp_replace(content, "\r\n?", LF)


def _file(cues: DataFrame, block, part_cues: int) -> DataFrame:
    return join_in_order(cues.withColumn("block", block), ["track_id"], "pos", "block", "", "content", part_cues)


def export_srt(cues: DataFrame, minimum_ms: int = 0, part_cues: int = PART_ROWS) -> DataFrame:
    """Numbered blocks, each followed by a blank line."""
    end = F.greatest(F.col("start_ms") + minimum_ms, F.col("end_ms"))
    block = F.concat(F.col("pos").cast("string"), F.lit(LF), format_ms(F.col("start_ms")),
                     F.lit(fixed.ARROW), format_ms(end), F.lit(LF), F.col("text"), F.lit(LF + LF))
    return _file(cues, block, part_cues)


def export_txt(cues: DataFrame, part_cues: int = PART_ROWS) -> DataFrame:
    return _file(cues, F.concat(F.replace("text", F.lit(LF), F.lit(" ")), F.lit(LF)), part_cues)


def export_md(cues: DataFrame, part_cues: int = PART_ROWS) -> DataFrame:
    block = F.concat(F.lit("## "), format_ms(F.col("start_ms")), F.lit(" → "), format_ms(F.col("end_ms")),
                     F.lit(LF + LF), F.replace("text", F.lit(LF), F.lit("  " + LF)), F.lit(LF + LF))
    return _file(cues, F.concat(F.when(F.col("pos") == 1, "# Subtitles\n\n").otherwise(""), block), part_cues)


def escape_xml(text):
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(raw), F.lit(f"&{name};"))
    return text


def export_ttml(cues: DataFrame, part_cues: int = PART_ROWS) -> DataFrame:
    """The head goes before the first cue, the tail after the last one (needs ``blk``)."""
    def time(name):
        return F.replace(format_ms(F.col(name)), F.lit(","), F.lit("."))
    block = F.concat(F.lit('  <p begin="'), time("start_ms"), F.lit('" end="'), time("end_ms"), F.lit('">'),
                     F.replace(escape_xml(F.col("text")), F.lit(LF), F.lit("<br/>")), F.lit("</p>\n"))
    ends = scan(cues, ["track_id"], ["pos"], following=lead(F.col("pos")))
    return _file(ends, F.concat(F.when(F.col("pos") == 1, fixed.TTML_HEAD).otherwise(""), block,
                                F.when(F.col("following").isNull(), fixed.TTML_TAIL).otherwise("")), part_cues)


def export_filename(path, mode, language, fmt):
    """``stem-cleaned-ai.srt``, ``stem-<language>-ai.srt`` or ``stem.srt`` from any path.

    A worked-over track loses any extension, an original only that of a cue file: ``clip.v2`` stays ``clip.v2.srt``.
    """
    base = F.regexp_extract(path, r"([^\\/]+)[\\/]*$", 1)
    name = F.when(base == "", path).otherwise(base)
    stem = (F.when(mode.isin("clean", "translate"), F.regexp_replace(name, r"\.[^.]+$", ""))
            .otherwise(F.regexp_replace(name, rf"(?i)\.({'|'.join(fixed.EXPORT_EXTENSIONS)})$", "")))
    stem = F.when(stem == "", "subtitles").otherwise(stem)
    suffix = (F.when(mode == "clean", "-cleaned-ai")
              .when(mode == "translate", F.concat(F.lit("-"), F.lower(language), F.lit("-ai")))
              .otherwise(""))
    return F.concat(stem, suffix, F.lit("."), fmt)


def base_name(path):
    """Last named part of a path, empty where there is none."""
    return F.coalesce(F.regexp_extract(path, r"([^\\/]+)[\\/]*$", 1), F.lit(""))


def handoff_name(result_path, video_path):
    """Name under which a finished track goes on to cleaning: that of its file, else the video's with ``.srt``."""
    stem = F.regexp_replace(base_name(video_path), r"\.[^.]+$", "")
    own = base_name(result_path)
    return F.when(own != "", own).otherwise(F.concat(F.when(stem == "", "subtitles").otherwise(stem), F.lit(".srt")))


def srt_for_save(files: DataFrame) -> DataFrame:
    """LF line ends and one final LF; ``reason`` says why a file cannot be saved."""
    reason = (F.when((F.octet_length("content") == 0)
                     | (F.octet_length("content") > fixed.MAX_CUE_FILE_BYTES), "SIZE")
              .when(~F.contains("content", F.lit(fixed.ARROW)), "NO_TIMECODE"))
    text = line_endings(F.col("content"))
    saved = F.when(F.endswith(text, F.lit(LF)), text).otherwise(F.concat(text, F.lit(LF)))
    return (files.withColumn("reason", reason)
            .withColumn("saved", F.when(F.col("reason").isNull(), saved)))


def export_verbatim(files: DataFrame) -> DataFrame:
    """Unedited text keeps its bytes once it passes the save check."""
    return srt_for_save(files).withColumn("saved", F.when(F.col("reason").isNull(), F.col("content")))
