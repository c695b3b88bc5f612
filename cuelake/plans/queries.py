"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuelake import fixed
from cuelake.functions import text as X
from cuelake.functions import timecode
from cuelake.operators import (cues, export, integrity, planning, quality, recognise, regions, responses,
                               runs, sampling)
from cuelake.operators.ordered import BLOCK, div, numbered
from cuelake.plans.cut import durable, shared_folder
from cuelake.sources import cuefiles, cuestore
from cuelake.sources import tables as V
from cuelake.streaming import tracks
from cuelake.streaming.replay import replay

SIX_HOURS_US = 6 * 3_600_000_000
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Sources and sinks

def _srt_files(s, d):
    return export.export_srt(V.cues_v(s, d))


@query
def srt_parse_strict(s, d):
    return cuefiles.srt_parse_strict(_srt_files(s, d)).select(
        "track_id", "cue_no", "start_ms", "end_ms", "text", "status")


@query
def srt_parse_lenient(s, d):
    return cuefiles.srt_parse_lenient(_srt_files(s, d)).select(
        "track_id", "pos", "start", "end", F.array_join("lines", "\n").alias("text"), "status")


@query
def subtitle_file_guard(s, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("d/"), i.cast("string"), F.when(i % 5 == 0, ".txt").otherwise(".SRT"))
    content = (F.when(i % 7 == 0, F.unhex(F.lit("")))
               .when(i % 3 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("202D2D3E20FF"))))
               .when(i % 2 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("202D2D3E20"))))
               .otherwise(F.encode("text", "UTF-8")))
    files = V.table(s, d, "documents").select(path.alias("path"), content.alias("content")).withColumn(
        "size", F.octet_length("content").cast("long"))
    return cuefiles.subtitle_file_guard(files).select("path", "size", "reason")


@query
def cue_files(s, d):
    """Tracks written as files, some of them faulty, read again, checked and normalised; one row per file."""
    i = F.col("track_id")
    content = (F.when(i % 13 == 0, "").when(i % 7 == 0, F.concat(F.lit("no cue\n"), "content"))
               .when(i % 5 == 0, F.regexp_replace("content", r"^(?<head>\d+\n\d+:)\d\d", "${head}61")).otherwise(F.col("content")))
    # Ten seconds on, so that no time of the raw cues lies before the start of the file.
    later = V.raw_cues_v(s, d).withColumns({c: F.col(c) + 10_000 for c in ("start_ms", "end_ms")})
    parts = export.export_srt(later).withColumn("content", F.when(F.col("part_no") == 0, content).otherwise(F.when(i % 13 != 0, F.col("content")).otherwise("")))
    folder = f"{shared_folder(s)}/cue-files-{uuid.uuid4().hex}"
    cuestore.write_cue_files(parts, folder, F.concat(i.cast("string"), F.when(i % 11 == 0, ".txt").otherwise(".srt")), folders=True)
    name = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long")
    # Listed and read once; the rules below state their rows many times.
    files = durable(cuefiles.subtitle_file_guard(cuestore.read_cue_files(s, folder)).select(name.alias("track_id"), "reason", F.col("text").alias("content")))
    tracks = quality.normalize_track(cuefiles.srt_parse_strict(files.where("reason IS NULL").drop("reason")))
    refused = files.where("reason IS NOT NULL").select("track_id", F.col("reason").alias("status"))
    return tracks.unionByName(refused, allowMissingColumns=True)


@query
def video_path_filter(s, d):
    return cuefiles.video_path_filter(V.paths_v(s, d))


@query
def source_changed_check(s, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("d/"), i.cast("string"))
    docs = V.table(s, d, "documents")
    before = docs.select(path.alias("path"), F.col("n_chars").alias("size"),
                         F.when(i % 11 != 0, i).alias("mtime"))
    after = docs.where(i % 13 != 0).select(
        path.alias("path"), (F.col("n_chars") + F.when(i % 9 == 0, 1).otherwise(0)).alias("size"),
        F.when(i % 11 != 0, i + F.when(i % 19 == 0, 5).otherwise(0)).alias("mtime"))
    return cuefiles.source_changed_check(before, after)


@query
def export_srt(s, d):
    return export.export_srt(V.cues_v(s, d), minimum_ms=1000)


@query
def export_txt(s, d):
    return export.export_txt(V.cues_v(s, d))


@query
def export_md(s, d):
    return export.export_md(V.cues_v(s, d))


@query
def export_ttml(s, d):
    return export.export_ttml(V.cues_v(s, d))


@query
def export_filename(s, d):
    i = F.col("page_id")
    mode = F.when(i % 3 == 0, "clean").when(i % 3 == 1, "translate").otherwise("original")
    return V.paths_v(s, d).select("page_id", export.export_filename(
        F.col("path"), mode, F.lit("German"), F.lit("srt")).alias("filename"),
        export.handoff_name(F.when(i % 5 != 0, F.concat("path", F.lit(".srt"))), F.col("path")).alias("handoff"))


@query
def srt_for_save(s, d):
    return export.srt_for_save(V.cue_texts_v(s, d)).drop("content")


@query
def export_verbatim(s, d):
    return export.export_verbatim(V.cue_texts_v(s, d)).drop("content")


# Regions, sampling and time repair

@query
def region_validate(s, d):
    return regions.region_validate(V.regions_v(s, d)).drop("xs", "ys", "profile")


@query
def region_resolve(s, d):
    return (regions.region_resolve(V.regions_v(s, d), 1920, 1080)
            .select("region_id", "profile", "reason", "x1", "x2", "y1", "y2"))


@query
def region_box_filter(s, d):
    r = V.regions_v(s, d)
    boxes = r.select("region_id", F.array_min("xs").alias("bx1"), F.array_max("xs").alias("bx2"),
                     F.array_min("ys").alias("by1"), F.array_max("ys").alias("by2"))
    return (regions.region_box_filter(boxes, regions.region_resolve(r, 400, 400), "region_id")
            .select("region_id", *[F.round(c, 3).alias(c) for c in ("cx1", "cx2", "cy1", "cy2")]))


@query
def region_frame_map(s, d):
    def pick(*sizes):
        return F.element_at(F.array(*[F.lit(float(v)) for v in sizes]), (F.col("region_id") % 4 + 1).cast("int"))
    boxes = V.regions_v(s, d).select(
        "region_id", F.col("top").alias("x"), F.col("bottom").alias("y"), F.col("left").alias("w"),
        F.col("right").alias("h"), pick(1920, 1080, 640, 0).alias("video_width"),
        pick(1080, 1920, 480, 0).alias("video_height"))
    return regions.region_frame_map(boxes, 400.0, 400.0).select(
        "region_id", *[F.round(c, 10).alias(c) for c in ("out_x", "out_y", "out_w", "out_h")])


@query
def stride_sample(s, d):
    return sampling.stride_sample(V.frames_v(s, d)).select("track_id", "idx", "pts_ms")


@query
def pts_repair(s, d):
    return sampling.pts_repair(sampling.stride_sample(V.frames_v(s, d))).select(
        "track_id", "idx", "ts_us", "repaired")


@query
def decoded_high_water(s, d):
    return sampling.decoded_high_water(V.frames_v(s, d))


@query
def track_duration(s, d):
    frames = V.frames_v(s, d)
    return sampling.track_duration(frames, sampling.pts_repair(sampling.stride_sample(frames)))


def _thumbnails(s, d):
    gray = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 800) % 256).cast("int"))
    return V.with_blocks(V.table(s, d, "embeddings").select(
        F.col("label").cast("long").alias("track_id"), (F.col("vec_id") + 1).alias("n"), gray.alias("gray"),
        F.lit(8).alias("height"), F.lit(8).alias("width")), "n")


@query
def frame_change_gate(s, d):
    return sampling.frame_change_gate(_thumbnails(s, d)).select("track_id", "n", "changed")


@query
def signal_shift_gate(s, d):
    return sampling.signal_shift_gate(V.scores_v(s, d), threshold=32.0, share=0.35, shift=2.0, scale=255.0)


@query
def thumbnail_downsample(s, d):
    """Texts as one-channel pictures 400 pixels wide."""
    height = div(F.length("text") + 399, 400)
    padded = F.expr("rpad(text, cast(height * 400 as int), ' ')")
    images = (V.table(s, d, "documents").select("doc_id", "text").withColumn("height", height)
              .select("doc_id", "height", F.lit(400).alias("width"), F.lit(1).alias("channels"),
                      F.transform(F.split(padded, ""), lambda c: F.ascii(c) % 256).alias("pixels")))
    return sampling.thumbnail_downsample(images).select(
        "doc_id", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"),
        F.aggregate("gray", F.lit(0).cast("long"), lambda a, v: a + v).alias("gray_sum"),
        F.element_at("gray", -1).cast("long").alias("last_pixel"))


def _gated(s, d):
    return sampling.ocr_interval_gate(V.samples_v(s, d), SIX_HOURS_US)


@query
def ocr_interval_gate(s, d):
    return _gated(s, d).select("track_id", "n", "kept")


@query
def gate_metrics(s, d):
    return sampling.gate_metrics(sampling.gate_context(durable(_gated(s, d))), SIX_HOURS_US)


# Recognition post-processing

@query
def box_expand_filter(s, d):
    boxes = V.regions_v(s, d).select("region_id", "xs", "ys", (F.col("top") * 2).alias("score"))
    return recognise.box_expand_filter(boxes, (160, 160), (640, 480)).select("region_id", "x1", "x2", "y1", "y2")


@query
def score_normalise(s, d):
    return (recognise.score_normalise(V.scores_v(s, d))
            .select("crop_id", "step", F.posexplode("scores").alias("class", "score"))
            .select("crop_id", "step", F.col("class").cast("long").alias("class"), F.round("score", 6).alias("score")))


@query
def step_argmax(s, d):
    return recognise.step_argmax(V.scores_v(s, d)).select("crop_id", "step", "class", F.round("score", 6).alias("score"))


@query
def ctc_collapse(s, d):
    return recognise.ctc_collapse(V.steps_v(s, d), "view").withColumn("confidence", F.round("confidence", 6))


@query
def dictionary_decode(s, d):
    symbols = (V.table(s, d, "events").select(F.col("event_type").alias("class")).distinct()
               .where("class <> 'signup'").withColumn("symbol", F.upper("class")))
    found, lost = recognise.dictionary_decode(V.steps_v(s, d), symbols)
    return found.select("crop_id", "step", "symbol").unionByName(lost.select("crop_id", "step", "symbol"))


@query
def confidence_filter(s, d):
    return recognise.confidence_filter(V.boxes_v(s, d)).select(
        "frame", "x1", "y1", "text", F.round("confidence", 4).alias("confidence"))


@query
def reading_order(s, d):
    return recognise.reading_order(V.boxes_v(s, d).withColumn("seq", F.col("text")))


def _packed(s, d):
    return recognise.length_bucket_pack(V.widths_v(s, d))


@query
def length_bucket_pack(s, d):
    return _packed(s, d)


@query
def batch_histogram(s, d):
    return recognise.batch_histogram(_packed(s, d))


@query
def frame_batch_plan(s, d):
    frames = V.boxes_v(s, d).groupBy("frame").agg(F.count(F.lit(1)).alias("crops")).select(
        (F.col("frame") % 10).alias("track_id"), "frame", "crops")
    return recognise.frame_batch_plan(frames)


@query
def decision_parity(s, d):
    """Rows are numbered once, so that each meets its own altered form whatever the alteration."""
    rows = numbered(V.boxes_v(s, d), ["frame"], ["x1", "crop_ref", "line_no", "y1", "text", "confidence"], "seq")
    return recognise.decision_parity(rows, V.altered(rows), "frame", "seq")


# Events to cues

@query
def text_key(s, d):
    return V.cues_v(s, d, False).select("track_id", "pos", X.text_key(F.col("text")).alias("key"))


def _events(s, d):
    return cues.transition_backdate(sampling.gate_context(durable(_gated(s, d))))


@query
def transition_backdate(s, d):
    return _events(s, d).select("track_id", "n", "event_us", "text", "backdated")


@query
def event_intervals(s, d):
    return cues.event_intervals(_events(s, d)).where("text <> ''").select("track_id", "n", "event_us", "end_us")


@query
def cue_build(s, d):
    return cues.cue_build(cues.event_intervals(_events(s, d)))


@query
def track_cues(s, d):
    """From frames to cues: repaired times, the gate, backdating, and each track's own end."""
    film = V.film_v(s, d)
    timed = durable(sampling.pts_repair(film))
    samples = timed.select("track_id", BLOCK, "idx", "ts_us").join(film.select("track_id", "idx", "n", "text", "changed"), ["track_id", "idx"])
    context = sampling.gate_context(durable(sampling.ocr_interval_gate(samples, 1_000_000)))
    events = cues.transition_backdate(context)
    return cues.cue_build(cues.event_intervals(events, durations=sampling.track_duration(film, timed)))


@query
def timestamp_format(s, d):
    return V.table(s, d, "events").select("event_id", timecode.format_ms(
        timecode.seconds_to_ms(F.col("value") * 10 - 50)).alias("code"))


@query
def timestamp_parse(s, d):
    """Codes from the times of events, some with minutes or seconds of sixty and more, a wrong mark or too few digits."""
    def two(v):
        return F.lpad(v.cast("string"), 2, "0")
    kind, ts = F.floor("value").cast("long"), F.col("ts")
    minute = F.minute(ts) + F.when(kind % 5 == 0, 30).otherwise(0)
    second = F.second(ts) + F.when(kind % 7 == 0, 30).otherwise(0)
    code = F.concat(two(F.hour(ts) + kind % 70), F.lit(":"), two(minute), F.lit(":"), two(second), F.when(kind % 11 == 0, ".").otherwise(","),
                    F.lpad((F.floor(F.col("value") * 100).cast("long") % 1000).cast("string"), 3, "0"))
    return V.table(s, d, "events").select("event_id", timecode.parse_ms(F.when(kind % 13 == 0, F.left(code, F.length(code) - 1)).otherwise(code)).alias("ms"))


# Track normalisation and quality

@query
def track_validate(s, d):
    return quality.track_validate(V.raw_cues_v(s, d))


@query
def overlap_count(s, d):
    return quality.overlap_count(V.raw_cues_v(s, d))


@query
def renumber(s, d):
    kept = quality.drop_empty(V.raw_cues_v(s, d))
    return quality.renumber(kept).select("track_id", "pos", "cue_no", "new_no",
                                         (F.col("cue_no") != F.col("new_no")).alias("renumbered"))


@query
def drop_empty(s, d):
    return quality.drop_empty(V.raw_cues_v(s, d, False)).select("track_id", "pos", "text")


@query
def body_normalise(s, d):
    return quality.body_normalise(V.cues_v(s, d, False)).select("track_id", "pos", "body", "norm")


def _merged(s, d):
    return quality.duplicate_merge(quality.body_normalise(V.cues_v(s, d)))


@query
def duplicate_merge(s, d):
    return _merged(s, d).select("track_id", "cue_pos", "start_ms", "end_ms", "body", "parts")


@query
def quality_stats(s, d):
    return quality.quality_stats(_merged(s, d))


@query
def quality_label(s, d):
    return quality.quality_label(quality.quality_stats(_merged(s, d))).select("track_id", "quality")


@query
def normalize_track(s, d):
    return quality.normalize_track(V.raw_cues_v(s, d))


@query
def normalize_cues(s, d):
    return quality.normalize_cues(V.raw_cues_v(s, d))


# Planning

@query
def cue_shape(s, d):
    return planning.cue_shape(V.tokens_v(s, d, False)).groupBy("track_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("visible", "alphabetic", "numeric")])


@query
def weak_fragment(s, d):
    return planning.weak_fragment(V.tokens_v(s, d, False)).where("weak").select("track_id", "pos", "text")


@query
def strong_prefilter(s, d):
    return planning.strong_prefilter(V.tokens_v(s, d)).where("remove").select("track_id", "pos", "text")


@query
def needs_translation(s, d):
    return planning.needs_translation(V.tokens_v(s, d, False)).where(~F.col("needed")).select("track_id", "pos", "text")


@query
def chunk_assign(s, d):
    return planning.chunk_assign(V.cues_v(s, d, False), "translate").select("track_id", "pos", "chunk_no")


def _chunk_texts(name):
    return F.array_join(F.transform(name, lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["text"])), "|").alias(name)


@query
def context_window(s, d):
    return planning.context_window(V.cues_v(s, d), "clean").select(
        "track_id", "chunk_no", *[_chunk_texts(c) for c in ("targets", "before", "after")])


@query
def document_samples(s, d):
    return planning.document_samples(V.cues_v(s, d))


@query
def task_options(s, d):
    return planning.task_options(V.requests_v(s, d)).select(
        "conv_id", "turn", "reason", "language_text", "strength_text", "guidance_text")


@query
def source_select(s, d):
    r = V.requests_v(s, d)
    cleaned = r.where((F.col("cleaned").isNotNull()) & (F.col("turn") % 3 != 0)).select(
        "conv_id", "turn", F.concat(F.lit("c:"), "cleaned").alias("text"))
    return planning.source_select(r.drop("cleaned"), cleaned, ["conv_id", "turn"], True).select(
        "conv_id", "turn", "source", "input")


@query
def prompt_rows(s, d):
    return planning.prompt_rows(V.cues_v(s, d), "clean").drop("prompt")


@query
def prompt_text(s, d):
    """Whole prompts of a translation."""
    return planning.prompt_rows(V.cues_v(s, d), "translate", language="German", guidance="short").select(
        "track_id", "chunk_no", "prompt")


@query
def response_schema(s, d):
    return planning.response_schema(planning.context_window(V.cues_v(s, d), "clean"))


@query
def work_split(s, d):
    return planning.chunk_work(planning.work_split(V.tokens_v(s, d), "clean", "strong"))


# Replies, retries, results

@query
def assistant_extract(s, d):
    raw = F.concat(F.lit("User:\n"), "text", F.lit("\n\nAssistant:\n"),
                   F.when(F.col("turn") % 2 == 0, F.lit("<think>hm</think>\n ")).otherwise(""), "text", F.lit(" \n"))
    return V.table(s, d, "conversations").select("conv_id", "turn", responses.assistant_extract(raw).alias("answer"))


@query
def json_repair(s, d):
    """Replies framed by thinking, cut before the last bracket, followed by chat, or cut short."""
    chunks = planning.context_window(V.cues_v(s, d), "clean")
    fault, raw = F.pmod(F.col("track_id") + F.col("chunk_no"), F.lit(5)), F.to_json("targets")
    messy = (F.when(fault == 0, F.concat(F.lit("<think>[1]</think>\n"), raw))
             .when(fault == 1, F.regexp_replace(raw, r"\]$", ", "))
             .when(fault == 2, F.concat(raw, F.lit(" Done.")))
             .when(fault == 3, F.regexp_replace(raw, r"\},\{\"id\"", ',"id"')).otherwise(raw))
    return (chunks.select("track_id", "chunk_no", responses.json_repair(messy).alias("cues"))
            .select("track_id", "chunk_no", F.explode_outer("cues").alias("c")).where("c IS NOT NULL").select("track_id", "chunk_no", "c.id", "c.text"))


@query
def response_explode(s, d):
    return responses.response_explode(V.responses_v(s, d))


def _verdicts(s, d, allow_empty):
    return responses.target_validate(V.responses_v(s, d), planning.context_window(V.cues_v(s, d), "clean"), allow_empty)


@query
def target_validate(s, d):
    return _verdicts(s, d, False).select("track_id", "chunk_no", "verdict")


@query
def single_parse(s, d):
    """Conversation texts as answers to one cue, some removed, fenced, echoed or in JSON."""
    i, t = F.col("conv_id") + F.col("turn"), F.col("text")
    listed = F.to_json(F.struct((F.col("conv_id") + F.when(i % 16 == 5, 1).otherwise(0)).alias("id"), t.alias("text")))
    raw = (F.when(i % 8 == 0, "[[REMOVE]]").when(i % 8 == 1, F.concat(F.lit("```"), t))
           .when(i % 8 == 2, F.concat(F.lit("Subtitle:\n"), t)).when(i % 8 == 3, "")
           .when(i % 8 == 5, listed).when(i % 8 == 6, F.concat(F.lit("Assistant:\n"), t)).otherwise(t))
    answers = V.table(s, d, "conversations").select(
        "conv_id", "turn", raw.alias("raw"), F.col("conv_id").alias("id"), t.alias("source"),
        F.when(F.col("turn") % 2 == 0, "clean").otherwise("translate").alias("mode"))
    return responses.single_parse(answers).select("conv_id", "turn", "status", "answer")


def _ask(cue_flags):
    """A fault table: ranges holding a cue of certain lengths fail, some of them also when asked to correct it."""
    def ask(todo):
        spread = todo.withColumn("pos", F.explode(F.sequence(F.col("first") + 1, F.col("past"))))
        seen = (spread.join(cue_flags, ["track_id", "pos"])
                .groupBy("track_id", "first", "past", "round", "corrective")
                .agg(F.count(F.lit(1)).alias("targets"), F.bool_or("odd").alias("odd"), F.bool_or("dead").alias("dead"),
                     F.bool_or("stubborn").alias("stubborn")))
        error = (F.when(F.col("dead"), "Local AI request failed: closed")
                 .when(F.col("odd") & (~F.col("corrective") | F.col("stubborn")), "The model returned invalid subtitle data."))
        return seen.withColumn("error", error).drop("odd", "dead", "stubborn")
    return ask


@query
def retry_plan(s, d):
    c = V.cues_v(s, d)
    n = F.length("text")
    flags = c.select("track_id", "pos", (n % 29 == 0).alias("odd"), (n % 211 == 0).alias("dead"),
                     (n % 2 == 0).alias("stubborn"))
    ranges = (planning.chunk_assign(c, "clean").groupBy("track_id", "chunk_no").agg(F.max("pos").alias("past"))
              .select("track_id", (F.col("chunk_no") * 12).alias("first"), "past"))
    return responses.retry_plan(ranges, _ask(flags)).select(
        "track_id", "first", "past", F.col("round").cast("long").alias("round"), "corrective", "targets", "action")


def misbehaving(batch):
    """A model that adds ! to texts of five, ten, ... letters and, by the lengths of the texts, answers wrongly or not at all.

    A length divisible by 29 spoils an answer: a list lacks that cue, a single answer is a fence; asked once more it is
    right where the length is odd.  A length divisible by 211 breaks the connection.
    """
    import json

    def one(payload, single, corrective):
        cues = [{"id": 0, "text": payload}] if single else json.loads(payload)
        sizes = [len(c["text"]) for c in cues]
        if any(n % 211 == 0 for n in sizes):
            return None, "Local AI request failed: closed"
        spoilt = [n % 29 == 0 and not (corrective and n % 2) for n in sizes]
        said = [c | {"text": c["text"] + "!" * (n % 5 == 0)} for c, n in zip(cues, sizes)]
        if single:
            return "```" if spoilt[0] else "Assistant:\n" + said[0]["text"], None
        return "Sure.\n" + json.dumps([c for c, bad in zip(said, spoilt) if not bad], ensure_ascii=False), None
    found = [one(*row) for row in zip(batch["payload"], batch["single"], batch["corrective"])]
    return batch.assign(raw=[raw for raw, _ in found], error=[error for _, error in found])


@query
def model_loop(s, d):
    """From cues to files: prompts, a model that misbehaves by rule, checks, retries, decisions, whole tracks only."""
    lines = V.cues_v(s, d)
    decisions, _ = responses.model_loop(lines, "translate", misbehaving, language="German", source="English")
    return responses.result_render(lines, decisions)


@query
def error_class(s, d):
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    message = (F.when(kind == "click", F.concat(F.lit("The model returned "), i))
               .when(kind == "error", F.concat(F.lit("Local AI request failed: "), i))
               .when(kind == "purchase", F.concat(F.lit("The local engine "), i))
               .when(kind == "signup", F.concat(F.lit("Local AI response "), i)))
    targets = F.col("event_id") % 3
    return V.table(s, d, "events").select(
        "event_id", responses.error_class(message).alias("class"),
        responses.retry_action(message, targets).alias("action"))


def _decisions(s, d):
    """Answers of accepted chunks plus rule decisions for cues whose length divides by 7."""
    n = F.length("text")
    c = V.cues_v(s, d)
    rules = c.where(n % 7 == 0).select("track_id", "pos", F.lit("").alias("text"), F.lit("remove").alias("route"))
    answers = (_verdicts(s, d, True).select("track_id", F.explode("cues").alias("c"))
               .select("track_id", F.col("c.id").alias("pos"), "c.text")
               .join(rules.select("track_id", "pos"), ["track_id", "pos"], "left_anti"))
    return responses.decisions_merge(rules, answers, c)


@query
def decisions_merge(s, d):
    merged, missing = _decisions(s, d)
    return merged.unionByName(missing.select("track_id", "pos", F.lit(None).cast("string").alias("text"),
                                             F.lit("missing").alias("route")))


@query
def result_render(s, d):
    return responses.result_render(V.cues_v(s, d), V.decisions_v(s, d))


@query
def result_summary(s, d):
    return responses.result_summary(V.cues_v(s, d), V.decisions_v(s, d))


@query
def before_after(s, d):
    kept = V.decisions_v(s, d).withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    return responses.before_after(V.cues_v(s, d), kept)


@query
def log_excerpt(s, d):
    return V.table(s, d, "documents").select("doc_id", responses.log_excerpt(F.col("text")).alias("excerpt"))


# Runs, reports, integrity

@query
def log_sanitise(s, d):
    noisy = F.concat(F.lit("\x1b[31m"), F.substring("line", 1, 3), F.lit("\x00"), F.lit("\x1b[0;1m"),
                     F.expr("substring(line, 4)"), F.lit("\r\n"))
    line = F.when(F.col("line_no") % 9 == 0, F.lit("\x00\r\n")).otherwise(noisy)
    return runs.log_sanitise(V.logs_v(s, d).withColumn("line", line)).select("run_id", "line_no", "line")


@query
def summary_parse(s, d):
    return runs.summary_parse(V.logs_v(s, d))


@query
def stage_classify(s, d):
    done = F.when(F.col("line_no") % 50 == 0, "Pipeline=COMPLETE").otherwise(F.col("line"))
    return runs.stage_classify(V.logs_v(s, d).withColumn("line", done)).select(
        "run_id", "line_no", "stage", "label", F.col("percent").cast("long").alias("percent"))


@query
def failure_message(s, d):
    kept = V.logs_v(s, d).where(~((F.col("run_id") % 3 == 0) & F.startswith("line", F.lit("ERROR"))))
    return runs.failure_message(kept, 2)


@query
def cancel_classify(s, d):
    message = (F.when(F.col("event_type") == "error", " Processing was cancelled.\n")
               .when(F.col("event_type") == "click", "Processing was cancelled by hand."))
    return V.table(s, d, "events").select("event_id", runs.cancel_classify(message).alias("status"))


@query
def attempt_rollup(s, d):
    return runs.attempt_rollup(V.runs_v(s, d))


def _metrics(s, d):
    """A report per event: its fields follow from its id and value, some have another type, some are missing.

    Rows are dealt while they are small: a report is a thousand bytes, and a few row groups hold millions of events.
    """
    v, i = F.col("value"), F.col("event_id")
    given = {"string": F.col("event_type"), "bigint": i, "double": v, "boolean": i % 2 == 0}
    fields = {n: F.when(i % (k + 2) != 0, given[t]) for k, (n, t) in enumerate(fixed.METRIC_FIELDS)}
    fields |= {"elapsed_seconds": v * 2, "ocr_total_seconds": F.when(i % 2 == 0, v).otherwise(v / 2), "ocr_count": F.lit(3),
               "frame_count": F.when(i % 7 == 0, "many").otherwise(i.cast("string"))}
    stages = F.create_map(F.lit("detector_forward_seconds"), F.floor(v) / 4, F.lit("recognizer_forward_seconds"), F.floor(v) / 2, F.lit("other"), v)
    fields |= {"ocr_stage_seconds": stages, "recognizer_batch_histogram": F.create_map(F.lit("8"), i % 5, F.lit("2"), F.lit(1)),
               "available_providers": F.array(F.lit("GPU"), F.col("event_type"))}
    report = F.to_json(F.struct(*[x.alias(n) for n, x in fields.items()]))
    events = V.table(s, d, "events").select("event_id", "event_type", "value").repartition("event_id")
    return events.select(i.alias("run_id"), F.when(i % 23 == 0, "{broken").otherwise(report).alias("metrics"))


@query
def metrics_flatten(s, d):
    flat = runs.metrics_flatten(_metrics(s, d))
    doubles = [n for n, t in fixed.METRIC_FIELDS if t == "double"]
    return flat.withColumns({n: F.round(n, 3) for n in doubles}).withColumn("bad_fields", F.array_join("bad_fields", ","))


@query
def metrics_stages(s, d):
    nested = runs.metrics_nested(_metrics(s, d)).where("field = 'ocr_stage_seconds'")
    return nested.select("run_id", F.col("key").alias("stage"), F.round(F.col("value").cast("double"), 3).alias("seconds"))


@query
def metrics_nested(s, d):
    nested = runs.metrics_nested(_metrics(s, d)).where("field <> 'ocr_stage_seconds'")
    return nested.select("run_id", "field", F.when(F.col("key").isNull(), F.col("place")).alias("place"), "key", "value")


@query
def summary_render(s, d):
    rolled = runs.attempt_rollup(V.runs_v(s, d))
    return runs.summary_render(rolled, {
        "Pipeline": F.col("last_status"), "Attempts": F.col("attempts"),
        "OCRFallback": F.when(F.col("fallback_reason").isNotNull(), "True").otherwise("False"),
        "Error": F.when(F.col("last_status") != "COMPLETE", F.col("fallback_reason"))}, "1")


@query
def latest_per_group(s, d):
    return runs.latest_per_group(V.logs_v(s, d), "run_id", ["ts_us", "line_no"], "line")


@query
def telemetry_extract(s, d):
    return runs.telemetry_extract(V.telemetry_v(s, d))


@query
def progress_marks(s, d):
    return runs.progress_marks(V.long_frames_v(s, d))


@query
def asset_verify(s, d):
    return integrity.asset_verify(V.assets_v(s, d), V.manifest_v(s, d))


@query
def incremental_verify(s, d):
    assets = V.assets_v(s, d).withColumn("mtime", F.col("doc_id"))
    checked = (assets.where(F.col("doc_id") % 2 == 0)
               .select("path", "size", F.when(F.col("doc_id") % 4 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1)
                       .alias("mtime"), F.sha2("content", 256).alias("sha256")))
    return integrity.incremental_verify(assets, V.manifest_v(s, d), checked)


# Streams

def _arriving(rows, arrival, slices, wait_us):
    """Rows with the slice they arrive in, and after them a last slice with one row of no track.

    A table ends where a stream goes on, so that row moves event time beyond all others by more than `wait_us`.
    """
    rows = durable(rows.withColumn("arrival", arrival))
    high = rows.agg(F.max("ts_us")).first()[0]
    if high is None:
        return rows
    clock = rows.sparkSession.range(1).select(F.lit(high + wait_us + 1_000_000).alias("ts_us"), F.lit(slices).alias("arrival"))
    return rows.unionByName(clock, allowMissingColumns=True)


def _disordered(rows, slices=5):
    """Rows of five spans of time, every other one a span late, and the microseconds of two spans, which cover that."""
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    span = ((high or 0) - (low or 0)) // slices + 1
    arrival = F.least(F.lit(slices - 1), div(F.col("ts_us") - F.lit(low), span) + F.col("n") % 2).cast("int")
    return _arriving(rows, arrival, slices, 2 * span), 2 * span


@query
def stream_ocr_gate(s, d):
    rows, delay_us = _disordered(V.stream_samples_v(s, d))
    found = replay(rows, "ts_us", lambda samples: tracks.stream_ocr_gate(samples, 1_000_000, f"{delay_us} microseconds"),
                   slices=6, arrival=F.col("arrival"))
    return found.select("track_id", "n", "ts_us", "kept")


@query
def stream_late_audit(s, d):
    """Slices dealt without regard to time and no delay, so that most rows come behind the watermark."""
    rows = _arriving(V.stream_samples_v(s, d), ((F.col("n") * 7 + F.col("track_id")) % 5).cast("int"), 5, 0)
    return replay(rows, "ts_us", lambda samples: tracks.stream_late_audit(tracks.stream_ocr_gate(samples, 1_000_000)), "update",
                  slices=6, arrival=F.col("arrival"))


def _cue_samples(s, d):
    return V.samples_v(s, d).select("track_id", F.col("n").cast("long").alias("n"), "ts_us", "text", "changed")


@query
def stream_cues(s, d):
    rows, delay_us = _disordered(_cue_samples(s, d))
    # No track pauses for longer than the five spans that the table lasts.
    idle_us = 3 * delay_us
    rows = rows.withColumn("ts_us", F.when(F.col("n").isNull(), F.col("ts_us") + idle_us).otherwise(F.col("ts_us")))
    return replay(rows, "ts_us", lambda samples: tracks.stream_cues(samples, SIX_HOURS_US, idle_us=idle_us, delay=f"{delay_us} microseconds"),
                  slices=6, arrival=F.col("arrival"))


@query
def stream_late_samples(s, d):
    """Samples that the cue stream took behind its watermark, with the time they came with and the one they got."""
    rows = _arriving(_cue_samples(s, d), ((F.col("n") * 7 + F.col("track_id")) % 5).cast("int"), 5, 0)
    found = replay(rows, "ts_us", lambda samples: tracks.stream_cue_rows(samples, SIX_HOURS_US, idle_us=10 ** 15),
                   slices=6, arrival=F.col("arrival"))
    return found.where("given_us IS NOT NULL").select("track_id", F.col("cue_n").alias("n"), "given_us", F.col("start_us").alias("ts_us"), "text")


@query
def stream_progress(s, d):
    lines = V.logs_v(s, d).select("run_id", "line_no", "ts_us", "line")
    return replay(lines, "ts_us", tracks.stream_progress, "update")
