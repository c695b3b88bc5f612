"""Model replies: reading, checking, retrying, and putting results together."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from cuelake import fixed
from cuelake.functions.replies import escape_controls, read_reply
from cuelake.functions.text import is_blank, strip, trimmed
from cuelake.operators import planning
from cuelake.operators.export import export_srt
from cuelake.operators.ordered import div, running_sum, scan, total
from cuelake.operators.recognise import infer_beside
from cuelake.plans.cut import durable

CUES = "array<struct<id:bigint,text:string>>"
CUES_TYPE = ArrayType(StructType().add("id", LongType()).add("text", StringType()))
THINK_END = "</think>"
ASSISTANT = "Assistant:"  # in every marker

# A reply that is plain, complete JSON of (id, text) objects and nothing else.
_CHARS = r'[^"\\\x00-\x1f]*+'
PLAIN_REPLY = (r'^\s*\[\s*(?:\{\s*"id"\s*:\s*(?:0|[1-9]\d{0,17})\s*,\s*"text"\s*:\s*"' + _CHARS
               + r'(?:\\["\\/bfnrt]' + _CHARS + r')*+"\s*\}\s*(?:,\s*(?=\{)|(?=\])))*+\]\s*$')


def _after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def assistant_extract(text: Column) -> Column:
    """What follows the last assistant marker, then the last end of thinking; trimmed."""
    answer = F.coalesce(*[F.when(F.contains(text, F.lit(m)), _after_last(text, m)) for m in fixed.ASSISTANT_MARKERS], text)
    answer = F.when(F.contains(text, F.lit(ASSISTANT)), answer).otherwise(text)
    return strip(F.when(F.contains(text, F.lit(THINK_END)), _after_last(answer, THINK_END)).otherwise(answer))


#: Replies whose cues are Python objects at one time.
REPLIES_AT_ONCE = 256


@F.arrow_udf(CUES_TYPE)
def _read_replies(replies: pa.Array, single: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("id", pa.int64()), ("text", pa.string())]))

    def some(at):
        part = zip(replies.slice(at, REPLIES_AT_ONCE).to_pylist(), single.slice(at, REPLIES_AT_ONCE).to_pylist())
        found = [None if reply is None else read_reply(escape_controls(reply) if one else reply) for reply, one in part]
        cues = [cue for cues in found for cue in cues or ()]
        ids, texts = pa.array([i for i, _ in cues], pa.int64()), pa.array([t for _, t in cues], pa.string())
        ends = [0, *accumulate(len(cues or ()) for cues in found)]
        unread = pa.array([cues is None for cues in found], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([ids, texts], fields=list(kind.value_type)), type=kind, mask=unread)
    return pa.concat_arrays([some(at) for at in range(0, max(1, len(replies)), REPLIES_AT_ONCE)])


def json_repair(reply: Column, single: Column | bool = False) -> Column:
    """Cue list of a reply, null when unusable.  Only replies that are not plain JSON go to Python.

    In a ``single`` answer raw line breaks and tabs inside strings are escaped before anything else; plain JSON has none.
    """
    plain = reply.rlike(PLAIN_REPLY)
    return (F.when(plain, F.from_json(reply, CUES))
            .otherwise(_read_replies(F.when(~plain, reply), F.lit(single) if isinstance(single, bool) else single)))


def response_explode(responses: DataFrame) -> DataFrame:
    """One row per returned cue with its place in the reply (from 0).

    The outer explode keeps the optimizer from reading every reply once more to look for empty lists.
    """
    return (responses.withColumn("cues", json_repair(assistant_extract(F.col("raw"))))
            .select("track_id", "chunk_no", F.posexplode_outer("cues").alias("place", "cue")).where("place IS NOT NULL")
            .select("track_id", "chunk_no", F.col("place").cast("long").alias("place"), "cue.id", "cue.text"))


def target_verdict(cues: Column, targets: Column, allow_empty: bool) -> Column:
    """OK, or why the cue list does not answer exactly the targets (an array of ids)."""
    mine = F.filter(cues, lambda c: F.array_contains(targets, c["id"]))
    ids = F.transform(mine, lambda c: c["id"])
    pairs = F.arrays_zip(mine.alias("cue"), targets.alias("id"))
    bad_order = F.transform(pairs, lambda p: p["cue"]["id"] != p["id"])
    bad_text = F.transform(pairs, lambda p: F.lit(not allow_empty) & (strip(p["cue"]["text"]) == ""))
    first_order = F.nullif(F.array_position(bad_order, F.lit(True)), F.lit(0))
    first_empty = F.nullif(F.array_position(bad_text, F.lit(True)), F.lit(0))
    return (F.when(F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE")
            .when(F.size(ids) != F.size(targets), "COUNT")
            .when(first_order.isNotNull() & (first_empty.isNull() | (first_order <= first_empty)), "ORDER")
            .when(first_empty.isNotNull(), "EMPTY")
            .otherwise("OK"))


def target_validate(responses: DataFrame, chunks: DataFrame, allow_empty: bool) -> DataFrame:
    """Verdict per chunk; ``cues`` holds the accepted answers, all of a chunk or none.

    Chunks and replies meet on (track, chunk), groups of a dozen ids.
    """
    targets = chunks.select("track_id", "chunk_no", F.transform("targets", lambda c: c["id"]).alias("ids"))
    joined = (responses.withColumn("cues", json_repair(assistant_extract(F.col("raw"))))
              .join(targets, ["track_id", "chunk_no"]))
    verdict = (F.when(F.col("error").isNotNull(), "TRANSPORT").when(F.col("cues").isNull(), "UNREADABLE")
               .otherwise(target_verdict(F.col("cues"), F.col("ids"), allow_empty)))
    accepted = F.filter("cues", lambda c: F.array_contains("ids", c["id"]))
    return (joined.withColumn("verdict", verdict)
            .withColumn("cues", F.when(F.col("verdict") == "OK", accepted))
            .select("track_id", "chunk_no", "verdict", "cues"))


def single_parse(answers: DataFrame) -> DataFrame:
    """Answers to one cue: ``raw, id, source, mode`` to ``status`` and ``answer``."""
    read = answers.withColumn("_text", assistant_extract(F.col("raw")))
    read = read.withColumn("_cues", json_repair(F.when(_listed(F.col("_text")), F.col("_text")), single=True))
    return _single_status(read).drop("_text", "_cues")


def _listed(text: Column) -> Column:
    return text.rlike(r"^[{\[]")


def _single_status(answers: DataFrame) -> DataFrame:
    """Adds ``status`` and ``answer`` to answers to one cue with their extracted ``_text`` and the ``_cues`` read from it."""
    text, clean = F.col("_text"), F.col("mode") == "clean"
    listed = _listed(text)
    removed = clean & (text == fixed.REMOVE_MARK)
    one = F.get("_cues", F.lit(0))
    fits = F.coalesce((F.size("_cues") == 1) & (one["id"] == F.col("id"))
                      & (clean | (strip(one["text"]) != "")), F.lit(False))
    echo = F.when(clean, F.contains(text, F.lit("Subtitle:\n"))).otherwise(
        text == F.concat(F.lit("Subtitle:\n"), strip(F.col("source"))))
    unusable = ((text == "") | F.startswith(text, F.lit("```")) | F.contains(text, F.lit("\nUser:"))
                | F.contains(text, F.lit("\nAssistant:")) | echo)
    return (answers.withColumn("status", F.when(removed, "OK").when(listed & ~removed, F.when(fits, "OK").otherwise("INVALID"))
                        .when(unusable, "UNUSABLE").otherwise("OK"))
            .withColumn("answer", F.when(F.col("status") == "OK",
                                         F.when(removed, "").when(listed, strip(one["text"])).otherwise(text))))


def error_class(message: Column) -> Column:
    """``model`` errors may be retried, ``transport`` errors cost the warm model, others stop."""
    transport = F.lit(False)
    for prefix in fixed.TRANSPORT_ERROR_PREFIXES:
        transport = transport | F.startswith(message, F.lit(prefix))
    return (F.when(message.isNull(), "none").when(F.startswith(message, F.lit(fixed.MODEL_ERROR_PREFIX)), "model")
            .when(transport, "transport").otherwise("other"))


def retry_action(message: Column, targets: Column, corrective: Column | None = None) -> Column:
    """What a failed range does next: split in two, ask once more with a correction, or stop."""
    model = error_class(message) == "model"
    fresh = F.lit(True) if corrective is None else ~corrective
    return (F.when(model & (targets > 1), "split").when(model & (targets == 1) & fresh, "retry")
            .otherwise("stop"))


def next_ranges(failed: DataFrame) -> DataFrame:
    """Halves of the ranges to split, (first, past] each, and the others once more with ``corrective`` true.

    The middle is counted on the range, not on its targets.
    """
    middle = F.col("first") + div(F.col("past") - F.col("first"), 2)
    halves = F.array(F.struct("first", middle.alias("past"), F.lit(False).alias("corrective")),
                     F.struct(middle.alias("first"), "past", F.lit(False).alias("corrective")))
    again = F.array(F.struct("first", "past", F.lit(True).alias("corrective")))
    return (failed.withColumn("_next", F.explode(F.when(F.col("action") == "split", halves).otherwise(again)))
            .withColumns({name: F.col(f"_next.{name}") for name in ("first", "past", "corrective")}).drop("_next"))


#: Tasks of a round after the first, for each core of the session.
TASKS_PER_CORE = 4


def retry_plan(ranges: DataFrame, ask) -> DataFrame:
    """Ask for every range; split the failed ones until all are answered or stopped.

    ``ask`` maps a frame of ranges (track, first, past, round, corrective) to the same
    rows with ``targets`` and ``error``.  A range of one cue that fails is asked once more,
    with ``corrective`` true, and then stops.  Each round is written to the shared folder
    before it is split, so no range is asked twice alike, and rounds only hold what failed:
    a range of n cues is settled after log2(n) rounds and the corrective one.
    """
    done, number = None, 0
    todo = ranges.withColumn("round", F.lit(0)).withColumn("corrective", F.lit(False))
    while True:
        asked = durable(ask(todo).withColumn("action", F.when(F.col("error").isNull(), "done").otherwise(
            retry_action(F.col("error"), F.col("targets"), F.col("corrective")))))
        settled = asked.where("action IN ('done', 'stop')")
        done = settled if done is None else done.unionByName(settled)
        failed = asked.where("action IN ('split', 'retry')")
        if failed.isEmpty():
            return done
        number += 1
        # What failed is a part of each task's rows and fewer in every round: a few tasks for each core are enough.
        todo = (next_ranges(failed).select(*ranges.columns, F.lit(number).alias("round"), "corrective")
                .coalesce(TASKS_PER_CORE * ranges.sparkSession.sparkContext.defaultParallelism))


def decisions_merge(rules: DataFrame, answers: DataFrame, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All decisions (``track_id, pos, text, route``), and the cues that have none."""
    merged = (rules.select("track_id", "pos", "text", "route")
              .unionByName(answers.select("track_id", "pos", trimmed(F.col("text")).alias("text"),
                                          F.lit("model").alias("route"))))
    missing = cues.select("track_id", "pos").join(merged, ["track_id", "pos"], "left_anti")
    return merged, missing


def decided_cues(cues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Original times with the decided text; cues decided away are gone, numbers are new.

    Tracks with an undecided cue are left out whole; ``result_summary`` counts such cues.
    """
    known = decisions.where(F.col("text").isNotNull()).select("track_id", "pos", "text")
    # Stated here, the rule that a cue has a track stands before every shuffle of the cues alike, so they are shuffled once.
    both = cues.where(F.col("track_id").isNotNull()).drop("text").join(known, ["track_id", "pos"], "left")
    kept, undecided = ~is_blank(F.coalesce("text", F.lit(""))), F.col("text").isNull()
    # One join and one scan: new numbers count kept cues, and a track's undecided ones are known beside each of its cues.
    return (scan(both, ["track_id"], ["pos"], new_pos=running_sum(kept.cast("long")), undecided=total(undecided.cast("long")))
            .where((F.col("undecided") == 0) & kept).drop("pos", "undecided")
            .withColumnRenamed("new_pos", "pos"))


def result_render(cues: DataFrame, decisions: DataFrame) -> DataFrame:
    return export_srt(decided_cues(cues, decisions))


def result_summary(cues: DataFrame, decisions: DataFrame) -> DataFrame:
    joined = cues.select("track_id", "pos").join(decisions.select("track_id", "pos", "text"), ["track_id", "pos"],
                                                 "left")
    kept = strip(F.col("text")) != ""
    return joined.groupBy("track_id").agg(
        F.count_if(kept).alias("cue_count"), F.count(F.lit(1)).alias("source_cue_count"),
        F.count_if(~kept).alias("dropped_cue_count"), F.count_if(F.col("text").isNull()).alias("undecided_cue_count"))


def before_after(originals: DataFrame, results: DataFrame) -> DataFrame:
    """Original beside result by cue, with what happened to it."""
    both = (originals.select("track_id", "pos", F.col("text").alias("before"))
            .join(results.select("track_id", "pos", F.col("text").alias("after")), ["track_id", "pos"], "full_outer"))
    gone = F.coalesce(F.col("after"), F.lit("")) == ""
    return both.withColumn("change", F.when(gone, "removed").when(F.col("before").eqNullSafe(F.col("after")), "kept")
                           .otherwise("edited"))


def log_excerpt(text: Column) -> Column:
    limit = fixed.LOG_EXCERPT_CHARS
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(fixed.LOG_EXCERPT_MARK))
                  ).otherwise(text)


UNUSABLE_ANSWER = fixed.MODEL_ERROR_PREFIX + "returned invalid subtitle data."


def judged(answers: DataFrame, mode: str) -> DataFrame:
    """Replies to ranges (``targets, raw, error``): ``cues`` of the accepted ones, an ``error`` for the others.

    A range of several cues is answered by a list that fits it, a single cue by its text or such a list.
    """
    several, text, cues = F.size("targets") > 1, F.col("_text"), F.col("_cues")
    ids = F.transform("targets", lambda c: c["id"])
    first = F.get("targets", F.lit(0))
    read = (answers.withColumns({"_text": assistant_extract(F.col("raw")), "id": first["id"], "source": first["text"], "mode": F.lit(mode)})
            .withColumns({"_ids": ids, "_cues": json_repair(F.when(several | _listed(text), text), single=~several)})
            .withColumn("_text", F.when(~several, text)).withColumn("_mine", F.when(several, F.filter(cues, lambda c: F.array_contains("_ids", c["id"])))))
    # The targets' ids in their order, none twice: what ``target_verdict`` calls OK.
    listed = F.transform("_mine", lambda c: c["id"]) == F.col("_ids")
    empty = F.lit(mode == "translate") & F.coalesce(F.exists("_mine", lambda c: is_blank(c["text"])), F.lit(False))
    fits = F.coalesce(F.when(several, listed & ~empty).otherwise(F.col("status") == "OK"), F.lit(False))
    taken = F.when(several, F.col("_mine")).otherwise(F.array(F.struct(F.col("id"), F.col("answer").alias("text"))))
    return (_single_status(read).withColumn("error", F.when(F.col("error").isNotNull(), F.col("error")).when(~fits, UNUSABLE_ANSWER))
            .withColumn("cues", F.when(F.col("error").isNull(), taken))
            .drop("raw", "_text", "_cues", "_ids", "_mine", "id", "source", "mode", "status", "answer"))


def model_loop(cues: DataFrame, mode: str, model, **options) -> tuple[DataFrame, DataFrame]:
    """Decisions for every cue and what became of every range, from rules and a model.

    ``model`` maps pandas batches with ``prompt``, ``payload``, ``single`` and ``corrective`` to the same rows with
    ``raw`` and ``error`` beside them; it runs in ``recognise.infer_beside``.  What rules decide is not asked.  Ranges whose
    answer does not fit are halved or asked once more as ``retry_plan`` says; cues of ranges that stop stay undecided.
    A range brings the cues it asks about along, so a round moves nothing and reads only what failed before it.
    """
    strength = options.get("strength", "balanced")
    chunks = durable(planning.near_rows(planning.work_split(cues, mode, strength), mode))
    wording = {"language": fixed.AUTO_LANGUAGE, "strength": strength, "guidance": "", "source": fixed.AUTO_LANGUAGE, "templates": planning.TEMPLATES, **options}
    reads = ["prompt", "payload", "single", "corrective"]

    def ask(todo: DataFrame) -> DataFrame:
        prompts = planning.worded(planning.range_rows(todo), mode, **wording).select(*todo.columns, "targets", *(c for c in reads if c not in todo.columns))
        answered = infer_beside(prompts, model, reads, "raw string, error string").select(*todo.columns, "targets", "raw", "error")
        found = judged(answered, mode)
        # Only ranges that may be asked again need their cues.
        return found.withColumns({"targets": F.size("targets").cast("long"), "near": F.when(F.col("error").isNotNull(), planning.near_range())})

    settled = retry_plan(chunks.drop("decided"), ask).drop("near")
    answers = settled.where("action = 'done'").select("track_id", F.explode("cues").alias("c")).select("track_id", F.col("c.id").alias("pos"), "c.text")
    rules = chunks.select("track_id", F.explode("decided").alias("c")).select("track_id", F.col("c.id").alias("pos"), "c.text", "c.route")
    decisions, _ = decisions_merge(rules, answers, cues)
    return decisions, settled.drop("cues")
