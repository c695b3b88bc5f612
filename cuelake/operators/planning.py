"""Planning cleanup and translation work on cue tracks.

Cues need ``track_id, blk, pos, text`` with ``pos`` counting from 1 without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake import fixed
from cuelake.functions.text import BLANK_CHARS, LETTER, has_letter, letter_count, number_count, strip, visible_count
from cuelake.operators.ordered import div, lag, lead, running_sum, scan, total

TRACK = ["track_id"]


def cue_shape(cues: DataFrame) -> DataFrame:
    text = F.col("text")
    return (cues.withColumn("visible", visible_count(text)).withColumn("alphabetic", letter_count(text))
            .withColumn("numeric", number_count(text)))


def _weak(text):
    """At most four visible characters and at most one letter; plain words are told by their first five characters."""
    long = text.rlike(r"^[\x21-\x7E]{5}") | (F.length(F.translate(text, BLANK_CHARS, "")) > 4)
    return F.when(long, False).otherwise(~text.rlike(f"(?s){LETTER}.*?{LETTER}"))


def weak_fragment(cues: DataFrame) -> DataFrame:
    return cues.withColumn("weak", _weak(F.col("text")))


def strong_prefilter(cues: DataFrame) -> DataFrame:
    """Cues that strong cleanup removes without asking a model.

    Only weak cues ask for their neighbours, and only weak neighbours matter, so the others are not put in order.
    """
    marked, text, at = weak_fragment(cues), F.col("text"), F.col("pos")
    bare = ~text.rlike(rf"[{LETTER}\p{{N}}]")
    others = marked.where(~F.coalesce("weak", F.lit(False))).withColumn("remove", bare)
    near = scan(marked.where("weak"), TRACK, ["pos"], weak_before=lag(at), weak_after=lead(at))
    neighbour = F.coalesce(F.col("weak_before") >= at - 1, F.lit(False)) | F.coalesce(F.col("weak_after") <= at + 1, F.lit(False))
    debris = neighbour & (text.rlike(r"\p{N}") | ~has_letter(text))
    return others.unionByName(near.withColumn("remove", bare | debris).drop("weak_before", "weak_after")).drop("weak")


def needs_translation(cues: DataFrame) -> DataFrame:
    return cues.withColumn("needed", has_letter(F.col("text")))


def chunk_size(mode: str) -> int:
    return fixed.TRANSLATE_CHUNK if mode == "translate" else fixed.CLEAN_CHUNK


def chunk_assign(cues: DataFrame, mode: str) -> DataFrame:
    return cues.withColumn("chunk_no", div(F.col("pos") - 1, chunk_size(mode)))


def context_window(cues: DataFrame, mode: str, routed: bool = False) -> DataFrame:
    """One row per chunk: its targets and up to four cues on each side.

    Each cue goes to its own chunk and, near an edge, also to the neighbour as
    context, so one shuffle on (track, chunk) builds groups of at most 20 rows.
    With ``routed`` only cues whose ``route`` is ``model`` become targets.
    """
    size, near = chunk_size(mode), fixed.CONTEXT_CUES
    place, chunk = F.pmod(F.col("pos") - 1, F.lit(size)), F.col("chunk_no")
    roles = F.array_compact(F.array(
        F.struct(chunk.alias("chunk_no"), F.lit("target").alias("role")),
        F.when((place < near) & (chunk > 0), F.struct((chunk - 1).alias("chunk_no"), F.lit("after").alias("role"))),
        F.when(place >= size - near, F.struct((chunk + 1).alias("chunk_no"), F.lit("before").alias("role")))))
    extra = ["route"] if routed else []
    placed = (chunk_assign(cues, mode).select("track_id", "pos", "text", *extra, F.explode(roles).alias("r"))
              .select("track_id", "r.chunk_no", "r.role", F.struct(F.col("pos").alias("id"), "text").alias("cue"), *extra))

    def members(condition):
        return F.array_sort(F.collect_list(F.when(condition, F.col("cue"))))
    target = F.col("role") == "target"
    wanted = target & (F.col("route") == "model") if routed else target
    return (placed.groupBy("track_id", "chunk_no")
            .agg(members(wanted).alias("targets"), members(F.col("role") == "before").alias("before"),
                 members(F.col("role") == "after").alias("after"), F.count_if(target).alias("cues"))
            .where("cues > 0"))


def document_samples(cues: DataFrame) -> DataFrame:
    """At most 24 cues spread evenly over each track, preferring cues with three letters."""
    shaped = cues.withColumn("good", (letter_count(F.col("text")) >= fixed.SAMPLE_MIN_LETTERS).cast("int"))
    ranked = scan(shaped, TRACK, ["pos"], good_rank=running_sum(F.col("good")), goods=total(F.col("good")),
                  cue_total=total(F.lit(1)))
    any_good = F.col("goods") > 0
    steps = fixed.SAMPLE_CUES - 1
    index, count = F.col("idx"), F.col("n")
    # sample s has index s*(n-1) div 23; the smallest s that can reach an index decides
    sample = div(index * steps + count - 2, count - 1)
    return (ranked.withColumn("idx", F.when(any_good, F.col("good_rank")).otherwise(F.col("pos")) - 1)
            .withColumn("n", F.when(any_good, F.col("goods")).otherwise(F.col("cue_total")))
            .where(~any_good | (F.col("good") == 1))
            .where((count <= fixed.SAMPLE_CUES) | (F.when(count > 1, div(sample * (count - 1), steps)) == index))
            .select("track_id", "pos", "text"))


def sample_texts(cues: DataFrame) -> DataFrame:
    """The first samples of each track as one small array (at most 8 texts)."""
    ranked = document_samples(cues)
    return (ranked.groupBy("track_id")
            .agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "text"))), 1, fixed.PROMPT_SAMPLES)
                 .alias("samples")))


def task_options(requests: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when valid) and the cleaned options of each request."""
    language = strip(F.col("language"))
    language = F.when(F.col("mode") == "clean", F.coalesce(language, F.lit(fixed.AUTO_LANGUAGE))).otherwise(language)
    strength = F.coalesce(strip(F.col("strength")), F.lit("balanced"))
    guidance = strip(F.coalesce("guidance", F.lit("")))
    clean = F.col("mode") == "clean"
    reason = (F.when(~F.col("mode").isin(fixed.MODES), "MODE")
              .when(F.length("guidance_text") > fixed.MAX_GUIDANCE_CHARS, "GUIDANCE")
              .when(F.coalesce(F.col("language_text"), F.lit("")) == "", "LANGUAGE")
              .when((F.octet_length("language_text") > fixed.MAX_LANGUAGE_BYTES)
                    | F.col("language_text").rlike(r"\p{Cc}"), "LANGUAGE")
              .when(clean & ~F.col("strength_text").isin(fixed.STRENGTHS), "STRENGTH"))
    return (requests.withColumn("language_text", language)
            .withColumn("strength_text", F.when(clean, strength))
            .withColumn("guidance_text", guidance)
            .withColumn("reason", reason))


def source_select(originals: DataFrame, cleaned: DataFrame, keys: list[str], use_cleaned: bool) -> DataFrame:
    """Text to work on: the cleaned text only when translating, wanted and present."""
    joined = originals.join(cleaned.select(*keys, F.col("text").alias("cleaned")), keys, "left")
    chosen = ((F.col("mode") == "translate") & F.lit(use_cleaned)
              & (F.coalesce("cleaned", F.lit("")) != ""))
    return (joined.withColumn("source", F.when(chosen, "cleaned").otherwise("original"))
            .withColumn("input", F.when(chosen, F.col("cleaned")).otherwise(F.col("text"))))


def work_split(cues: DataFrame, mode: str, strength: str = "balanced") -> DataFrame:
    """Route of each cue: decided by rule (with the decision) or sent to the model."""
    if mode == "clean" and strength == "strong":
        routed = strong_prefilter(cues).withColumn("route", F.when(F.col("remove"), "remove").otherwise("model"))
        decision = F.when(F.col("remove"), "")
    elif mode == "translate":
        routed = needs_translation(cues).withColumn("route", F.when(F.col("needed"), "model").otherwise("copy"))
        decision = F.when(~F.col("needed"), F.col("text"))
    else:
        routed, decision = cues.withColumn("route", F.lit("model")), F.lit(None).cast("string")
    return chunk_assign(routed, mode).withColumn("decision", decision).drop("remove", "needed")


def chunk_work(split: DataFrame) -> DataFrame:
    """Per chunk, cues decided by rule and cues for the model."""
    model = F.count_if(F.col("route") == "model")
    return (split.groupBy("track_id", "chunk_no")
            .agg(F.count_if(F.col("route") != "model").alias("by_rule"), model.alias("for_model"))
            .withColumn("finished", F.col("for_model") == 0))


# Wording of the instructions; callers may pass their own.
TEMPLATES = {
    "language_auto": "Find the main language of the samples and keep every cue in it.",
    "language_named": "Keep every cue in %s.",
    "light": "Fix clear recognition errors and drop only what is plainly not text.",
    "balanced": "Fix recognition errors and line breaks and drop what is very likely noise.",
    "strong": "Fix recognition errors and drop stray symbols, debris and text that is no dialogue.",
    "clean_one": "Answer with the corrected cue only, or with [[REMOVE]] for noise.",
    "clean_many": "Answer with a JSON array of {\"id\":number,\"text\":string}, one per input in order; empty text removes a cue.",
    "translate": "Translate into %s.",
    "translate_from": "Translate from %f into %s.",
    "translate_one": "Answer with the translated cue only and keep its line breaks.",
    "translate_many": "Answer with a JSON array of {\"id\":number,\"text\":string}, one per input in order.",
    "retry_clean": "The last answer was not usable. Answer once more with the corrected cue only, or with [[REMOVE]].",
    "retry_translate": "The last answer was not usable. Answer once more with the translated cue only.",
}


def _texts(column):
    return F.to_json(F.transform(column, lambda c: c["text"]))


def _checked_options(mode: str, language: str, strength: str, guidance: str, source: str) -> None:
    """Refuses what ``task_options`` would refuse, before any prompt is made."""
    def plain(text):
        return 0 < len(text.strip().encode()) <= fixed.MAX_LANGUAGE_BYTES and not any(ord(c) < 32 or 127 <= ord(c) < 160 for c in text.strip())
    faults = {"MODE": mode not in fixed.MODES, "GUIDANCE": len(guidance.strip()) > fixed.MAX_GUIDANCE_CHARS,
              "LANGUAGE": not plain(language) or not plain(source), "STRENGTH": mode == "clean" and strength not in fixed.STRENGTHS}
    for reason, found in faults.items():
        if found:
            raise ValueError(reason)


def worded(chunks: DataFrame, mode: str, language: str, strength: str, guidance: str, source: str, templates: dict) -> DataFrame:
    """Adds ``single``, the JSON of context and samples, ``payload`` and ``prompt`` to chunks (targets, before, after, samples).

    A chunk with ``corrective`` true is asked once more, in the words for that.
    """
    _checked_options(mode, language, strength, guidance, source)
    if mode == "clean":
        named = "language_auto" if language == fixed.AUTO_LANGUAGE else "language_named"
        order = [templates[named].replace("%s", language), templates[strength]]
    else:
        order = [templates["translate" if source == fixed.AUTO_LANGUAGE else "translate_from"].replace("%s", language).replace("%f", source)]
    one = F.size("targets") == 1
    task = F.concat(F.lit(" ".join(order) + " "), F.when(one, templates[f"{mode}_one"]).otherwise(templates[f"{mode}_many"]))
    if "corrective" in chunks.columns:
        task = F.when(F.col("corrective") & one, F.concat(F.lit(" ".join(order) + " "), F.lit(templates[f"retry_{mode}"]))).otherwise(task)
    samples = F.to_json(F.transform(F.coalesce("samples", F.array()), lambda c: c["text"]))
    return (chunks.withColumn("single", one)
            .withColumn("samples_json", samples)
            .withColumn("before_json", _texts("before")).withColumn("after_json", _texts("after"))
            .withColumn("payload", F.when(one, F.col("targets")[0]["text"]).otherwise(F.to_json("targets")))
            .withColumn("prompt", F.concat(
                task, F.lit(f"\nGuidance: {guidance.strip()}\nSamples: "), "samples_json", F.lit("\nBefore: "),
                "before_json", F.lit("\nAfter: "), "after_json", F.lit("\nInput: "), "payload")))


def prompt_rows(cues: DataFrame, mode: str, language: str = fixed.AUTO_LANGUAGE, strength: str = "balanced",
                guidance: str = "", templates: dict = TEMPLATES, source: str = fixed.AUTO_LANGUAGE) -> DataFrame:
    """One prompt per chunk with model targets; context and payload as JSON.

    ``source`` names the language to translate from; left to the model where it is not given.
    """
    split = work_split(cues, mode, strength)
    chunks = context_window(split, mode, routed=True).where(F.size("targets") > 0)
    if mode == "clean" and language == fixed.AUTO_LANGUAGE:
        # One small row of samples streams past the chunks of its track.  Chunks hashed on the track stay where they are;
        # others are moved on it, and adaptive execution divides the partition of a huge track, as its join is no aggregate.
        chunks = chunks.join(sample_texts(cues), "track_id", "left")
    else:
        chunks = chunks.withColumn("samples", F.array().cast("array<struct<pos:bigint,text:string>>"))
    return worded(chunks, mode, language, strength, guidance, source, templates).select(
        "track_id", "chunk_no", "single", "samples_json", "before_json", "after_json", "payload", "prompt")


def near_rows(split: DataFrame, mode: str) -> DataFrame:
    """One row per chunk: its range (first, past], all cues ``near`` it in order, and what rules ``decided`` inside it.

    ``near`` holds the chunk and up to four cues on each side, so every part of the range finds its context there.
    """
    size, context, chunk = chunk_size(mode), fixed.CONTEXT_CUES, F.col("chunk_no")
    place = F.pmod(F.col("pos") - 1, F.lit(size))
    chunks = F.array_compact(F.array(chunk, F.when((place < context) & (chunk > 0), chunk - 1), F.when(place >= size - context, chunk + 1)))
    cue = F.struct(F.col("pos").alias("id"), "text", "route")
    inside = F.col("pos").between(F.col("chunk_no") * size + 1, (F.col("chunk_no") + 1) * size)
    ruled = F.struct(F.col("pos").alias("id"), F.col("decision").alias("text"), "route")
    return (split.select("track_id", "pos", "text", "route", "decision", F.explode(chunks).alias("chunk_no"))
            .groupBy("track_id", "chunk_no").agg(
                F.max(F.when(inside, F.col("pos"))).alias("past"), F.array_sort(F.collect_list(cue)).alias("near"),
                F.collect_list(F.when(inside & (F.col("route") != "model"), ruled)).alias("decided"))
            .where("past IS NOT NULL")
            .select("track_id", (F.col("chunk_no") * size).alias("first"), "past", "near", "decided"))


def range_rows(ranges: DataFrame, context: int = fixed.CONTEXT_CUES) -> DataFrame:
    """Ranges (first, past, near, ...) with the targets in (first, past] and the cues before and after them, from ``near``.

    Ranges without a cue for the model are left out.
    """
    first, past = F.col("first"), F.col("past")

    def listed(where):
        return F.transform(F.filter("near", where), lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text")))

    def target(c):
        return c["id"].between(first + 1, past) & (c["route"] == "model")
    return (ranges.where(F.exists("near", target))
            .withColumns({"targets": listed(target), "before": listed(lambda c: c["id"].between(first + 1 - context, first)),
                          "after": listed(lambda c: c["id"].between(past + 1, past + context)),
                          "samples": F.array().cast("array<struct<pos:bigint,text:string>>")}))


def near_range(context: int = fixed.CONTEXT_CUES):
    """What a range and its parts can ask for of the cues in ``near``."""
    return F.filter("near", lambda c: c["id"].between(F.col("first") + 1 - context, F.col("past") + context))


def response_schema(chunks: DataFrame) -> DataFrame:
    """JSON schema that pins a grouped answer to the chunk's ids."""
    ids = F.transform("targets", lambda c: c["id"])
    text = F.to_json(F.struct(
        F.lit("json_object").alias("type"),
        F.struct(F.lit("array").alias("type"), F.size("targets").alias("minItems"), F.size("targets").alias("maxItems"),
                 F.struct(F.lit("object").alias("type"),
                          F.struct(F.struct(F.lit("integer").alias("type"), ids.alias("enum")).alias("id"),
                                   F.struct(F.lit("string").alias("type")).alias("text")).alias("properties"),
                          F.array(F.lit("id"), F.lit("text")).alias("required"),
                          F.lit(False).alias("additionalProperties")).alias("items")).alias("schema")))
    return chunks.select("track_id", "chunk_no", text.alias("response_format"))
