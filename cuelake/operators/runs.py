"""Run logs and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake import fixed
from cuelake.functions.text import strip
from cuelake.operators.ordered import div, lag, running_sum, scan

RUN = ["run_id"]
ANSI_COLOUR = "\\x1b\\[[0-9;]*m"


def log_sanitise(lines: DataFrame) -> DataFrame:
    """Lines (text or raw bytes) without NUL, colour codes and bad UTF-8; empty ones go."""
    text = F.make_valid_utf8(F.col("line").cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, "\\x00", ""), ANSI_COLOUR, "")
    return lines.withColumn("line", F.regexp_replace(text, "[\r\n]+$", "")).where("line <> ''")


def summary_parse(lines: DataFrame) -> DataFrame:
    """Key and value of each summary line between the first start and the next end; last key wins."""
    line = strip(F.col("line"))
    start = F.col("text").contains("PIPELINE") & F.col("text").endswith(f"{fixed.RESULT_START} ---")
    opened = scan(lines.withColumn("text", line), RUN, ["line_no"], starts=running_sum(start.cast("int")))
    end = F.col("text").contains(fixed.RESULT_END) & ~start
    inside = (scan(opened.where("starts > 0"), RUN, ["line_no"], ends=running_sum(end.cast("int")))
              .where((F.col("ends") == 0) & ~start & (F.instr("text", "=") > 1)))
    return (inside.withColumn("key", F.substring_index("text", "=", 1))
            .withColumn("value", F.expr("substring(text, length(key) + 2)"))
            .groupBy("run_id", "key").agg(F.max_by("value", "line_no").alias("value")))


def progress_percent(line: Column) -> Column:
    value = F.regexp_extract(strip(line), f"^{fixed.PROGRESS_PREFIX}\\+?([0-9]+)$", 1).try_cast("int")
    return F.when(value <= 99, value)


def stage_classify(lines: DataFrame) -> DataFrame:
    """Adds ``stage, label, percent``; null for lines that say nothing."""
    line, percent = F.col("line"), progress_percent(F.col("line"))
    progress = F.startswith(strip(line), F.lit(fixed.PROGRESS_PREFIX))
    kind = (F.when(progress, F.when(percent.isNotNull(), "progress"))
            .when(line.contains(fixed.ENGINE_MARKER), "engine")
            .when(line.contains(fixed.RESULT_START), "result")
            .when(line == fixed.COMPLETE_LINE, "done"))
    named = lines.withColumn("_kind", kind)
    def pick(**names):
        return F.coalesce(*[F.when(F.col("_kind") == k, v) for k, v in names.items()])
    return (named.withColumn("stage", pick(progress="ocr", engine="ocr", result="finalize", done="complete"))
            .withColumn("label", pick(progress=fixed.STAGE_LABELS["ocr"], engine=fixed.STAGE_LABELS["engine"],
                                      result=fixed.STAGE_LABELS["finalize"], done=fixed.STAGE_LABELS["complete"]))
            .withColumn("percent", F.when(F.col("_kind") == "progress", percent)
                        .when(F.col("_kind") == "done", 100))
            .drop("_kind"))


def failure_message(lines: DataFrame, code: int) -> DataFrame:
    """Last error line of a run, else its last line with text, with the exit code."""
    line = F.col("line")
    is_error, blank = F.startswith(line, F.lit(fixed.ERROR_PREFIX)), strip(line) == ""
    found = lines.groupBy("run_id").agg(
        F.max_by("line", F.when(is_error, F.col("line_no"))).alias("error"),
        F.max_by("line", F.when(~blank, F.col("line_no"))).alias("last"))
    detail = strip(F.regexp_replace(F.coalesce("error", "last"), f"^(?:{fixed.ERROR_PREFIX})+", ""))
    return found.select("run_id", F.when(F.coalesce(detail, F.lit("")) != "",
                                         F.concat(detail, F.lit(f" (pipeline code: {code})")))
                        .otherwise(f"Pipeline exited with code {code}").alias("message"))


def cancel_classify(message: Column) -> Column:
    """``COMPLETE`` without a message, ``CANCELLED`` only for the exact one, else ``FAILED``."""
    return (F.when(message.isNull(), "COMPLETE")
            .when(strip(message) == fixed.CANCELLED_MESSAGE, "CANCELLED").otherwise("FAILED"))


def attempt_rollup(attempts: DataFrame) -> DataFrame:
    """Per run: attempts, their seconds, the last status, and why a second one was needed."""
    rolled = attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.round(F.sum("seconds"), 3).alias("attempt_seconds"),
        F.max_by("status", "attempt_no").alias("last_status"), F.min_by(F.struct("error"), "attempt_no").alias("first"))
    return (rolled.withColumn("fallback_reason", F.when(F.col("attempts") > 1, F.col("first.error")))
            .drop("first"))


def metrics_flatten(runs: DataFrame) -> DataFrame:
    """Every field of a run's report (JSON in ``metrics``) as a typed column, and the recomputed unattributed time.

    ``bad_fields`` lists fields that are there but not of their type; such a field is null, as is every field of a
    report that is no JSON object.  ``unattributed_seconds`` is what the attributed stages leave of the total.
    """
    keys = [c for c in runs.columns if c != "metrics"]

    def entries(fields):
        """The named entries of a report in one pass over it."""
        return F.try_variant_get("m", F.lit("$"), "struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields) + ">")
    # As a string every value but JSON's null has a form, so a field that has only that is of another type.
    read = (runs.withColumn("m", F.try_parse_json("metrics"))
            .withColumn("t", entries([*fixed.METRIC_FIELDS, ("ocr_stage_seconds", "map<string,double>")]))
            .withColumn("s", entries([(n, "string") for n, t in fixed.METRIC_FIELDS if t != "string"])))
    typed, shown = F.col("t"), F.col("s")
    bad = F.array_compact(F.array(*[F.when(shown[n].isNotNull() & typed[n].isNull(), n) for n, t in fixed.METRIC_FIELDS if t != "string"]))
    known = F.map_filter(typed["ocr_stage_seconds"], lambda k, v: k.isin(fixed.ATTRIBUTED_STAGES))
    attributed = F.aggregate(F.map_values(known), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return (read.select(*keys, *[typed[n].alias(n) for n, t in fixed.METRIC_FIELDS], bad.alias("bad_fields"), attributed.alias("_attributed"))
            .withColumn("unattributed_seconds", F.when(F.col("ocr_total_seconds").isNotNull(), F.round(
                F.greatest(F.lit(0.0), F.col("ocr_total_seconds") - F.coalesce("_attributed", F.lit(0.0))), 3)))
            .drop("_attributed"))


def metrics_nested(runs: DataFrame) -> DataFrame:
    """Entries of the nested parts of a report as rows: ``field, place, key, value``; lists have places and no keys."""
    keys = [c for c in runs.columns if c != "metrics"]
    read = runs.withColumn("m", F.try_parse_json("metrics"))
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.try_variant_get("m", F.lit(f"$.{n}"), "variant").alias("part")) for n in fixed.METRIC_NESTED])
    held = read.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.field", "p.part").where("part IS NOT NULL")
    return (held.lateralJoin(runs.sparkSession.tvf.variant_explode(F.col("part").outer()))
            .select(*keys, "field", F.col("pos").cast("long").alias("place"), "key", F.col("value").cast("string").alias("value")))


def summary_render(reports: DataFrame, fields: dict[str, Column], version: str) -> DataFrame:
    """``Key=Value`` block of each run between its markers; missing values are empty."""
    body = [F.concat(F.lit(f"{key}="), F.coalesce(value.cast("string"), F.lit(""))) for key, value in fields.items()]
    mark = f"--- TRACK PIPELINE {version} RESULT"
    return reports.select("run_id", F.concat_ws("\n", F.lit(f"{mark} START ---"), *body,
                                                F.lit(f"{mark} END ---")).alias("summary"))


def latest_per_group(reports: DataFrame, group: str, order: list[str], content: str) -> DataFrame:
    """Latest content per group and how many dated ones there are."""
    rank = F.struct(*order)
    return reports.groupBy(group).agg(F.max_by(content, rank).alias("latest"), F.count(F.lit(1)).alias("history"))


def telemetry_extract(lines: DataFrame) -> DataFrame:
    """First offload counter and first valid memory pair of each run."""
    line = F.lower("line")
    after = F.substring(line, F.locate("offloaded ", line) + 10, F.length(line))
    counts = F.when(F.contains(line, F.lit("offloaded ")) & F.contains(after, F.lit(" layers to gpu")),
                    F.substring_index(after, " layers to gpu", 1))
    layers = strip(F.substring_index("counts", "/", 1))
    of = strip(F.expr("substring(counts, instr(counts, '/') + 1)"))
    number = r"^\+?\d{1,18}$"
    pair = F.when(layers.rlike(number) & of.rlike(number) & F.contains("counts", F.lit("/")),
                  F.struct(layers.cast("long").alias("layers"), of.cast("long").alias("total")))
    fields = F.split("line", ",")
    a, b = strip(fields[0]), strip(F.coalesce(F.get(fields, F.lit(1)), F.lit("")))
    memory = F.when(a.rlike(number) & b.rlike(number), F.struct(a.cast("long").alias("total"), b.cast("long").alias("free")))
    memory = F.when(memory["total"] >= memory["free"], memory)
    marked = lines.withColumn("counts", counts).withColumn("pair", pair).withColumn("memory", memory)
    found = marked.groupBy("run_id").agg(
        F.min_by("pair", F.when(F.col("pair").isNotNull(), F.col("line_no"))).alias("pair"),
        F.min_by("memory", F.when(F.col("memory").isNotNull(), F.col("line_no"))).alias("memory"))
    return found.select("run_id", F.col("pair.layers").alias("layers"), F.col("pair.total").alias("layer_total"),
                        F.col("memory.total").alias("memory_total"), F.col("memory.free").alias("memory_free"))


def progress_marks(frames: DataFrame) -> DataFrame:
    """Rows at which the percent of a track's frames rises; ``reported`` frames must be known.

    Frames come in index order, so the percent before is the highest one before.
    """
    percent = F.least(F.lit(99), F.greatest(F.lit(0), div(F.col("idx") * 100, F.col("reported"))))
    known = frames.where("reported > 0").withColumn("percent", percent.cast("long"))
    return (scan(known, ["track_id"], ["idx"], before=lag(F.col("percent")))
            .where(F.coalesce(F.col("percent") > F.col("before"), F.lit(True)))
            .select("track_id", "idx", "percent"))
