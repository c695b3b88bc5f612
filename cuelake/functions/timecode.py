"""Cue time: offsets from the start of the media, as whole milliseconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.operators.ordered import div

CODE = r"^(\d{2,}):(\d{2}):(\d{2}),(\d{3})$"


def seconds_to_ms(seconds: Column) -> Column:
    """Half-even rounding, never below zero."""
    return F.greatest(F.lit(0), F.rint(seconds * 1000).cast("long"))


def format_ms(ms: Column) -> Column:
    ms = F.greatest(ms, F.lit(0)).cast("long")
    hours = div(ms, 3_600_000)

    def digits(value, count):
        return F.lpad(value.cast("string"), count, "0")
    return F.concat(F.when(hours < 10, F.lit("0")).otherwise(""), hours.cast("string"), F.lit(":"), digits(div(ms, 60_000) % 60, 2),
                    F.lit(":"), digits(div(ms, 1000) % 60, 2), F.lit(","), digits(ms % 1000, 3))


def parse_ms(code: Column) -> Column:
    """Milliseconds, or null for a code that is malformed or has 60+ minutes or seconds."""
    h, m, s, f = (F.regexp_extract(code, CODE, i).try_cast("long") for i in (1, 2, 3, 4))
    return F.when((m <= 59) & (s <= 59), ((h * 60 + m) * 60 + s) * 1000 + f)
