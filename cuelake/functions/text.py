"""Text rules shared by the operators; native expressions unless a rule needs Unicode tables."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

NOT_ALNUM = r"[^\p{L}\p{N}]+"
LETTER = r"\p{IsAlphabetic}"
# Unicode White_Space without the plain space, as a class body, and with it as characters
RARE_BLANKS = "\\t-\\r\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
BLANK_CHARS = "\t\n\x0b\x0c\r \x85\xa0                　"
# Rules on recognised texts and cue bodies count the four separators U+001C to U+001F as blanks as well
WIDE_BLANKS = RARE_BLANKS + "\\x1C-\\x1F"
WIDE_BLANK_CHARS = BLANK_CHARS + "\x1c\x1d\x1e\x1f"


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not just spaces."""
    return F.trim(text, F.lit(BLANK_CHARS))


def trimmed(text: Column) -> Column:
    """``strip`` of a plain column: only texts that begin with a blank, or end with the last byte of one, are walked through."""
    last = sorted({c.encode()[-1:].hex().upper() for c in BLANK_CHARS})
    edge = F.ascii(text).isin([ord(c) for c in BLANK_CHARS]) | F.hex(F.substring(text.cast("binary"), -1, 1)).isin(last)
    return F.when(edge, strip(text)).otherwise(text)


def is_blank(text: Column) -> Column:
    """Whether nothing is left when stripped; looks at a text up to its first other character only."""
    return F.ltrim(text, F.lit(BLANK_CHARS)) == ""


def strip_body(text: Column) -> Column:
    """Trim Unicode blanks and separators, as bodies of cues need it."""
    return F.trim(text, F.lit(WIDE_BLANK_CHARS))


def visible_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{RARE_BLANKS} ]+", ""))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{LETTER}]+", ""))


def number_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{N}+", ""))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_ALNUM, ""))


def has_letter(text: Column) -> Column:
    return text.rlike(LETTER)


def squeeze(text: Column) -> Column:
    """Trimmed, with every run of blanks as one space; single spaces are left alone."""
    return strip_body(F.regexp_replace(text, f"[{WIDE_BLANKS} ]{{2,}}|[{WIDE_BLANKS}]", " "))


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text.casefold()) if c.isalnum())


@F.pandas_udf(StringType())
def _fold_key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_text(t))


def at_most_two(text: Column, least: int) -> Column:
    """Whether the text with blanks collapsed has ``least`` to two characters."""
    blank = f"[{WIDE_BLANKS} ]*"
    return text.rlike(f"^{blank}[^{WIDE_BLANKS} ]{{{least},2}}{blank}\\z")


def norm_body_value(body: str) -> str:
    return " ".join(body.split()).casefold()


@F.pandas_udf(StructType().add("body", StringType()).add("norm", StringType()))
def exact_forms(texts: pd.Series) -> pd.DataFrame:
    """NFC form, and that form with blanks collapsed and casefolded."""
    bodies = texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
    return pd.DataFrame({"body": bodies, "norm": bodies.map(lambda t: None if t is None else norm_body_value(t))})


# Characters for which lower case equals casefold and NFC/NFKC change nothing.
STABLE = r"^[\t-\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00DE\u00E0-\u00F6\u00F8-\u00FF\u4E00-\u9FFF]*$"


def is_stable(text: Column) -> Column:
    return text.rlike(STABLE)


def text_key(text: Column) -> Column:
    """Comparison key: casefold, NFKC, letters and digits only."""
    stable = is_stable(text)
    return (F.when(stable, F.lower(F.regexp_replace(text, NOT_ALNUM, "")))
            .otherwise(_fold_key(F.when(~stable, text))))
