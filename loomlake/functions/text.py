"""Column expressions: cleaning, coercion, value tests. All stay in the JVM."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Null words of the reader, boolean words, date formats in order of trial, thresholds.
NULL_WORDS = ["", "nan", "None"]
BOOLEANS = (["true", "false"], ["yes", "no"])
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd"]
#: What every date or time begins with: a number or sign, T before a time, or the name of a month.
DATE_START = r"(?i)^[\x00-\x20\x7f]*(?:[-+]?\d|T\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DATE_HINTS = ["date", "_at", "signup"]
NUMERIC_SHARE, DATE_SHARE = 0.95, 0.90
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def clean_names(df: DataFrame) -> DataFrame:
    """Headers trimmed, lower-cased, spaces to underscores; names that collide are an error."""
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide once cleaned: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def clean_text(c: Column) -> Column:
    """All white space at the ends goes; empty cells and the null words become null."""
    bare = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    return F.when(~bare.isin(NULL_WORDS), bare)


def as_number(c: Column) -> Column:
    """The number a text spells, else null; suffixes such as 1d are no numbers."""
    return F.when(c.rlike(NUMBER), F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"))


def as_date(c: Column) -> Column:
    """yyyy-MM-dd of a text in any of the known formats (month first where both read), else null."""
    return F.date_format(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """Spark's own English stop words, those that are single words."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(sorted(w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha()))


def is_prose(c: Column) -> Column:
    """At least 12 words, and over a fifth of them stop words or over 40 characters."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\b\w+\b)"), F.lit(1))
    stop = F.size(F.filter(tokens, lambda t: t.isin(*stop_words())))
    return (F.size(tokens) >= 12) & ((stop / F.size(tokens) > 0.2) | (F.length(c) > 40))


def is_date(c: Column) -> Column:
    """Whether a text reads as a date or time. Only those that begin like one are parsed, which takes long where it fails."""
    return F.when(c.rlike(DATE_START) & c.rlike(r"\d.*\d"), F.coalesce(F.try_to_timestamp(c).cast("string"), as_date(c)).isNotNull()).otherwise(c.isNull())


def looks_like_list(c: Column) -> Column:
    return c.rlike(r"^\s*\[.*\]\s*$")


def word_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
