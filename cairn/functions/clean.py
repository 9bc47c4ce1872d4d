"""Line cleaning, term extraction, timestamps inside lines, attributes by pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .times import parse_any

#: Characters that the default mode turns into spaces.
DELIMITERS = ",;:|\t[]{}()<>"
#: Patterns of timestamps inside a line with their formats, in the order they are tried.
TIMESTAMPS = (
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "%Y-%m-%dT%H:%M:%S"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "%Y-%m-%d %H:%M:%S"),
    (r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}", "%d/%b/%Y:%H:%M:%S"),
    (r"\w{3} \d{2} \d{2}:\d{2}:\d{2}", "%b %d %H:%M:%S"),
)
#: Fields that may hold a record's time.
TIME_FIELDS = ("timestamp", "time", "date", "datetime", "created_at")
#: Headers that template mining takes off a line; the first that fits, once.
HEADERS = (
    r"^\[.*?\]\s*",
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?\s+",
    r"^\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?\s+",
    r"(?i)^\s*(?:ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|FATAL)\s*:?\s*",
    r"^\w+\s+\w+\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\d{4}\s+",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s+",
)


def check_patterns(patterns) -> None:
    """Raises for a pattern that cannot be compiled, naming it."""
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"bad pattern {p!r}: {e}") from e


def clean_line(line: Column, mode: str = "chars", delimiters=(), replacements=()) -> tuple[Column, Column]:
    """(cleaned, terms) of a line.

    mode 'chars' (the default) turns the fixed delimiters into spaces, folds runs of spaces and trims;
    mode 'regex' turns each of the given delimiter patterns into one space.  Then each (pattern,
    replacement) is applied in order; terms maps replacements to what their patterns had matched.
    """
    check_patterns([*delimiters, *(p for p, _ in replacements)])
    if mode == "chars":
        out = F.trim(F.regexp_replace(F.translate(line, DELIMITERS, " " * len(DELIMITERS)), " +", " "))
    elif mode == "regex":
        out = line
        for d in delimiters:
            out = F.regexp_replace(out, d, " ")
    else:
        raise ValueError("mode is 'chars' or 'regex'")
    terms: dict[str, Column] = {}
    for pattern, replacement in replacements:
        terms[replacement] = F.regexp_extract_all(out, F.lit(pattern), F.lit(0))
        out = F.regexp_replace(out, pattern, re.sub(r"([\\$])", r"\\\1", replacement))
    found = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), v)]) if terms else F.create_map().cast("map<string,array<string>>")
    return out, found


def clean_lines(df: DataFrame, column: str = "value", **options) -> DataFrame:
    """df with cleaned and terms."""
    cleaned, terms = clean_line(F.col(column), **options)
    return df.withColumns({"cleaned": cleaned, "terms": terms})


def identify_timestamp(body: Column, fields: Column | None = None, year: int | None = None) -> Column:
    """The first timestamp found in body, else in the time fields, in their listed order."""

    def within(text: Column) -> list[Column]:
        return [parse_any(F.regexp_extract(text, p, 0), (f,), year) for p, f in TIMESTAMPS]

    tries = within(body)
    if fields is not None:
        for name in TIME_FIELDS:
            tries += within(F.try_element_at(fields, F.lit(name)))
    return F.coalesce(*tries)


def extract_attributes(df: DataFrame, patterns: dict[str, str], column: str = "value") -> DataFrame:
    """df with a column per name: the first group of the pattern's first match, '' without a match or group."""
    check_patterns(patterns.values())
    return df.withColumns({name: F.regexp_extract(column, p, 1) if re.compile(p).groups else F.lit("") for name, p in patterns.items()})


def strip_header(line: Column, patterns=HEADERS) -> Column:
    """What follows the first header pattern that fits and leaves something; else the line."""
    tries = [F.when(line.rlike(p) & (F.regexp_replace(line, p, "") != ""), F.regexp_replace(line, p, "")) for p in patterns]
    return F.coalesce(*tries, line)


def extract_patterns(text: Column, pattern: str) -> Column:
    """All matches of a pattern, or of its first group if it has one."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0))
