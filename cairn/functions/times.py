"""Timestamps: texts to TIMESTAMP_NTZ by strptime-style formats, and intervals such as '5m'."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format letters: the Java pattern and the regular expression of what they take.
_PARTS = {"Y": ("yyyy", r"\d{4}"), "m": ("M", r"\d{1,2}"), "d": ("d", r"\d{1,2}"), "H": ("H", r"\d{1,2}"), "M": ("m", r"\d{1,2}"), "S": ("s", r"\d{1,2}"), "b": ("MMM", r"[A-Z][a-z]{2}"), "y": ("yy", r"\d{2}"), "f": ("SSSSSS", r"\d{6}")}
#: The formats that JSON timestamps are tried with, in order.
JSON_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S", "%b %d %H:%M:%S", "%Y-%m-%dT%H:%M:%S")


def _translate(fmt: str) -> tuple[str, str]:
    """(Java pattern, regular expression) of a strptime format."""
    java, rx, i = "", "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in _PARTS:
                raise ValueError(f"format letter %{fmt[i + 1]} is not supported")
            a, b = _PARTS[fmt[i + 1]]
            java, rx, i = java + a, rx + b, i + 2
        elif fmt[i] == " ":
            java, rx, i = java + " ", rx + r"\s+", i + 1
        else:
            java, rx, i = java + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), rx + re.escape(fmt[i]), i + 1
    return java, rx


def parse_time(s: Column, fmt: str, year: int | None = None) -> Column:
    """The timestamp at the start of s (what follows is ignored), null if there is none.

    A format without a year needs one.
    """
    java, rx = _translate(fmt)
    text = F.regexp_replace(F.regexp_extract(s, rf"^\s*({rx})", 1), r"\s+", " ")
    if "%Y" not in fmt and "%y" not in fmt:
        if year is None:
            return F.lit(None).cast("timestamp_ntz")
        java, text = "yyyy " + java, F.when(text != "", F.concat(F.lit(f"{year} "), text))
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(java)).cast("timestamp_ntz")


#: Formats of one layout, year to second in 19 characters.
_ISO = ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S")


def parse_any(s: Column, formats=JSON_FORMATS, year: int | None = None) -> Column:
    """The timestamp by the first of the formats that fits.

    Where the first format is an ISO one and both ISO forms are among them, texts of that layout are cast
    without trying patterns one by one; the patterns are for the others.
    """
    slow = [parse_time(s, f, year) for f in formats]
    if formats[0] not in _ISO or not {"%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"} <= set(formats):
        return F.coalesce(*slow)
    fits = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")
    return F.coalesce(F.when(fits, F.substr(s, F.lit(1), F.lit(19)).try_cast("timestamp_ntz")), *slow)


def format_time(ts: Column) -> Column:
    """Seconds; fractions are cut off."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def interval(text: str) -> timedelta:
    """'30s', '5m', '1h', '2d', '1w'."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
    return timedelta(**{unit: int(m[1])})


def interval_column(text: str) -> Column:
    return F.make_dt_interval(secs=F.lit(interval(text).total_seconds()))
