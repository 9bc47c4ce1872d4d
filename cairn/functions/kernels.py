"""String kernels as column expressions.  Positions are 0-based and count characters, not bytes
(the same for ASCII; cast to binary for byte positions)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that trimming takes off.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_char(s: Column, c: str, r: str) -> Column:
    return F.translate(s, c, r)


def replace_chars(s: Column, chars: str, r: str) -> Column:
    return F.translate(s, chars, r * len(chars))


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def contains(s: Column, needle: str) -> Column:
    return F.contains(s, F.lit(needle))


def split(s: Column, delimiter: str) -> Column:
    """Parts between delimiters; inner empty parts stay, a last empty part goes, '' gives none."""
    parts = F.split(s, re.escape(delimiter), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def to_lower(s: Column) -> Column:
    """ASCII letters only."""
    return F.translate(s, UPPER, LOWER)


def find_char(s: Column, c: str) -> Column:
    return F.nullif(F.instr(s, F.lit(c)), F.lit(0)) - 1


def find_substring(s: Column, needle: str) -> Column:
    return find_char(s, needle) if needle else F.lit(None).cast("int")


def find_last(s: Column, c: str) -> Column:
    return F.length(s) - F.nullif(F.instr(F.reverse(s), F.lit(c)), F.lit(0))


def count_char(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def find_all_char(s: Column, c: str) -> Column:
    """All positions, in order: one pass over the text's characters."""
    at = F.transform(F.split(s, ""), lambda x, i: F.when(x == c, i))
    return F.filter(at, lambda x: x.isNotNull())


def substring_to(s: Column, delimiter: str) -> Column:
    """Up to the first delimiter, or all."""
    return F.substring_index(s, delimiter, 1)


def find_newline(s: Column) -> Column:
    """The first line feed, else the first carriage return."""
    return F.coalesce(find_char(s, "\n"), find_char(s, "\r"))


def substring_at(s: Column, position: Column | int, n: int) -> Column:
    """n characters from a position on, fewer at the end."""
    return F.substr(s, (F.lit(position) if isinstance(position, int) else position) + 1, F.lit(n))


def advance(s: Column, position: Column, n: int) -> Column:
    """The position n characters on, at most the end."""
    return F.least(position + n, F.length(s))


def at_end(s: Column, position: Column) -> Column:
    return position >= F.length(s)


def has_field(fields: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, name), F.lit(False))


def get_field(fields: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit(""))


def set_field(fields: Column, name: str, value: Column) -> Column:
    others = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), value))


def json_path(s: Column, path: str) -> Column:
    """A dotted path; parts that are numbers are array positions: 'choices.0.text'."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(s, "$" + steps)


def percent_encode(s: Column) -> Column:
    """All but letters, digits and '-_.~' as %XX of the UTF-8 bytes."""
    form = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def is_number(token: Column) -> Column:
    """A digit, or a digit, sign or dot followed by digits with one dot at most in all."""
    return F.when(F.length(token) == 1, token.rlike("^[0-9]$")).otherwise(token.rlike(r"^([0-9+-][0-9]*\.?[0-9]*|\.[0-9]+)$"))
