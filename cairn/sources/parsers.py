"""Line parsers: each turns a text column into one struct column, null where the line does not fit.

The struct is RECORD; parsing is a projection over the scan, so Spark prunes and pushes as usual.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import let
from ..functions.times import JSON_FORMATS, parse_any, parse_time

RECORD = "struct<body:string,template:string,fields:map<string,string>,severity:string,timestamp:timestamp_ntz,level:string,message:string>"
_NAMES = ("body", "template", "fields", "severity", "timestamp", "level", "message")
#: Names of syslog facilities and severities by number.
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "mark", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
SEVERITIES = ("EMERG", "ALERT", "CRIT", "ERR", "WARNING", "NOTICE", "INFO", "DEBUG")


def record(valid: Column, **parts: Column) -> Column:
    """A RECORD of the given parts where valid; level and message default to ''."""
    default = {"fields": F.create_map().cast("map<string,string>"), "level": F.lit(""), "message": F.lit("")}
    kinds = {"fields": "map<string,string>", "timestamp": "timestamp_ntz"}
    cols = [parts.get(n, default.get(n, F.lit(None))).cast(kinds.get(n, "string")).alias(n) for n in _NAMES]
    return F.when(valid, F.struct(*cols))


def _last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays; of equal keys the last counts."""
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    kept = F.filter(entries, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["k"]) == 0)
    dealt = F.map_from_arrays(F.transform(kept, lambda e: e["k"]), F.transform(kept, lambda e: e["v"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(dealt)


def _map(pairs: dict[str, Column]) -> Column:
    """A string map without the null values."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def _special(values: dict[str, Column], datetime_format: str, year: int | None, reserved: set[str]) -> dict[str, Column]:
    parts: dict[str, Column] = {}
    for name in ("body", "severity", "level", "message"):
        if name in values and name in reserved:
            parts[name] = values[name]
    if "timestamp" in values:
        parts["timestamp"] = parse_any(values["timestamp"], (datetime_format, *JSON_FORMATS), year)
    parts["fields"] = _map({k: v for k, v in values.items() if k not in reserved and k != "timestamp"})
    return parts


def json_scalars(line: Column) -> Column:
    """Top-level scalars of a JSON object as text; null for anything else.  Nulls and nested values go."""
    # variants keep types apart: a nested value has no string form of its own, a string "[1]" has
    typed = F.from_json(line, "map<string,variant>")
    flat = F.map_filter(typed, lambda _, x: ~F.schema_of_variant(x).rlike("^(VOID|OBJECT|ARRAY)"))
    exact = F.transform_values(flat, lambda _, x: F.try_variant_get(x, "$", "string"))
    # only one brace and no bracket: nothing is nested; no number with a fraction or exponent: texts are the same
    plain = line.rlike(r"^\s*\{[^{\[]*$") & ~line.rlike(r":\s*-?\d+[.eE]")
    strings = F.map_filter(F.from_json(line, "map<string,string>"), lambda _, x: x.isNotNull())
    is_object = F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT")
    return F.when(plain, strings).when(is_object, exact)


def parse_json(line: Column, dimensions=(), datetime_format: str = "%Y-%m-%dT%H:%M:%SZ", year: int | None = None, **_) -> Column:
    """With dimensions: the listed keys, strings all of them, else the line is dropped.  Without:
    aliases message|msg, level|severity, timestamp|time, and every scalar key in fields."""
    if dimensions:
        v = F.try_parse_json(line)
        strings = {d: F.try_variant_get(v, f"$['{d}']", "string") for d in dimensions}
        ok = F.lit(True)
        for d in dimensions:
            ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$['{d}']", "variant")) == "STRING", F.lit(False))
        return record(ok, **_special(strings, datetime_format, year, {"body", "severity", "level", "message"}))

    def build(f: Column) -> Column:
        get = lambda k: F.try_element_at(f, F.lit(k))
        first = lambda a, b: F.coalesce(get(a), get(b))
        return record(
            f.isNotNull() & ~line.rlike(r"^\s*\{\s*\}\s*$"),
            fields=f,
            severity=first("severity", "level"),
            timestamp=let(first("timestamp", "time"), lambda t: parse_any(t, (datetime_format, *JSON_FORMATS), year)),
            level=F.coalesce(first("level", "severity"), F.lit("")),
            message=F.coalesce(first("message", "msg"), F.lit("")),
        )

    return let(json_scalars(line), build)


def parse_csv(line: Column, dimensions=(), delimiter: str = ",", datetime_format: str = "%Y-%m-%dT%H:%M:%SZ", quoted: bool = False, year: int | None = None, **_) -> Column:
    """Positional dimensions (all columns '0', '1', … without any); quoted=True keeps delimiters inside quotes."""
    if quoted:
        d = re.escape(delimiter)
        # fields one after another: quoted with doubled quotes inside, or bare
        raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
        cells = F.transform(raw, lambda x: F.btrim(F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x), F.lit(" \t\n\x0b\x0c\r")))
    else:
        cells = F.split(line, re.escape(delimiter), -1)
    if dimensions:
        values = {d: F.get(cells, i) for i, d in enumerate(dimensions)}
        return record(line.isNotNull(), **_special(values, datetime_format, year, {"body", "severity"}))
    keys = F.transform(F.sequence(F.lit(0), F.size(cells) - 1), lambda i: i.cast("string"))
    return record(line.isNotNull(), fields=F.map_from_arrays(keys, cells))


def parse_regex(line: Column, log_pattern: str, groups=(), datetime_format: str = "%Y-%m-%dT%H:%M:%SZ", year: int | None = None, **_) -> Column:
    """The whole line must match; groups are fields '1', '2', …, or named by groups."""
    n = re.compile(log_pattern).groups
    full = rf"\A(?:{log_pattern})\z"
    names = list(groups) + [str(i + 1) for i in range(len(groups), n)]
    values = {name: F.regexp_extract(line, full, i + 1) for i, name in enumerate(names[:n])}
    reserved = {"body", "severity", "level", "message"} if groups else set()
    parts = _special(values, datetime_format, year, reserved) if groups else {"fields": _map(values)}
    return record(line.rlike(full), **parts)


#: Stands between groups while a line is taken apart; patterns of all groups but the last exclude it.
_CUT = "\x1f"


def _groups(line: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern for the whole line, found in one match; groups that took no part are ''."""
    return F.split(F.regexp_replace(line, pattern, _CUT.join(f"${i + 1}" for i in range(n))), _CUT, n)


_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_BSD = r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"


def parse_syslog(line: Column, year: int | None = None, now: datetime | None = None, strict: bool = False, **_) -> Column:
    """Optional <priority>, time, host, program[pid], then the message.  strict needs a time and takes
    hosts with hyphens and dots."""
    pri = F.try_to_number(F.nullif(F.regexp_extract(line, r"^<(\d{1,3})>", 1), F.lit("")), F.lit("999")).cast("int")
    rest = F.regexp_replace(line, r"^<\d{1,3}>", "")
    host = r"[\w.-]+" if strict else r"\w+|\d+(?:\.\d+){3}"
    p = rf"(?s)^(?:({_BSD})|({_ISO})){'' if strict else '?'}\s*(?:({host})\s+)?(?:(\w+)(?:\[(\d+)\])?:)?\s*(.*)$"
    at = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    named = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    level = F.coalesce(named(SEVERITIES, pri.bitwiseAND(7)), F.lit("INFO"))

    def build(groups: Column) -> Column:
        g = [F.nullif(F.get(groups, i), F.lit("")) for i in range(6)]
        bsd = parse_time(g[0], "%b %d %H:%M:%S", year or datetime.now().year)
        iso = F.substr(g[1], F.lit(1), F.lit(19)).try_cast("timestamp_ntz")
        fields = _map({"facility": named(FACILITIES, F.shiftright(pri, 3)), "host": g[2], "program": g[3], "pid": g[4]})
        return record((line != "") & rest.rlike(p), fields=fields, timestamp=F.coalesce(bsd, iso, at), level=level, severity=F.when(pri.isNotNull(), level), message=F.coalesce(g[5], F.lit("")))

    return let(_groups(rest, p, 6), build)


def parse_line(line: Column, now: datetime | None = None, **_) -> Column:
    at = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    return record(line != "", timestamp=at, level=F.lit("INFO"), message=line)


def _unquoted(v: Column) -> Column:
    inner = F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), r'\\(["\\])', "$1")
    return F.when(v.startswith('"') & v.endswith('"') & (F.length(v) > 1), inner).otherwise(v)


def parse_logfmt(line: Column, year: int | None = None, **_) -> Column:
    pair = r'([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'
    keys = F.regexp_extract_all(line, F.lit(pair), F.lit(1))
    values = F.transform(F.regexp_extract_all(line, F.lit(pair), F.lit(2)), _unquoted)

    def build(f: Column) -> Column:
        get = lambda *ks: F.coalesce(*[F.try_element_at(f, F.lit(k)) for k in ks])
        level = get("level", "lvl", "severity")
        at = let(get("time", "ts", "timestamp"), lambda t: parse_any(t, ("%Y-%m-%dT%H:%M:%S", *JSON_FORMATS), year))
        return record(F.size(f) > 0, fields=f, severity=level, timestamp=at, level=F.coalesce(level, F.lit("")), message=F.coalesce(get("msg", "message"), F.lit("")))

    return let(F.struct(keys.alias("k"), values.alias("v")), lambda e: let(_last_wins(e["k"], e["v"]), build))


def parse_log4j(line: Column, **_) -> Column:
    p = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:[,.](\d{1,6}))?\s+([A-Z]+)\s+\[([^\]\x1f]*)\]\s+([^\s\x1f]+?):?\s*(?:(?<=:)|- |\s)\s*(.*)$"

    def build(groups: Column) -> Column:
        g = lambda i: F.get(groups, i - 1)
        ts = F.concat(g(1), F.lit("."), F.rpad(g(2), 6, "0")).try_cast("timestamp_ntz")
        return record(line.rlike(p), fields=_map({"thread": g(4), "logger": g(5)}), severity=g(3), timestamp=ts, level=g(3), message=g(6))

    return let(_groups(line, p, 6), build)


def parse_cef(line: Column, **_) -> Column:
    """Seven headers between unescaped bars, then key=value extensions whose values may hold spaces."""
    plain = lambda c: F.regexp_replace(c, r"\\([\\|=])", "$1")
    names = ("version", "vendor", "product", "device_version", "signature_id", "name", "severity")
    pair = r"(\w+)=((?:\\.|[^\\=])*)(?=\s+\w+=|\s*$)"

    def extension(text: Column) -> Column:
        keys = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
        values = F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(2)), lambda v: F.trim(plain(v)))
        return let(F.struct(keys.alias("k"), values.alias("v")), lambda e: _last_wins(e["k"], e["v"]))

    def build(parts: Column) -> Column:
        head = {n: plain(F.get(parts, i)) for i, n in enumerate(names)}
        head["version"] = F.regexp_replace(head["version"], r"^.*?CEF:", "")

        def whole(more: Column) -> Column:
            own = F.map_filter(more, lambda k, _: ~k.isin(list(names)))
            message = F.coalesce(F.try_element_at(more, F.lit("msg")), head["name"])
            return record(line.rlike(r"CEF:\d") & (F.size(parts) >= 7), fields=F.map_concat(_map(head), own), severity=head["severity"], level=head["severity"], message=message)

        return let(extension(F.coalesce(F.get(parts, 7), F.lit(""))), whole)

    return let(F.split(line, r"(?<!\\)\|", 8), build)


def parse_xml(line: Column, datetime_format: str = "%Y-%m-%dT%H:%M:%SZ", year: int | None = None, **_) -> Column:
    """One element: its attributes and the elements inside that hold text only, at any depth and under their own
    names, are the fields; of equal names the last counts; names as in JSON."""
    name = r"[A-Za-z_][\w.\-]*"
    plain = lambda v: F.replace(F.replace(F.replace(F.replace(F.replace(v, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    found = lambda text, p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    head, pair, child = F.regexp_extract(line, rf"^\s*<{name}([^>]*)>", 1), rf'({name})="([^"]*)"', rf"<({name})(?:\s[^<>]*)?>([^<]*)</\1\s*>"
    inner = F.regexp_extract(line, rf"(?s)^\s*<{name}[^>]*>(.*)</", 1)
    keys = F.concat(found(head, pair, 1), found(inner, child, 1))
    values = F.transform(F.concat(found(head, pair, 2), found(inner, child, 2)), plain)

    def build(f: Column) -> Column:
        get = lambda *ks: F.coalesce(*[F.try_element_at(f, F.lit(k)) for k in ks])
        ok = line.rlike(rf"(?s)^\s*<({name})[\s>].*</\1>\s*$") & (F.size(f) > 0)
        at = let(get("timestamp", "time"), lambda t: parse_any(t, (datetime_format, *JSON_FORMATS), year))
        level = get("level", "severity")
        return record(ok, fields=f, severity=get("severity", "level"), timestamp=at, level=F.coalesce(level, F.lit("")), message=F.coalesce(get("message", "msg"), F.lit("")))

    return let(F.struct(keys.alias("k"), values.alias("v")), lambda e: let(_last_wins(e["k"], e["v"]), build))


#: Parsers by format name.
PARSERS: dict[str, Callable[..., Column]] = {
    "json": parse_json,
    "jsonl": parse_json,
    "csv": parse_csv,
    "tsv": lambda line, **o: parse_csv(line, **({"delimiter": "\t"} | o)),
    "regex": parse_regex,
    "syslog": parse_syslog,
    "line": parse_line,
    "text": parse_line,
    "logfmt": parse_logfmt,
    "log4j": parse_log4j,
    "cef": parse_cef,
    "xml": parse_xml,
}


def parse_rows(df: DataFrame, line: str, format: str, *keep: str, **options) -> DataFrame:
    """The columns keep and the record's columns of the lines that fit.

    A generator gives the records: a filter on them would be pushed below the projection and parse each line again.
    """
    found = F.filter(F.array(parser(format)(F.col(line), **options)), lambda r: r.isNotNull())
    return df.select(*keep, F.inline(found))


def parser(name: str) -> Callable[..., Column]:
    if name.lower() not in PARSERS:
        raise ValueError(f"unknown format {name!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name.lower()]
