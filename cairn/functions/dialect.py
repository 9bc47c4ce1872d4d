"""SQL pass-through: the analytical dialect users write, turned into Spark SQL.

Only text outside quotes and comments is rewritten: names, calls with their arguments, and brackets; it is no parser
of SQL, and what it leaves alone is Spark's to accept or refuse.  UNION BY NAME, SUMMARIZE and the short PIVOT statement
resolve columns, so execute() runs them as DataFrames; joins that have no equivalent as text (ASOF JOIN,
POSITIONAL JOIN) are library functions: operators.retrieval.asof_join and positional_join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_QUOTED = re.compile(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|--[^\n]*|/\*.*?\*/)""", re.S)
_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK"}
#: Functions that only have another name here.
NAMES = {"arg_max": "max_by", "arg_min": "min_by", "quantile_cont": "percentile", "list": "collect_list", "regexp_matches": "regexp_like", "unnest": "explode", "list_transform": "transform", "list_filter": "filter", "strlen": "octet_length", "array_to_string": "array_join", "list_contains": "array_contains", "list_distinct": "array_distinct", "list_sort": "array_sort", "struct_pack": "named_struct"}
#: Letters of time formats.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%y": "yy", "%f": "SSSSSS", "%j": "DDD"}


def java_format(fmt: str) -> str:
    """The Java pattern of a strftime format; letters outside its codes are quoted."""

    def part(m: re.Match) -> str:
        if m[0][0] != "%":
            return "'" + m[0].replace("'", "''") + "'"
        if m[0] == "%%":
            return "%"
        if m[0] not in STRFTIME:
            raise ValueError(f"format letter {m[0]} is not supported")
        return STRFTIME[m[0]]

    return re.sub("%[A-Za-z%]|[A-Za-z']+", part, fmt)


def _plain(code: str) -> str:
    for old, new in NAMES.items():
        code = re.sub(rf"\b{old}\s*\(", f"{new}(", code, flags=re.I)
    code = re.sub(r"\b(lag|lead|first_value|last_value|nth_value)\s*\(([^()]*?)\s+IGNORE\s+NULLS\s*\)", r"\1(\2) IGNORE NULLS", code, flags=re.I)
    code = re.sub(r"\*\s*EXCLUDE\s*\(", "* EXCEPT (", code, flags=re.I)
    code = re.sub(r"\*\s*EXCLUDE\s+(\w+)", r"* EXCEPT (\1)", code, flags=re.I)
    code = re.sub(r"\bUSING\s+SAMPLE\s+(\d+(?:\.\d+)?)\s*%", r"TABLESAMPLE (\1 PERCENT)", code, flags=re.I)
    code = re.sub(r"\bSIMILAR\s+TO\b", "RLIKE", code, flags=re.I)
    code = re.sub(r"(?<![/:])//(?!/)", " div ", code)
    code = re.sub(r"\)\s*FILTER\s*\(\s*(?!WHERE\b)", ") FILTER (WHERE ", code, flags=re.I)
    code = re.sub(r"(::\s*|\bAS\s+)(?:VARCHAR|TEXT)\b(?!\s*\()", r"\1STRING", code, flags=re.I)
    code = re.sub(r"(::\s*|\bAS\s+)HUGEINT\b", r"\1DECIMAL(38, 0)", code, flags=re.I)
    return re.sub(r"\blambda\s+(\w+(?:\s*,\s*\w+)*)\s*:", lambda m: f"({m[1]}) ->" if "," in m[1] else f"{m[1]} ->", code, flags=re.I)


def _string(text: str, before: str) -> str:
    """A quoted string, seen with the code before it."""
    if text[0] == '"':
        return "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`"
    if text[0] != "'":
        return text
    body = text[1:-1].replace("''", "'")
    if m := re.search(r"\bINTERVAL\s*$", before, re.I):
        if u := re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", body):
            return f"{u[1]} {_UNITS[u[2]]}"
        del m
    if re.search(r"\bSIMILAR\s+TO\s*$", before, re.I):
        body = f"^(?:{body})$"
    # a backslash is itself in the dialect
    return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strftime(sql: str) -> str:
    """strftime(x, 'format'), its quotes already Spark's, to date_format."""

    def call(m: re.Match) -> str:
        pattern = java_format(m[2].replace("\\'", "'")).replace("'", "\\'")
        return f"date_format({m[1]}, '{pattern}')"

    return re.sub(r"\bstrftime\s*\(((?:[^()']|\([^()]*\))*),\s*'((?:[^'\\]|\\.)*)'\s*\)", call, sql, flags=re.I)


#: A piece of Spark SQL: a quoted string, a quoted name, or one other character.
_PIECE = re.compile(r"""'(?:[^'\\]|\\.)*'|`(?:[^`]|``)*`|.""", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _pieces(sql: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _PIECE.finditer(sql)]


def _arguments(sql: str, begin: int) -> tuple[list[str], int] | None:
    """The texts between the commas of a bracket that opens before begin, and where it closes; None if it doesn't."""
    depth, last, out = 0, begin, []
    for at, t in _pieces(sql[begin:]):
        at += begin
        if t in _PAIRS:
            depth += 1
        elif t in (")", "]", "}"):
            if depth == 0:
                return out + [sql[last:at].strip()], at
            depth -= 1
        elif t == "," and depth == 0:
            out.append(sql[last:at].strip())
            last = at + 1
    return None


def _called(sql: str, change: dict) -> str:
    """sql with calls of the named functions rewritten from their arguments, inner ones first."""
    names = re.compile(rf"\b({'|'.join(change)})\s*\(", re.I)
    inside = [(at, at + len(t)) for at, t in _pieces(sql) if len(t) > 1]
    for m in reversed([m for m in names.finditer(sql) if not any(a < m.start() < b for a, b in inside)]):
        if got := _arguments(sql, m.end()):
            new = change[m[1].lower()](*got[0])
            if new is not None:
                sql = sql[: m.start()] + new + sql[got[1] + 1 :]
    return sql


def _literal(text: str) -> str | None:
    """The value of a Spark string literal."""
    return re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S) if re.fullmatch(r"'(?:[^'\\]|\\.)*'", text, re.S) else None


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _string_split(text: str, separator: str) -> str:
    value = _literal(separator)
    if value is None:
        return f"split({text}, concat('\\\\Q', {separator}, '\\\\E'))"
    return f"split({text}, {_quoted(re.sub(r'([^A-Za-z0-9 _])', lambda m: chr(92) + m[1], value))})"


def _json_path(path: str) -> str:
    value = _literal(path)
    return path if value is None or value.startswith("$") else _quoted("$." + value)


def _regexp_replace(text: str, pattern: str, new: str, options: str = "''") -> str:
    """The first match alone, or all with option g; \\1 is a group.  What is replaced once has its start before it."""
    flags = _literal(options)
    if flags is None or set(flags) - set("gimsc"):
        raise ValueError(f"options {options} of regexp_replace are not supported")
    inline = "".join(f for f in flags if f in "ims")
    head, shift = (f"(?{inline})" if inline else ""), (0 if "g" in flags else 1)
    value, known = _literal(new), _literal(pattern)
    if shift:
        pattern = f"concat('\\\\A((?s:.*?))(?:{head}', {pattern}, ')')" if known is None else _quoted(f"\\A((?s:.*?))(?:{head}{known})")
    elif head:
        pattern = f"concat('{head}', {pattern})" if known is None else _quoted(head + known)
    if value is None:
        return f"regexp_replace({text}, {pattern}, {f'concat(chr(36), 1, {new})' if shift else new})"
    value = re.sub(r"\\(\d)|([$\\])", lambda m: f"${int(m[1]) + shift}" if m[1] else chr(92) + m[2], value)
    if shift:
        # $1 ends before a digit of the text
        value = "$1" + (chr(92) + value if value[:1].isdigit() else value)
    return f"regexp_replace({text}, {pattern}, {_quoted(value)})"


#: Seconds and months of units; where buckets of time begin: a Monday, or for months a year's first day.
_SECONDS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_MONDAY = "TIMESTAMP_NTZ'2000-01-03 00:00:00'"


def _time_bucket(width: str, ts: str, *more: str) -> str:
    m = re.fullmatch(r"INTERVAL\s+'?(\d+)'?\s+(\w+?)s?'?", width, re.I)
    unit = m[2].lower() if m else None
    if more or unit not in _SECONDS | _MONTHS:
        raise ValueError(f"time_bucket({width}, ...) is not supported")
    if unit in _MONTHS:
        months = f"(12 * (year({ts}) - 2000) + month({ts}) - 1)"
        return f"CAST(add_months(DATE'2000-01-01', {months} - pmod({months}, {int(m[1]) * _MONTHS[unit]})) AS TIMESTAMP_NTZ)"
    micros = f"timestampdiff(MICROSECOND, {_MONDAY}, {ts})"
    size = round(int(m[1]) * _SECONDS[unit] * 1_000_000)
    return f"({_MONDAY} + make_dt_interval(0, 0, 0, CAST(({micros} - pmod({micros}, {size}L)) / 1000000 AS DECIMAL(18, 6))))"


def _unit(text: str) -> str:
    value = (_literal(text) or "").lower().rstrip("s")
    if value not in _SECONDS | _MONTHS:
        raise ValueError(f"unit {text} is not supported")
    return value


def _date_diff(unit: str, a: str, b: str) -> str:
    """How many borders of the unit lie between a and b."""
    u = _unit(unit)
    return f"timestampdiff({u.upper()}, date_trunc('{u}', {a}), date_trunc('{u}', {b}))"


def _strptime(text: str, fmt: str) -> str:
    value = _literal(fmt)
    if value is None:
        raise ValueError("strptime needs a literal format")
    return f"to_timestamp_ntz({text}, {_quoted(java_format(value))})"


def _ordered(text: str) -> tuple[str, str] | None:
    """An argument around its top-level ORDER BY."""
    return _split_top(text, r"ORDER\s+BY")


def _string_agg(text: str, separator: str = "','") -> str | None:
    for part in (separator, text):
        if cut := _ordered(part):
            own, order = cut[0].strip(), cut[1].strip()
            return f"listagg({own}, {separator}) WITHIN GROUP (ORDER BY {order})" if part is text else f"listagg({text}, {own}) WITHIN GROUP (ORDER BY {order})"
    return f"listagg({text}, {separator})"


def _list(text: str, *more: str) -> str | None:
    if more or not (cut := _ordered(text)):
        return None
    m = re.fullmatch(r"(.*?)(\s+(?:ASC|DESC))?", cut[1].strip(), re.I | re.S)
    up = "false" if (m[2] or "").strip().upper() == "DESC" else "true"
    return f"transform(sort_array(collect_list(named_struct('o', {m[1]}, 'v', {cut[0].strip()})), {up}), e -> e.v)"


def _len(value: str) -> str:
    """Of a list that the text shows to be one its size, else a text's length."""
    return f"{'size' if re.match(r'(split|array|transform|filter|sort_array|collect_list|array_[a-z]+|sequence|slice)\(|\[', value) else 'length'}({value})"


def _indexed(function: str):
    """transform or filter, whose lambda's index counts from one."""

    def call(values: str, *change: str) -> str | None:
        m = re.fullmatch(r"\(\s*(\w+)\s*,\s*(\w+)\s*\)\s*->(.*)", ", ".join(change), re.S)
        if not m:
            return None
        parts = re.split(r"('(?:[^'\\]|\\.)*'|`[^`]*`)", m[3])
        body = "".join(t if t[:1] in ("'", "`") else re.sub(rf"(?<![.\w]){m[2]}\b", f"({m[2]} + 1)", t) for t in parts)
        return f"{function}({values}, ({m[1]}, {m[2]}) ->{body})"

    return call


#: Functions whose arguments are other ones here.
_CALLS = {
    "transform": _indexed("transform"),
    "filter": _indexed("filter"),
    "len": _len,
    "string_split": _string_split,
    "str_split": _string_split,
    "json_extract_string": lambda x, path: f"get_json_object({x}, {_json_path(path)})",
    "json_extract": lambda x, path: f"to_json(try_variant_get(try_parse_json({x}), {_json_path(path)}, 'variant'))",
    "regexp_replace": _regexp_replace,
    "time_bucket": _time_bucket,
    "epoch": lambda ts: f"(unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000)",
    "date_diff": _date_diff,
    "datediff": lambda *x: _date_diff(*x) if len(x) == 3 else None,
    "date_sub": lambda *x: f"timestampdiff({_unit(x[0]).upper()}, {x[1]}, {x[2]})" if len(x) == 3 else None,
    "strptime": _strptime,
    "string_agg": _string_agg,
    "group_concat": _string_agg,
    "collect_list": _list,
}


def _base(sql: str, end: int) -> int:
    """Where the expression begins that ends before end: a name, a call or a bracket."""
    at = end
    while at and sql[at - 1] in ")]":
        depth = 0
        for place, t in reversed(_pieces(sql[:at])):
            depth += (t in (")", "]")) - (t in ("(", "["))
            if depth == 0:
                at = place
                break
        else:
            return at
        if at and (sql[at - 1].isalnum() or sql[at - 1] in "_`"):
            break
    while at and (sql[at - 1].isalnum() or sql[at - 1] in "_.`"):
        at -= 1
    return at


def _lists(sql: str) -> str:
    """[a, b] to array(a, b), and x[i], which counts from one, to try_element_at(x, i)."""
    while opened := [at for at, t in _pieces(sql) if t == "["]:
        at = opened[0]
        if (got := _arguments(sql, at + 1)) is None:
            raise ValueError("a bracket is not closed")
        before = sql[:at].rstrip()
        indexes = before and (before[-1].isalnum() or before[-1] in "_`)") and not re.search(r"\b(SELECT|IN|THEN|ELSE|WHEN|AND|OR|BY|ON|AS|FROM|WHERE|RETURN)$", before, re.I)
        inner, rest = sql[at + 1 : got[1]], sql[got[1] + 1 :]
        if not indexes:
            sql = f"{sql[:at]}array({inner}){rest}"
        else:
            if len(got[0]) != 1 or ":" in re.sub(r"'(?:[^'\\]|\\.)*'|::", "", inner):
                raise ValueError(f"[{inner}] is not supported: slices of lists are slice(x, start, length)")
            begin = _base(sql, len(before))
            sql = f"{sql[:begin]}try_element_at({sql[begin : len(before)]}, {inner}){rest}"
    return sql


def _tops(code: str, word: str) -> list[tuple[int, int]]:
    """(begin, end) of the keyword's occurrences outside brackets, quotes and comments."""
    depth, found, at = 0, [], 0
    for i, part in enumerate(_QUOTED.split(code)):
        if i % 2 == 0:
            for m in re.finditer(rf"[()]|\b{word}\b", part, re.I):
                depth += {"(": 1, ")": -1}.get(m[0], 0)
                if m[0] not in "()" and depth == 0:
                    found.append((at + m.start(), at + m.end()))
        at += len(part)
    return found


def _split_top(code: str, word: str) -> tuple[str, str] | None:
    """code around the last top-level keyword, or None."""
    found = _tops(code, word)
    return (code[: found[-1][0]], code[found[-1][1] :]) if found else None


def _inside(sql: str, change) -> str:
    """sql with change applied to every query in brackets, inner ones first, and to itself."""
    out, stack, at = "", [], 0
    for i, part in enumerate(_QUOTED.split(sql)):
        if i % 2:
            out += part
            continue
        for c in part:
            if c == "(":
                stack.append(len(out) + 1)
            if c == ")" and stack:
                begin = stack.pop()
                inner = out[begin:]
                if re.match(r"\s*(SELECT|WITH)\b", inner, re.I):
                    out = out[:begin] + change(inner)
            out += c
    return change(out)


def _body(sql: str) -> tuple[str, str]:
    """A statement's leading WITH part, and the rest from its first top-level SELECT."""
    found = _tops(sql, "SELECT")
    return (sql[: found[0][0]], sql[found[0][0] :]) if found else (sql, "")


def _qualify(sql: str) -> str:
    """SELECT … QUALIFY cond [ORDER BY …] to an outer filter over a computed column."""
    cut = _split_top(sql, "QUALIFY")
    if cut is None:
        return sql
    head, tail = cut
    rest = ""
    for word in (r"ORDER\s+BY", "LIMIT"):
        if t := _tops(tail, word):
            tail, rest = tail[: t[0][0]], tail[t[0][0] :]
            break
    before, select = _body(head)
    f = _tops(select, "FROM")[0]
    return f"{before}SELECT * EXCEPT (__q) FROM ({select[: f[0]].rstrip()}, ({tail.strip()}) AS __q FROM{select[f[1] :]}) WHERE __q {rest}".rstrip()


def _distinct_on(sql: str) -> str:
    before, select = _body(sql)
    m = re.match(r"SELECT\s+DISTINCT\s+ON\s*\(([^()]*)\)\s*(.*)$", select, re.I | re.S)
    if not m:
        return sql
    rest = m[2]
    f = _tops(rest, "FROM")[0]
    columns, source, order = rest[: f[0]].strip(), rest[f[1] :], m[1]
    if t := _tops(source, r"ORDER\s+BY"):
        source, order = source[: t[-1][0]], source[t[-1][1] :]
    return f"{before}SELECT * EXCEPT (__r) FROM (SELECT {columns}, row_number() OVER (PARTITION BY {m[1]} ORDER BY {order.strip()}) AS __r FROM{source}) WHERE __r = 1"


def _structs(sql: str) -> str:
    """{'a': x, b: y} to named_struct('a', x, 'b', y)."""
    parts, depth = _QUOTED.split(sql), 0
    for i in range(0, len(parts), 2):
        code, new = parts[i], ""
        for m in re.finditer(r"[{}]|([{,]\s*)?([A-Za-z_]\w*)\s*:(?!:)|:(?!:)|::|[^{}:A-Za-z_]+|[A-Za-z_]\w*|.", code, re.S):
            t = m[0]
            if t == "{":
                depth, t = depth + 1, "named_struct("
            elif t == "}" and depth:
                depth, t = depth - 1, ")"
            elif depth and m[2]:
                t = f"{m[1] or ''}'{m[2]}',"
            elif depth and t == ":":
                t = ","
            new += t
        parts[i] = new
    return "".join(parts)


def _first_rows(query: str) -> str:
    """A query over one table whose max_by and min_by leave out null values and give ties to the table's first row.

    Rows are counted in the order in which the table is scanned.  Over joins and queries in brackets ties stay open.
    """
    code = "".join(part if i % 2 == 0 else " " * len(part) for i, part in enumerate(_QUOTED.split(query)))
    cut = _tops(query, "FROM")
    if len(cut) != 1 or not re.search(r"\b(max_by|min_by)\s*\(", code, re.I) or len(re.findall(r"\bSELECT\b", code, re.I)) != 1:
        return query
    ends = r"(?=\s*$|\s*\)|\s+(?:WHERE|GROUP|HAVING|ORDER|LIMIT|WINDOW)\b)"
    source = re.match(rf"\s*([\w.]+)(?:\s+(?:AS\s+)?(?!(?:WHERE|GROUP|HAVING|ORDER|LIMIT|WINDOW)\b)(\w+))?{ends}", code[cut[0][1] :], re.I)
    if not source:
        return query
    name = source[2] or source[1].rsplit(".", 1)[-1]
    rows = f" (SELECT *, monotonically_increasing_id() AS __row FROM {source[1]}) AS {name}"
    query = query[: cut[0][1]] + rows + query[cut[0][1] + source.end() :]
    known = lambda x, y: f"CASE WHEN ({x}) IS NOT NULL THEN {y} END"

    def call(function: str, row: str):
        def change(*args: str) -> str | None:
            if len(args) != 2:
                return None
            x, y = args
            return f"{function}({x}, {known(x, f'CASE WHEN ({y}) IS NOT NULL THEN struct({y}, {row}) END')})"

        return change

    return _called(query, {"max_by": call("max_by", "-__row"), "min_by": call("min_by", "__row")})


def translate(sql: str) -> str:
    """Spark SQL for a statement of the dialect."""
    if _tops(sql, r"UNION\s+(?:ALL\s+)?BY\s+NAME") or re.search(r"\bUNION\s+(ALL\s+)?BY\s+NAME\b", "".join(_QUOTED.split(sql)[::2]), re.I):
        raise ValueError("UNION BY NAME is run by execute(), at the top of a statement only")
    out, before = [], ""
    for i, part in enumerate(_QUOTED.split(_structs(sql.strip().rstrip(";")))):
        if i % 2:
            new = _string(part, before)
            if re.match(r"\d+ [A-Z]+$", new):
                out[-1] = out[-1].rstrip() + " "
            out.append(new)
        else:
            out.append(_plain(part))
        before = part if i % 2 == 0 else before
    plain = _lists(_called(_strftime("".join(out)), _CALLS))
    return _inside(plain, lambda q: _qualify(_distinct_on(q)))


def _union_by_name(spark: SparkSession, sql: str, cuts: list[tuple[int, int]], args: dict | None) -> DataFrame:
    """Parts with equal names under each other, others filled with null; BY NAME without ALL is distinct."""
    order = [t for t in _tops(sql, r"ORDER\s+BY") if t[0] > cuts[-1][1]]
    end = order[0][0] if order else len(sql)
    with_part = _body(sql)[0]
    edges = [0, *(x for c in cuts for x in c), end]
    queries = [sql[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
    out = execute(spark, queries[0], args)
    for q, (a, b) in zip(queries[1:], cuts):
        out = out.unionByName(execute(spark, with_part + q, args), allowMissingColumns=True)
        if not re.search(r"\bALL\b", sql[a:b], re.I):
            out = out.distinct()
    return out.orderBy(F.expr(sql[order[0][1] :])) if order else out


def summarize(df: DataFrame) -> DataFrame:
    """A row a column: its type, least and greatest value (as text), distinct values (about), mean, deviation,
    quartiles, rows, and the share of nulls in per cent."""
    aggs, cells = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NumericType)
        q = F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75], 10000) if number else F.lit(None).cast("array<double>")
        parts = {"min": F.min(c).cast("string"), "max": F.max(c).cast("string"), "approx_unique": F.approx_count_distinct(c), "avg": F.avg(c) if number else F.lit(None).cast("double"), "std": F.stddev(c) if number else F.lit(None).cast("double"), "q": q, "here": F.count(c)}
        aggs.append(F.struct(*[v.alias(k) for k, v in parts.items()]).alias(f"c{i}"))
        get = lambda k, i=i: F.col(f"c{i}.{k}")
        share = F.when(F.col("n") > 0, F.round(100 * (1 - get("here") / F.col("n")), 2)).otherwise(0.0)
        cells.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), *[get(k).alias(k) for k in ("min", "max", "approx_unique", "avg", "std")], *[F.get(get("q"), j).alias(n) for j, n in enumerate(("q25", "q50", "q75"))], F.col("n").alias("count"), share.alias("null_percentage")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def _pivot(spark: SparkSession, m: re.Match, args: dict | None) -> DataFrame:
    """PIVOT source ON column USING aggregate [GROUP BY columns]: a column a value that occurs."""
    source = execute(spark, f"SELECT * FROM {m[1]}", args)
    used = set(re.findall(r"\w+", m[3]))
    by = [x.strip() for x in m[4].split(",")] if m[4] else [c for c in source.columns if c not in used and c != m[2]]
    return source.groupBy(*by).pivot(m[2]).agg(F.expr(translate(m[3])))


def execute(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Runs a statement of the dialect over the session's views; errors are raised."""
    sql = sql.strip().rstrip(";")
    if cuts := _tops(sql, r"UNION\s+(?:ALL\s+)?BY\s+NAME"):
        return _union_by_name(spark, sql, cuts, args)
    if m := re.match(r"SUMMARIZE\s+(.*)$", sql, re.I | re.S):
        return summarize(execute(spark, m[1] if re.match(r"\s*(SELECT|WITH)\b", m[1], re.I) else f"SELECT * FROM {m[1]}", args))
    if m := re.match(r"PIVOT\s+(\w+|\(.*\))\s+ON\s+(\w+)\s+USING\s+(.*?)(?:\s+GROUP\s+BY\s+(.*))?$", sql, re.I | re.S):
        return _pivot(spark, m, args)
    plain = _inside(translate(sql), _first_rows)
    return spark.sql(plain, args) if args else spark.sql(plain)
