"""Window frames that Spark's windows do not have: GROUPS, and EXCLUDE in any frame, without a self-join.

Peers are rows of a partition with equal order values.  A GROUPS frame counts peer groups, so it is a RANGE frame
over their dense rank.  What EXCLUDE leaves of it is put together from frames that Spark has: the groups before, the
groups after, and of the own group the row itself or its other rows.  Of a ROWS frame the peers' part is
the same frame inside the peers' partition; it is subtracted, which sums and counts allow.

All frames of a call share one shuffle by the partition columns, into tasks of about ROWS rows, and their windows: a cell that
several frames need is computed once, and windows of one order follow each other.  Frames up to the partition's end are run from
that end, and a row's others are told from their whole (exact sums, counts) or from its two outermost values (min, max), so
the work does not grow with the square of a partition.  A partition is in one task.

Cases: a frame that holds no row, or null values only, has a null sum, mean, least and greatest value, and count
0; null order values are peers, before all others; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegralType

EXCLUDES = ("no others", "current row", "group", "ties")
#: Rows of a task, about.
ROWS = 250_000
_START, _END = Window.unboundedPreceding, Window.unboundedFollowing
#: Windows in the order in which they are run, and those that run the other way.
_WINDOWS = ("whole", "ranked", "peers", "outer", "inside", "inside back", "ranked back", "back")
_BACK = {"whole": "back", "ranked": "ranked back", "inside": "inside back"}


def _merged(function: str, parts: list[tuple[Column, Column]]) -> Column:
    """One aggregate over disjoint parts, each (value, count of values)."""
    if not parts:
        return F.lit(0).cast("bigint") if function == "count" else F.lit(None)
    values = [v for v, _ in parts]
    if function == "count":
        return reduce(lambda a, b: a + b, [n for _, n in parts])
    if function in ("min", "max"):
        return values[0] if len(values) == 1 else (F.least if function == "min" else F.greatest)(*values)
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in values])
    n = reduce(lambda a, b: a + b, [n for _, n in parts])
    return F.when(n > 0, total / n if function == "avg" else total)


def _summed(kind: DataType) -> str:
    """The type of a sum."""
    if isinstance(kind, DecimalType):
        return f"decimal({min(38, kind.precision + 10)},{kind.scale})"
    return "bigint" if isinstance(kind, IntegralType) else "double"


class _Cells:
    """Aggregates over windows, each once: (value, count of values) of a column in a frame."""

    def __init__(self, df: DataFrame, by: list[str]):
        self.types, self.known = {f.name: f.dataType for f in df.schema.fields}, {}
        inner = Window.partitionBy(*by, "__g")
        self.windows = {"ranked": Window.partitionBy(*by).orderBy("__g"), "ranked back": Window.partitionBy(*by).orderBy(F.desc("__g"))}
        self.windows |= {"peers": inner, "outer": inner, "inside": inner.orderBy("__r"), "inside back": inner.orderBy(F.desc("__r"))}
        self.windows["back"] = Window.partitionBy(*by).orderBy(F.desc("__r"))
        self.steps: dict[str, dict[str, Column]] = {w: {} for w in _WINDOWS}

    def _cell(self, window: str, begin: int, end: int, function: str, column: str, of: Column | None = None) -> Column:
        if end == _END and begin != _START and window in _BACK:
            window, begin, end = _BACK[window], _START, -begin
        key = (window, begin, end, function, column)
        if key not in self.known:
            over = self.windows[window]
            if window not in ("peers", "outer"):
                over = over.rangeBetween(begin, end) if window.startswith("ranked") else over.rowsBetween(begin, end)
            compute = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[function.split()[-1]]
            self.known[key] = f"__c{len(self.known)}"
            self.steps[window][self.known[key]] = compute(F.col(column) if of is None else of).over(over)
        return F.col(self.known[key])

    def part(self, window: str, begin: int, end: int, function: str, column: str) -> tuple[Column, Column]:
        n = self._cell(window, begin, end, "count", column)
        if function == "count":
            return n, n
        return self._cell(window, begin, end, function if function in ("min", "max") else "sum", column), n

    def own(self, function: str, column: str) -> tuple[Column, Column]:
        """The row itself."""
        value = F.col(column)
        return (value.cast(_summed(self.types[column])) if function in ("sum", "avg") else value), value.isNotNull().cast("bigint")

    def without_own(self, part: tuple[Column, Column], function: str, column: str) -> tuple[Column, Column]:
        """A part that holds the row, without it: of exact sums and counts."""
        value, n = self.own(function, column)
        return (part[1] - n if function == "count" else part[0] - F.coalesce(value, F.lit(0))), part[1] - n

    def exact(self, function: str, column: str) -> bool:
        return function == "count" or function in ("sum", "avg") and (not isinstance(self.types[column], FractionalType) or isinstance(self.types[column], DecimalType))

    def others(self, function: str, column: str) -> list[tuple[Column, Column]]:
        """The row's peers."""
        if self.exact(function, column):
            return [self.without_own(self.part("peers", _START, _END, function, column), function, column)]
        if function not in ("min", "max"):  # a sum of floats less one of them is another sum
            return [self.part("inside", _START, -1, function, column), self.part("inside", 1, _END, function, column)]
        value, n = self.part("peers", _START, _END, function, column)
        v = F.col(column)
        times = self._cell("outer", _START, _END, f"{function} count", column, F.when(v == value, v))
        second = self._cell("outer", _START, _END, f"second {function}", column, F.when(v > value if function == "min" else v < value, v))
        return [(F.when((v == value) & (times == 1), second).otherwise(value), n - v.isNotNull().cast("bigint"))]

    def parts(self, function: str, column: str, units: str, lo: int, hi: int, exclude: str) -> list[tuple[Column, Column]]:
        """What makes up a frame."""
        here = lo <= 0 <= hi
        cut = lambda window, spans: [self.part(window, a, b, function, column) for a, b in spans if a <= b]
        if units == "groups":
            around = cut("ranked", [(lo, min(hi, -1)), (max(lo, 1), hi)])
            if not here or exclude == "group":
                return around
            return around + {"no others": lambda: cut("peers", [(_START, _END)]), "current row": lambda: self.others(function, column), "ties": lambda: [self.own(function, column)]}[exclude]()
        if exclude == "no others" or not here and exclude == "current row":
            return cut("whole", [(lo, hi)])
        if exclude == "current row":
            if self.exact(function, column):
                return [self.without_own(p, function, column) for p in cut("whole", [(lo, hi)])]
            return cut("whole", [(lo, -1), (1, hi)])
        if function in ("min", "max"):
            raise ValueError("EXCLUDE GROUP and TIES of a ROWS frame need a sum, count or mean")
        minus = [(-v, -n) for v, n in cut("inside", [(lo, hi)])]
        return cut("whole", [(lo, hi)]) + minus + ([self.own(function, column)] if here and exclude == "ties" else [])


def framed_all(df: DataFrame, frames: list[tuple[dict[str, tuple[str, str]], dict]], by: list[str], order: list[str | Column], rows: int = ROWS) -> DataFrame:
    """df with the columns of several frames of one partitioning and order: (aggregates, options), as framed() takes them.

    rows: how many a task is given, about; df's rows are counted for it.
    """
    cells = _Cells(df, by)
    cells.windows["whole"] = Window.partitionBy(*by).orderBy(*order)
    out = {}
    for aggregates, options in frames:
        o = {"units": "groups", "start": None, "end": 0, "exclude": "no others"} | options
        if o["units"] not in ("groups", "rows") or o["exclude"] not in EXCLUDES:
            raise ValueError(f"units {o['units']!r} with EXCLUDE {o['exclude']!r} are not known")
        lo, hi = (_START if o["start"] is None else o["start"]), (_END if o["end"] is None else o["end"])
        for name, (function, column) in aggregates.items():
            out[name] = _merged(function, cells.parts(function, column, o["units"], lo, hi, o["exclude"]))
    columns = [c for c in df.columns if c not in out]
    df = df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *by)
    # a row's number and its peers' come with the cells of the same order
    steps = dict(cells.steps)
    steps["whole"] = {"__g": F.dense_rank().over(cells.windows["whole"]), "__r": F.row_number().over(cells.windows["whole"])} | steps["whole"]
    for step in steps.values():
        if step:
            df = df.withColumns(step)
    return df.select(*columns, *[v.alias(k) for k, v in out.items()])


def framed(df: DataFrame, aggregates: dict[str, tuple[str, str]], by: list[str], order: list[str | Column], units: str = "groups", start: int | None = None, end: int | None = 0, exclude: str = "no others") -> DataFrame:
    """df with a column an aggregate: {name: (sum | count | avg | min | max, column)} over a frame.

    start and end are offsets in units (groups or rows; negative ones precede, None is unbounded).  Of a ROWS
    frame, group and ties can be excluded from sums, counts and means only.
    """
    return framed_all(df, [(aggregates, {"units": units, "start": start, "end": end, "exclude": exclude})], by, order)
