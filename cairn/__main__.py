"""python -m cairn LOG [--format F] QUESTION…: reads a log and answers questions or SQL."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("log")
    p.add_argument("questions", nargs="+")
    p.add_argument("--format", default="json")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cairn").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark).initialize(a.log, a.format)
    code = 0
    for q in a.questions:
        out = engine.chat(q)
        print(out.operation or out.error)
        for df in out.dataframes:
            df.show(50, truncate=False)
        code |= not out.success
    return int(code)


if __name__ == "__main__":
    raise SystemExit(main())
