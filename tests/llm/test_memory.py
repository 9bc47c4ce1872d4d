"""What operators leave in the driver's JVM outside its heap."""

import itertools
import re
import sys
from pathlib import Path

import pytest

from cairn.llm import common


def resident_mb(spark):
    status = Path(f"/proc/{spark.sparkContext._gateway.proc.pid}/status").read_text()
    return int(re.search(r"RssAnon:\s+(\d+)", status)[1]) / 1024


def freed_in_holes(spark, n=600):
    """Native buffers, freed but for each 20th: no end of an arena is free, so the C library keeps all pages."""
    new = spark.sparkContext._gateway.new_array
    data, out = new(spark._jvm.byte, 1 << 16), new(spark._jvm.byte, 1 << 10)
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(n)]
    for d in made:
        d.setInput(data)
        d.deflate(out)
    for i, d in enumerate(made):
        if i % 20:
            d.end()
    return made[::20]


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_native_memory_of_the_driver_is_returned(spark, monkeypatch):
    if common.trim(spark) is None:
        pytest.skip("this JVM has no such command")
    # no collection of heaps is due, and no job makes the heap grow meanwhile
    monkeypatch.setattr(common, "_WRITES", itertools.count(1))
    monkeypatch.setattr(common.tables, "written", lambda df, label: df)
    few = spark.range(3)
    live = freed_in_holes(spark)
    held = resident_mb(spark)
    assert common.written(few, "few") is few
    assert held - resident_mb(spark) > 50
    for d in live:
        d.end()
