"""Files of all kinds to records."""

import bz2
import gzip
import zlib

import pytest

from cairn.sources.reader import LogReader, MultiFileReader, chunks, stream_rows

LINES = ['{"timestamp": "2024-01-01T00:00:01", "level": "INFO", "message": "a"}', "", "{bad", '{"timestamp": "2024-01-01T00:00:03", "level": "ERROR", "message": "b"}']
TEXT = "\n".join(LINES) + "\n"


@pytest.mark.parametrize("name,pack", [("l.jsonl", str.encode), ("l.gz", lambda t: gzip.compress(t.encode())), ("l.bz2", lambda t: bz2.compress(t.encode())), ("l.gzip", lambda t: gzip.compress(t.encode())), ("l.z", lambda t: zlib.compress(t.encode()))])
def test_codecs(spark, tmp_path, name, pack):
    (tmp_path / name).write_bytes(pack(TEXT))
    reader = LogReader(spark, format="json")
    got = reader.load(str(tmp_path / name)).orderBy("id").collect()
    assert [(r["id"], r["message"]) for r in got] == [(0, "a"), (1, "b")]
    assert tuple(reader.counts(str(tmp_path / name)).first()) == (2, 1)


def test_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1,h2\nx,1\ny,2\n")
    got = LogReader(spark, format="csv", has_header=True).load(str(tmp_path / "a.csv")).orderBy("id")
    assert [r["fields"] for r in got.collect()] == [{"0": "x", "1": "1"}, {"0": "y", "1": "2"}]
    with pytest.raises(ValueError):
        LogReader(spark, encoding="latin-1")


def test_logical_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("E1\n  at x\nE2 \\\nmore\nE3\n")
    got = LogReader(spark, format="line", logical_lines=True).load(str(tmp_path / "a.log")).orderBy("id")
    assert [r["message"] for r in got.collect()] == ["E1 at x", "E2more", "E3"]


def test_multi_line_csv(spark, tmp_path):
    """Files of many splits and segments against the csv module; quotes stay open over many of them."""
    import csv
    import io
    import random

    from cairn.sources import reader

    rng = random.Random(4)
    for name in "ab":
        table = [[rng.choice(["x", "two\nlines", 'a "word"', "", "c,d\n\n\nz", "long\n" * rng.choice([1, 40]) + "."]), str(i)] for i in range(150)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(table)
        (tmp_path / f"{name}.csv").write_text(out.getvalue())
    paths = [str(tmp_path / f"{n}.csv") for n in "ab"]
    want = [r for p in paths for r in csv.reader(open(p, newline=""))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        options = LogReader(spark, format="csv", quoted=True, multi_line=True)
        got = options.load(paths).orderBy("id").select("fields").collect()
        lines = LogReader(spark, format="csv").option("multi_line", False)
        raw = spark.read.option("lineSep", "\n").text(paths)
        assert raw.rdd.getNumPartitions() > 10
        plain = raw.selectExpr("value", "_metadata.file_path AS file", "struct(_metadata.file_block_start AS block, monotonically_increasing_id() AS row) AS pos")
        small = reader.balanced_lines(plain, *options._balance(), bits=1).orderBy("file", "pos").select("value").collect()
        assert lines.lines(paths).count() > len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [[r["fields"]["0"], r["fields"]["1"]] for r in got] == want
    assert [next(csv.reader(io.StringIO(r["value"], newline=""))) for r in small] == want


def test_nested_xml(spark, tmp_path):
    text = '<?xml version="1.0"?>\n<log>\n<event level="INFO">\n <head><time>2024-01-01T00:00:01</time><host a="1">h1</host></head>\n <message>one\n\ntwo &amp; three</message>\n</event>\n<event><level>ERROR</level><body><message>b</message></body>\n<none/>\n</event><event/>\n</log>\n'
    (tmp_path / "a.xml").write_text(text)
    got = LogReader(spark, format="xml", multi_line=True, enclosing=1).load(str(tmp_path / "a.xml")).orderBy("id").collect()
    assert [(r["level"], r["message"], r["fields"].get("host")) for r in got] == [("INFO", "one\n\ntwo & three", "h1")]
    text = text.replace("<event/>", "")
    (tmp_path / "b.xml").write_text(text)
    got = LogReader(spark, format="xml", multi_line=True, enclosing=1).load(str(tmp_path / "b.xml")).orderBy("id").collect()
    assert [(r["level"], r["message"]) for r in got] == [("INFO", "one\n\ntwo & three"), ("ERROR", "b")]
    (tmp_path / "empty.xml").write_text("")
    assert LogReader(spark, format="xml", multi_line=True).load(str(tmp_path / "empty.xml")).count() == 0
    with pytest.raises(ValueError):
        LogReader(spark, format="json", multi_line=True).load(str(tmp_path / "b.xml"))


def test_lines_of_records_are_not_shuffled(spark, tmp_path):
    """A line goes from the scan into its record; what segments share is a few rows.  Records over many batches and segments."""
    from cairn.sources import reader

    records = [f"<event>\n<message>{i}</message>\n" + "\n" * (30 if i % 50 else 3000) + "</event>" for i in range(300)]
    (tmp_path / "a.xml").write_text("\n".join(records) + "\n")
    options = LogReader(spark, format="xml")
    raw = spark.read.option("lineSep", "\n").text(str(tmp_path / "a.xml"))
    plain = raw.selectExpr("value", "_metadata.file_path AS file", "struct(_metadata.file_block_start AS block, monotonically_increasing_id() AS row) AS pos")
    for bits in (17, 8, 5):
        got = reader.balanced_lines(plain, *options._balance(), bits=bits)
        assert [r["value"] for r in got.orderBy("pos").collect()] == records
        assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()


def test_several_files(spark, tmp_path):
    for n, ts in (("a", (1, 4)), ("b", (2, 3))):
        (tmp_path / n).write_text("".join(f'{{"timestamp": "2024-01-01T00:00:0{t}", "message": "{n}{t}"}}\n' for t in ts))
    m = MultiFileReader(spark)
    m.add_file(str(tmp_path / "a"))
    m.add_file(str(tmp_path / "b"))
    with pytest.raises(ValueError):
        m.add_file(str(tmp_path / "a"))
    assert [r["message"] for r in m.entries().collect()] == ["a1", "b2", "b3", "a4"]
    assert {r["entries"] for r in m.progress().collect()} == {2}
    seen = []
    assert stream_rows(m.entries(), lambda r: seen.append(r) or len(seen) < 3) == 3
    assert [len(c) for c in chunks(m.entries(), 3)] == [3, 1]
    m.remove_file(str(tmp_path / "a"))
    assert [r["message"] for r in m.entries().collect()] == ["b2", "b3"]
    with pytest.raises(KeyError):
        m.remove_file("none")


def test_dense_ids_over_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(2000)))
        got = LogReader(spark, format="line").load(str(tmp_path / "a.log")).orderBy("id").collect()
        assert [(r["id"], r["message"]) for r in got] == [(i, f"line {i}") for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packed_in_members_and_cut_short(spark, tmp_path):
    (tmp_path / "two.gzip").write_bytes(gzip.compress(b"a\nb") + gzip.compress(b"c\n" + b"long " * 600_000 + b"\nlast"))
    got = LogReader(spark, format="line").lines(str(tmp_path / "two.gzip")).orderBy("pos").collect()
    assert [r["value"] for r in got] == ["a", "bc", "last"]  # the line of three megabytes is over the limit
    assert LogReader(spark, format="line", max_line_length=1 << 22).lines(str(tmp_path / "two.gzip")).count() == 4
    (tmp_path / "cut.z").write_bytes(zlib.compress(b"line\n" * 1000)[:-9])
    with pytest.raises(Exception, match="ends early"):
        LogReader(spark, format="line").lines(str(tmp_path / "cut.z")).collect()


def test_mined_format(spark, tmp_path):
    (tmp_path / "a.log").write_text("job 1 done\njob 2 done\nready\n")
    got = LogReader(spark, format="drain").load(str(tmp_path / "a.log")).orderBy("id").collect()
    assert [(r["id"], r["body"], r["template"], r["fields"]["cluster_id"]) for r in got] == [(0, "job 1 done", "job 1 done", "0"), (1, "job 2 done", "job <*> done", "0"), (2, "ready", "ready", "1")]


def test_counts_come_with_the_load(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"message": "one"}\n{broken\n{"message": "two"}\n\n')
    records, seen = LogReader(spark).counted(str(tmp_path / "a.jsonl"))
    assert sorted(r["message"] for r in records.collect()) == ["one", "two"]
    assert seen.get == {"processed": 2, "failed": 1}
