"""Growing log files, read in steps: what each step adds to the lines that were read before.

A step lists the files (names and lengths, not contents) and reads those that have grown.  How far a file was read is
kept as lines and bytes, in tables of the shared folder, a row a file, so a step can be taken by a new session; each step
writes a table of its own, and a step that fails leaves the one before it as it was.  A last line without its
line end is still being written: it is held back until it ends, or the file is finished.  Lines are numbered by splits:
counts of the splits before, a row a split, give each split its first number, so a file is as many tasks as splits.

Cases: a file that was removed is kept in the state; one that got shorter was replaced, and is read from its start;
an empty line counts as a line and is not returned, as in LogReader; without new lines a step gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import new_path

_STATE = "file string, lines bigint, bytes bigint"


class Follower:
    """has_more() and next() over the files of a folder or pattern."""

    def __init__(self, spark: SparkSession, path: str | list[str], state: str | None = None):
        """state: the table that an earlier follower's step left (its attribute state), to go on from there."""
        self.spark, self.paths, self.state = spark, [path] if isinstance(path, str) else list(path), state

    def _known(self) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(self.state) if self.state else self.spark.createDataFrame([], _STATE)

    def _grown(self) -> DataFrame:
        """file, length, lines and bytes read before, of files with more bytes, or fewer, than were read."""
        here = self.spark.read.format("binaryFile").load(self.paths).select(F.col("path").alias("file"), "length")
        both = here.join(self._known(), "file", "left")
        fresh = F.col("bytes").isNull() | (F.col("length") < F.col("bytes"))
        was = [F.when(fresh, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("lines", "bytes")]
        return both.where(fresh | (F.col("length") > F.col("bytes"))).select("file", "length", *was)

    def has_more(self) -> bool:
        """Whether a file has grown.  A line that is still being written counts as growth."""
        return not self._grown().where("length > 0").isEmpty()

    def next(self, finished: bool = False) -> DataFrame:
        """(file, line, value): new non-empty lines with their 0-based numbers; finished: last lines need no end."""
        step = new_path(self.spark, "follow")
        grown = self._grown().where("length > 0")
        grown.write.parquet(f"{step}/grown")
        grown = self.spark.read.schema("file string, length bigint, lines bigint, bytes bigint").parquet(f"{step}/grown")
        names = [r["file"] for r in grown.select("file").collect()]  # what the next scan lists
        none = self.spark.createDataFrame([], "file string, line bigint, value string")
        if not names:
            return none
        text = self.spark.read.option("lineSep", "\n").text(names)
        rows = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        splits = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.sum(F.octet_length("value") + 1).alias("size"), F.max_by(F.octet_length("value"), "row").alias("last"))
        splits.write.parquet(f"{step}/splits")
        splits = self.spark.read.schema(splits.schema).parquet(f"{step}/splits")
        before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = splits.select(F.col("path").alias("p"), F.col("block").alias("b"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        files = splits.groupBy("path").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("last", "block").alias("last"))
        # both readers name a file in their own way
        plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
        files = files.join(grown, plain(F.col("path")) == plain(F.col("file")))
        # the bytes of all lines and their ends are one more than the file has where its last line has no end;
        # a file that grew since it was listed is read up to what the scan saw
        open_ = F.lit(False) if finished else F.col("size") > F.col("length")
        files = files.select("file", F.col("path").alias("q"), F.col("lines").alias("old"), (F.col("n") - open_.cast("int")).alias("lines"), F.when(open_, F.col("size") - 1 - F.col("last")).otherwise(F.least("size", "length")).alias("bytes"))
        files.write.parquet(f"{step}/files")
        files = self.spark.read.schema(files.schema).parquet(f"{step}/files")
        kept = self._known().join(files.select("file"), "file", "left_anti")
        kept.unionByName(files.select("file", "lines", "bytes")).write.parquet(f"{step}/state")
        numbered = rows.join(starts, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b"))).withColumn("line", F.col("start") + F.col("row") - F.col("first"))
        found = numbered.join(files, F.col("path") == F.col("q")).where("line >= old and line < lines and value <> ''").select("file", "line", "value")
        found.write.parquet(f"{step}/rows")
        self.state = f"{step}/state"
        return self.spark.read.schema(none.schema).parquet(f"{step}/rows")
