"""Substring search that leaves files out: postings of trigrams beside a log table.

The table is written in files of bounded rows, in the order of id, so that a file is about a row group.  The postings
hold, for every trigram that occurs (by a hash in a bounded range), the files it occurs in, sorted by the hash, so a
look-up reads few of their row groups.  A LIKE pattern's literal runs of three characters or more give the
trigrams that each match must hold; only files that have them all are read, and the pattern itself then decides.
Hashes that collide, and trigrams that stand in other rows of a file, cost a needless read, never a row.

Cases: patterns without such a run read all files; null texts match nothing; _ and % are wildcards and a
backslash is itself, as search.like has it; an empty table has no files and finds no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import new_path
from .search import like

#: Rows of a file at most, and the range of trigram hashes.
ROWS, HASHES = 100_000, 1 << 20


def required(pattern: str) -> list[str]:
    """The trigrams that every text matching %pattern% holds."""
    return sorted({r[i : i + 3] for r in re.split("[%_]", pattern) for i in range(len(r) - 2)})


@dataclass
class TrigramIndex:
    spark: SparkSession
    data: str
    postings: str
    schema: StructType
    column: str
    hashes: int

    @classmethod
    def build(cls, logs: DataFrame, column: str = "message", order: str = "id", rows: int = ROWS, hashes: int = HASHES) -> "TrigramIndex":
        """Writes logs and their postings to the shared folder."""
        spark, data, postings = logs.sparkSession, new_path(logs.sparkSession, "log"), new_path(logs.sparkSession, "postings")
        logs.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", rows).parquet(data)
        text = spark.read.schema(logs.schema).parquet(data).where(F.char_length(column) >= 3).select(F.col(column).alias("t"), F.col("_metadata.file_name").alias("file"))
        grams = F.transform(F.sequence(F.lit(1), F.char_length("t") - 2), lambda i: F.pmod(F.xxhash64(F.substr("t", i, F.lit(3))), F.lit(hashes)).cast("int"))
        found = text.select("file", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
        found.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.parquet(postings)
        return cls(spark, data, postings, logs.schema, column, hashes)

    def all_files(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.data)
        status = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(n for n in (f.getPath().getName() for f in status) if n.startswith("part-"))

    def files(self, pattern: str) -> list[str]:
        """Names of the files that may hold a match: what a scan lists anyway, a name a file."""
        grams = required(pattern)
        if not grams:
            return self.all_files()
        wanted = self.spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(self.hashes)).cast("int").alias("gram")).distinct()
        numbers = [r["gram"] for r in wanted.collect()]
        held = self.spark.read.parquet(self.postings).where(F.col("gram").isin(numbers))
        return sorted(r["file"] for r in held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(numbers)).select("file").collect())

    def search(self, pattern: str) -> DataFrame:
        """All rows whose text holds the pattern: those of a scan of the whole table."""
        names = self.files(pattern)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.data}/{n}" for n in names]).where(like(self.column, pattern))
