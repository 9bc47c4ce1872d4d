"""Line dedup over the whole corpus, in DataFrame functions only.

Lines are exploded with their positions and known by a 128-bit hash of their normalised form (white space
stripped at both ends, A-Z lower-cased).  Hashes are first made distinct by document, then counted, so a line
that a third of all documents hold is summed before it is shuffled.  Lines of a hash that enough documents
hold go, except those of the largest doc_id that holds it; what stays of a document is put together again by
position.  Only narrow rows (hashes, positions) meet by hash; a text is shuffled once, to meet its positions.

Cases: a null or empty text is one empty line; a text whose lines all go becomes empty; rows of one doc_id
are one document, and null ids are one, smaller than any other; a key that occurs more than once in a
document counts once, and all its lines share its fate; line ends are \\n alone, so a \\r is white space; an
empty table gives no rows; other columns are left out.  A document's lines must fit into a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: What counts as white space, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHARS, DOCUMENTS = 20, 3


def normalised(line: Column) -> Column:
    """A line's key; only A-Z change, so a key of other letters stays as it is."""
    key = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _hashes(value: Column, *names: str) -> list[Column]:
    """128 bits of a text, as two columns."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit("second"), value).alias(names[1])]


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash: rows that agree in all three have the same fate."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", *_hashes(F.col("text"), "t1", "t2"))


def keyed_lines(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """doc_id, t1, t2, at, h1, h2: the lines whose keys have so many code points, by position."""
    lines = _documents(docs).select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keys = lines.select("doc_id", "t1", "t2", "at", normalised(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= chars).select("doc_id", "t1", "t2", "at", *_hashes(F.col("key"), "h1", "h2"))


def repeated(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """h1, h2, keeper of the keys in so many documents; keeper is the largest doc_id that holds the key."""
    held = lines.select("h1", "h2", "doc_id").distinct()
    return held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("held"), F.max("doc_id").alias("keeper")).where(F.col("held") >= documents).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text without repeated lines, n_lines before, n_dropped; a row for each of docs.

    The table of repeated keys is broadcast where a count finds a million at most; beyond that it meets the
    lines by a shuffle of narrow rows on both sides, which adaptive execution splits at a hot key.
    """
    lines = written(keyed_lines(docs, chars), "lines")
    keys = written(repeated(lines, documents), "repeated")
    gone = lines.join(small(keys), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "gone")
    d = _documents(docs)
    d = d.join(gone, d["doc_id"].eqNullSafe(gone["g"]) & (d["t1"] == gone["g1"]) & (d["t2"] == gone["g2"]), "left")
    split = F.split("text", "\n", -1)
    n = F.size(split)
    # one cell of an array holds the lines, so that they are split once, and the positions that stay
    cell = F.array(F.struct(split.alias("lines"), F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")).alias("stay")))
    left = F.transform(cell, lambda c: F.array_join(F.transform(c["stay"], lambda i: F.get(c["lines"], i)), "\n"))[0]
    return d.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of the texts that dedup_lines leaves."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_SQL_SPACE = " || ".join(f"chr({ord(c)})" for c in SPACE)
SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT *, translate(trim(line, {_SQL_SPACE}), '{UPPER}', '{LOWER}') AS line_key FROM l
), r AS (
  SELECT line_key, max(doc_id) AS keeper FROM k
  WHERE length(line_key) >= {CHARS} GROUP BY line_key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}
), m AS (
  SELECT k.*, r.line_key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.line_key = r.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
