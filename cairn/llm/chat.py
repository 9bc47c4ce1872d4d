"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events (conv_id, seq, slot, role, kind, text).  kind 'message' sets the
text of its slot, 'delta' appends to it, 'edit' replaces it, and 'regenerate' replaces it and drops
what earlier events put into later slots.  The log is partitioned by conversation, ordered by seq and
folded into final messages, which are rendered with turn marks and a loss mask over assistant text.

Control strings inside roles and texts get one backslash after their first character (runs of
backslashes there grow by one), so a rendered text never holds a control string and reads back exactly.

Cases: null text and null role are empty; a null kind is a message; null conv_id is a conversation of
its own; equal (turn, role, text) rows each count; rows of one turn are ordered by role, then text; an
empty table gives no conversations; other columns are ignored.  One conversation becomes one row, so
its rendered text must fit into a row (2 GB).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of other common ones, escaped alike.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(sorted({re.escape(c.lstrip("<[")) for c in CONTROLS}))
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """As escape; a newline becomes backslash-n, and runs of backslashes before an n grow by one."""
    return escape(F.replace(F.regexp_replace(role, r"(\\+)n", r"\\$1n"), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(role), r"(?<!\\)\\n", "\n"), r"\\(\\+)n", "$1n")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as a log of one message event per row."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select("conv_id", "seq", F.col("seq").alias("slot"), "role", F.lit("message").alias("kind"), "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, slot, role, text) of a log."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    e = events.select("conv_id", "seq", "slot", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("slot"))).over(later))
    e = e.where("cut is null or slot is null or slot <= cut")
    log = e.groupBy("conv_id", "slot").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    # what counts is the last event that is no delta, and the deltas after it
    last = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] == "delta", F.lit(0)).otherwise(i)))
    log = log.withColumn("log", F.slice("log", last + 1, F.size("log")))
    return log.select("conv_id", "slot", F.col("log")[0]["role"].alias("role"), F.array_join(F.transform("log", lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss.

    loss has an entry per turn: null, or (turn_start, start, length), code points in formatted.
    """
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "slot", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    so_far = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("turn_start", F.sum(F.length("piece")).over(so_far) - F.length("piece"))
    span = F.when(F.col("role") == "assistant", F.struct("turn_start", (F.col("turn_start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    turns = m.select("conv_id", "slot", "piece", span.alias("span")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slot", "piece", "span"))).alias("turns"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.transform("turns", lambda x: x["span"]).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests read from formatted and loss alone: what a trainer would see, unescaped."""
    pieces = F.split("formatted", re.escape(END) + "\n")
    r = rendered.select("conv_id", "formatted", "loss", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(head) + 2)
        return F.concat(_unescape_role(F.substr(head, F.lit(len(START) + 1))), F.lit("\n"), unescape(text), F.lit("\n"))

    def learnt(piece: Column, span: Column) -> Column:
        part = F.substr(piece, (span["start"] - span["turn_start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span.isNull(), F.lit("")).otherwise(unescape(part))

    r = r.select("conv_id", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", turn), "").alias("turns"), F.array_join(F.zip_with("pieces", "loss", learnt), "").alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return r.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def format_turns(turns: DataFrame) -> DataFrame:
    """The whole way from a table of turns to rendered conversations."""
    return render(reconstruct(events_of_turns(turns.select("conv_id", "turn", "role", "text"))))


#: A conversation whose texts are full of control strings; every run formats it too.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


_SQL_ESCAPE = _ESCAPE.replace("'", "''")
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, regexp_replace(text, '{_SQL_ESCAPE}', '\1\\\2\3', 'g') AS body,
         regexp_replace(replace(regexp_replace(role, '(\\+)n', '\\\1n', 'g'), chr(10), '\n'), '{_SQL_ESCAPE}', '\1\\\2\3', 'g') AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('{START}') + length(head) + 1 + length(body) + length('{END}') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
