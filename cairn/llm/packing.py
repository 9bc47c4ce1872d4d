"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows.  A piece goes to the open window with the least room
that still holds it; when none does, the fullest window is closed (its gap is filled with the head of
the piece if the gap is worth a cut) and a fresh one is opened.  What is open at the end of a task is
a leftover; leftovers of neighbouring tasks are merged with cuts, so one partial window per group of
tasks remains.

Cases: a null text is empty; an empty document is its end id alone; a null doc_id stays null; repeated
rows are packed as often as they occur; texts longer than a window are cut into whole windows first;
an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bound_batches, tidy, written
from .tokens import Encoder, default_tokenizer_path, ids_crc32

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
_OPEN = _PIECE.append(pa.field("leftover", pa.bool_()))
#: Leftovers of so many neighbouring tasks meet in one task: at most MERGED * open_windows windows.
MERGED = 64
#: Sequence ids: the task (or group, above bit 61) and the window's number in it.
_SHIFT, _MERGE_BASE = 32, 1 << 61


class Windows:
    """The open windows of one task.  add() takes a document's ids; closed() gives finished windows."""

    def __init__(self, length: int, limit: int, min_cut: int):
        self.length, self.limit, self.min_cut = length, limit, min_cut
        self.room: list[int] = []
        self.held: list[list] = []
        self.done: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.done.append([(doc_id, at, ids[at : at + self.length], total)])
            at += self.length
        if at < total:
            self._place(doc_id, at, ids[at:], total)

    def _place(self, doc_id, at: int, ids: np.ndarray, total: int) -> None:
        need = len(ids)
        best = min((i for i, r in enumerate(self.room) if r >= need), key=self.room.__getitem__, default=None)
        if best is None:
            if len(self.room) == self.limit:
                full = min(range(self.limit), key=self.room.__getitem__)
                gap = self.room[full]
                if gap >= self.min_cut:
                    self.held[full].append((doc_id, at, ids[:gap], total))
                    at, ids = at + gap, ids[gap:]
                self._close(full)
            self.room.append(self.length - len(ids))
            self.held.append([(doc_id, at, ids, total)])
            return
        self.held[best].append((doc_id, at, ids, total))
        self.room[best] -= need
        if self.room[best] == 0:
            self._close(best)

    def _close(self, i: int) -> None:
        self.done.append(self.held.pop(i))
        self.room.pop(i)


def _rows(window: list, sequence_id: int, keep_ids: bool) -> list[tuple]:
    rows, offset = [], 0
    for doc_id, start, ids, total in window:
        rows.append((doc_id, start, len(ids), ids_crc32(ids), total, sequence_id, offset, ids.astype("<u4").tobytes() if keep_ids else None))
        offset += len(ids)
    return rows


def pack_documents(docs: DataFrame, length: int = 2048, open_windows: int = 32, min_cut: int = 64, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False, memo: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids (little-endian uint32) is filled if with_ids.  memo bounds the chunks that a worker remembers the ids of.  Tokenising and packing happen in the scan's own
    tasks, without a shuffle; only leftovers (a bounded number a task) are shuffled.
    """
    path = tokenizer or default_tokenizer_path()
    bound_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = Encoder.get(path, memo), Windows(length, open_windows, min_cut)
        base, n = TaskContext.get().partitionId() << _SHIFT, 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            flat, sizes = encoder.encode(batch.column(1).to_pylist())
            # each document's ids and its end id in one array
            whole = np.full(len(flat) + len(sizes), end_id, np.int32)
            ends = np.cumsum(sizes + 1)
            at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
            whole[at] = flat
            for doc_id, a, b in zip(doc_ids, (ends - sizes - 1).tolist(), ends.tolist()):
                windows.add(doc_id, whole[a:b].copy())
            out = []
            for w in windows.done:
                out += [(*r, False) for r in _rows(w, base + n, with_ids)]
                n += 1
            windows.done = []
            yield from batches_of(out, _OPEN)
        out = []
        for w in windows.held:
            out += [(*r, True) for r in _rows(w, base + n, True)]
            n += 1
        yield from batches_of(out, _OPEN)

    first = written(docs.select("doc_id", "text").mapInArrow(tidy(pack), PIECE + ", leftover boolean"), "packed")
    group = F.shiftright("sequence_id", _SHIFT + MERGED.bit_length() - 1)
    left = first.where("leftover").withColumn("grp", group)
    groups = (left.agg(F.max("grp")).first()[0] or 0) + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            """The group's pieces in a row, cut at each full window."""
            out, window, room, n = [], [], length, 0
            for doc_id, start, ids, total in held:
                while len(ids):
                    take = ids[:room]
                    window.append((doc_id, start, take, total))
                    start, ids, room = start + len(take), ids[room:], room - len(take)
                    if room == 0:
                        out += _rows(window, _MERGE_BASE + (now << _SHIFT) + n, with_ids)
                        window, room, n = [], length, n + 1
            if window:
                out += _rows(window, _MERGE_BASE + (now << _SHIFT) + n, with_ids)
            yield from batches_of(out, _PIECE)

        for batch in batches:
            for grp, doc_id, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("grp", "doc_id", "start", "ids", "doc_tokens"))):
                if grp != now:
                    if held:
                        yield from flush()
                    now, held = grp, []
                held.append((doc_id, start, np.frombuffer(ids, "<u4"), total))
        if held:
            yield from flush()

    merged = left.repartition(groups, "grp").sortWithinPartitions("grp", "sequence_id", "offset").mapInArrow(tidy(merge), PIECE)
    return first.where("not leftover").drop("leftover").unionByName(merged)
