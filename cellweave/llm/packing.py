"""Sum-of-squares online packing of documents into fixed token windows.

An arriving piece of s tokens goes to the fill level h for which the sum of N(h)**2 over the partly filled levels
grows least, N(h) being the number of open windows at level h: opening a window costs 2 N(s) + 1, moving one from h to
h + s costs 2 (N(h + s) - N(h) + 1), and filling one gains 2 N(h) - 1. The counts are one array of `window` levels.
Every task packs the rows of its own input partition, so nothing is shuffled, and a lost task is packed again alike.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence numbers of one task stay below this; the task's number is above.
PER_TASK = 1 << 32


class SumOfSquares:
    """Packs pieces online. A window is a list of pieces (doc_id, start, doc_tokens, length, crc); the ids of open ones lie in a
    scratch file of this task, a slot each, so that memory holds none and there may be any number of them."""

    def __init__(self, window: int):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[tuple[int, list]]] = {}
        self.scratch, self.free, self.slots = tempfile.TemporaryFile(), [], 0

    def place(self, doc_id, start: int, total: int, ids: np.ndarray) -> list | None:
        """Add a piece; returns the window that it filled."""
        s = len(ids)
        piece = (doc_id, start, total, s, zlib.crc32(ids.tobytes()))
        if s == self.window:
            return [piece]
        n = self.level
        fits = n[1 : self.window - s + 1]
        cost = 2 * (n[s + 1 : self.window + 1] - fits + 1)
        cost[-1] = 1 - 2 * fits[-1]
        cost = np.where(fits > 0, cost, np.iinfo(np.int64).max)
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # ties: the fullest window
        if cost[best] > 2 * n[s] + 1:
            slot, held, full = self.free.pop() if self.free else self.slots, [], 0
            self.slots = max(self.slots, slot + 1)
        else:
            full = best + 1
            slot, held = self.open[full].pop()
            n[full] -= 1
        held.append(piece)
        if full + s == self.window:
            self.free.append(slot)
            return held
        os.pwrite(self.scratch.fileno(), ids.astype("<u4").tobytes(), 4 * (slot * self.window + full))
        self.open.setdefault(full + s, []).append((slot, held))
        n[full + s] += 1
        return None

    def drain(self) -> Iterator[list]:
        """Close the open windows: their pieces in turn, cut where a window is full, so that one window at most stays partly filled."""
        held, room = [], self.window
        for full in sorted(self.open, reverse=True):
            for slot, window in self.open[full]:
                ids = np.frombuffer(os.pread(self.scratch.fileno(), 4 * full, 4 * slot * self.window), "<u4")
                for doc_id, start, total, length, _ in window:
                    own, ids = ids[:length], ids[length:]
                    while len(own):
                        part = own[:room]
                        held.append((doc_id, start, total, len(part), zlib.crc32(part.tobytes())))
                        start, own, room = start + len(part), own[room:], room - len(part)
                        if not room:
                            yield held
                            held, room = [], self.window
        if held:
            yield held
        self.scratch.close()


def pack_documents(docs: Iterable[tuple], window: int) -> Iterator[list]:
    """(doc_id, ids) in order -> windows as lists of (doc_id, start, doc_tokens, length, crc)."""
    packer = SumOfSquares(window)
    for doc_id, ids in docs:
        for start in range(0, len(ids), window):
            if done := packer.place(doc_id, start, len(ids), ids[start : start + window]):
                yield done
    yield from packer.drain()


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, window: int = 2048) -> DataFrame:
    """Pieces of documents with their place in a sequence of at most `window` tokens.

    A null or empty text is the closing id alone. Rows are packed as they are, so repeated rows are packed again, ties keep
    the input's order, and a null doc_id stays null. Texts longer than a window fill whole windows and their rest is
    packed. Other columns are not read. An empty table gives no rows. Windows that are open at the end of a task are closed by
    cutting their pieces; no token is lost.
    """
    path = vocabulary or tokens.vocabulary("byte_bpe_50k.tiktoken")

    schema = common.arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() * PER_TASK
        docs = ((d, tokens.token_ids(t, path, end_id)) for b in batches for d, t in zip(*(c.to_pylist() for c in b.columns)))
        rows: list[tuple] = []
        for windowed in pack_documents(docs, window):
            offset = 0
            for doc_id, start, total, length, crc in windowed:
                rows.append((doc_id, start, length, crc, total, sequence, offset))
                offset += length
            sequence += 1
            if len(rows) >= 4096:
                yield common.record_batch(rows, schema)
                rows = []
        yield common.record_batch(rows, schema)

    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
