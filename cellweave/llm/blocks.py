"""Exchange of sorted name lists between blocks of documents and ranges of names.

Documents are dealt into blocks of a few megabytes by a hash of their id. A block sends each name at most once, in one
sorted list for each of some equal ranges of names, so a phrase that every document has is one entry a block and no range
grows with it. There are RANGES, or where that is more one for every BLOCKS blocks, so that a range's lists fit in a task
whatever the input; a block's names in a range get fewer then, and no row is sent for none. A range merges its blocks' lists by binary
search and answers each block with one bit an entry, and a value for each bit that is set. Names have 96 bits, a hash of 64
by which they are sorted and a tail of 32 from another polynomial: 10**13 names collide with a chance of about 0.001.
The blocks' exchange is the same subplan wherever documents are needed again, so Spark reuses it: texts move once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text of one block, about.
BLOCK_BYTES = 4 << 20
#: Ranges of names at least, and blocks for each range beyond. They are dealt to tasks by number, several to a task where there
#: are fewer shuffle partitions.
RANGES, BLOCKS = 256, 32

U64 = np.uint64


def n_blocks(df: DataFrame, text_col: str) -> int:
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES))


def n_ranges(blocks: int) -> int:
    return max(RANGES, -(-blocks // BLOCKS))


def in_blocks(df: DataFrame, id_col: str, text_col: str, n: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text as bytes, block, and, where columns are to be carried along, those as the struct `rest`."""
    block: Column = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.crc32(F.substring(F.col(text_col).cast("binary"), 1, 64))), F.lit(n)).cast("int")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), block.alias("block"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []))


def by_range(lists: DataFrame, judge: Callable[[pa.Table], list[tuple]], ddl: str, n: int) -> DataFrame:
    """What judge returns for each of the n ranges' rows, as a table of the columns in ddl."""
    each = -(-n // int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = -(-n // each)
    schema = common.arrow_schema(ddl)

    def run(table: pa.Table) -> pa.Table:
        where = table.column("range").to_numpy()
        rows = [row for r in np.unique(where).tolist() for row in judge(table.filter(pa.array(where == r)))]
        return pa.Table.from_batches([common.record_batch(rows, schema)])

    return lists.withColumn("part", F.col("range") % parts).repartitionById(parts, "part").groupBy("part").applyInArrow(run, ddl)


def ranges(names: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n equal ranges of 64-bit names begins in a sorted list, and its end."""
    edges = np.arange(1, n, dtype=U64) * U64((1 << 64) // n)
    return np.concatenate(([0], np.searchsorted(names, edges), [len(names)]))


def lists(n: int, block: int, names: np.ndarray, *more: np.ndarray | None) -> list[tuple]:
    """Rows (range, block, names, more ...) of those of n ranges that are not empty, as bytes; None makes an empty column."""
    at = ranges(names, n)
    used = np.flatnonzero(np.diff(at)).tolist()
    return [(r, block, *(b"" if x is None else x[at[r] : at[r + 1]].tobytes() for x in (names, *more))) for r in used]


def column(table: pa.Table, name: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def merged(names: list[np.ndarray], tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted lists end to end: the order that sorts all entries by (name, tail), and where equal ones begin in it.

    Lists are merged in pairs, each entry of the one placed in the other by binary search.
    """
    ends = np.cumsum([0, *map(len, names)])
    runs = [(n, np.arange(lo, hi)) for n, lo, hi in zip(names, ends[:-1].tolist(), ends[1:].tolist())]
    while len(runs) > 1:
        runs = [_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    if not runs or not len(runs[0][0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    name, order = runs[0]
    tail = np.concatenate(tails)[order]
    same = name[1:] == name[:-1]
    if (same & (tail[1:] != tail[:-1])).any():
        again = np.lexsort((tail, name))
        order, name, tail = order[again], name[again], tail[again]
        same = name[1:] == name[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same | (tail[1:] != tail[:-1]))))


def _two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(a[0]) < len(b[0]):
        a, b = b, a
    place = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
    mine = np.ones(len(a[0]) + len(b[0]), bool)
    mine[place] = False
    out = tuple(np.empty(len(mine), x.dtype) for x in a)
    for o, x, y in zip(out, a, b):
        o[mine], o[place] = x, y
    return out


def find(names: np.ndarray, tails: np.ndarray, name: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Where a list sorted by (name, tail) has some entries; -1 where it has them not."""
    if not len(names):
        return np.full(len(name), -1)
    at = np.minimum(np.searchsorted(names, name), len(names) - 1)
    while True:
        other = (names[at] == name) & (tails[at] < tail) & (at + 1 < len(names))
        if not other.any():
            return np.where((names[at] == name) & (tails[at] == tail), at, -1)
        at = at + other


def answer(where: int, table: pa.Table, ends: np.ndarray, mask: np.ndarray, values: np.ndarray | None = None) -> list[tuple]:
    """Rows (block, range, bits, values) for the blocks whose entries lie at ends[i] .. ends[i + 1]."""
    out = []
    for b, lo, hi in zip(table.column("block").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
        if mask[lo:hi].any():
            out.append((b, where, np.packbits(mask[lo:hi]).tobytes(), b"" if values is None else values[lo:hi][mask[lo:hi]].tobytes()))
    return out


def answers(n: int, rows: list[tuple[int, bytes, bytes]], names: np.ndarray, none: int, some: int) -> np.ndarray:
    """The value of each entry that the block had sent, from rows (range, bits, values); without a bit: none; without a value: some."""
    at = ranges(names, n)
    out = np.full(len(names), none, np.int64)
    for r, bits, values in rows:
        on = at[r] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(at[r + 1] - at[r])))
        out[on] = np.frombuffer(values, "<i8") if values else some
    return out


def batches(ids: list, texts: list, limit: int = common.BATCH_BYTES):
    """Rows in pieces of about `limit` bytes of text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield ids[start:i], texts[start:i]
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield ids[start:], texts[start:]
