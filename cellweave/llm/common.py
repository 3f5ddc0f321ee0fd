"""Helpers shared by the training-data operators: shared storage, text batches and vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import shared_dir, stored as store  # noqa: F401

#: Rows per Arrow batch. Documents differ in length by a factor of thousands, so batches are kept short.
ARROW_ROWS = 512
#: Bytes of text that a worker holds as numpy arrays at once (a single longer document is a batch of its own).
BATCH_BYTES = 1 << 20

U64 = np.uint64
#: Bases of two independent polynomials; names that must not collide in a corpus are made of both.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers = [[np.ones(1, U64), np.ones(1, U64)] for _ in _BASES]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches short for what follows; returns df."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def by_bytes(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[list[list]]:
    """Split batches whose last column is a text into pieces of about `limit` bytes of text.

    Yields the columns as lists; the texts are UTF-8 bytes, null as empty.
    """
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        texts = columns[-1] = [t or b"" if not isinstance(t, str) else t.encode() for t in columns[-1]]
        start, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > limit:
                yield [c[start:i] for c in columns]
                start, held = i, 0
            held += len(t) + 1
        if start < len(texts):
            yield [c[start:] for c in columns]


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """`name type, ...` of the simple types that the operators return."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _powers[which]
    if len(held[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            held[k] = np.multiply.accumulate(steps)
    return held[0][:n], held[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial prefix sums: the hash of values[i:j] is span_hash(prefix, i, j)."""
    up, _ = powers(len(values) + 1, which)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    _, down = powers(len(prefix), which)
    return mix((prefix[end] - prefix[start]) * down[start])


def span_tail(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 more bits of a span's name; prefix: of the second polynomial."""
    return (span_hash(prefix, start, end, 1) >> U64(32)).astype(np.uint32)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts, as positions in one byte array."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        self.bytes = np.frombuffer(self.data, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths)
        self.text_start = self.text_end - lengths
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[::2], edge[1::2]
        #: words[first[i]:first[i + 1]] are those of text i
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.bytes), self.start, self.end)

    def windows(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window of `size` words of one text, and its hash."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.text[: n - size + 1] == self.text[size - 1 :])
        return at, span_hash(prefix_hash(hashes), at, at + size)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """A mask of n items: those within `size` items from any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def char_count(column: str) -> Column:
    return F.char_length(F.col(column)).cast("long")
