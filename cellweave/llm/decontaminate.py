"""Benchmark decontamination by pigeonhole edit matching.

A passage within e edits of a test item contains one of e + 1 pieces of the item unchanged. An Aho-Corasick automaton finds
the pieces in every text, and Myers' bit-parallel distance, on integers as wide as the item, verifies the text around each
hit. Test items are taken in blocks of bounded size, each with an automaton of its own that goes to all tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Characters of test items in one block: an automaton takes about 100 bytes for each.
BLOCK_CHARS = 1 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def distance_within(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern to any part of the text, the first end of equals; None over the limit."""
    m = len(pattern)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, (limit + 1, 0)
    for end, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best[0]:
                best = (score, end)
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return best if best[0] <= limit else None


class Matcher:
    """Test items, as (item_id, text), ready to be looked for."""

    def __init__(self, items: Iterable[tuple[int, str]], rate: float):
        self.items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            edits = min(int(rate * len(text)), len(text) - 1)
            for k in range(edits + 1):
                at = len(text) * k // (edits + 1)
                pieces.setdefault(text[at : len(text) * (k + 1) // (edits + 1)], []).append((len(self.items), at))
            self.items.append((item_id, text, edits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of the best match of each item that the text has."""
        if not self.items:
            return []
        text = normalise(text)
        around: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, at in places:
                around.setdefault(item, []).append(end + 1 - size - at)
        out = []
        for item, starts in around.items():
            item_id, pattern, edits = self.items[item]
            best = None
            starts = sorted(set(starts))
            low = 0
            while low < len(starts):  # starts whose windows overlap are verified at once
                high = low
                while high + 1 < len(starts) and starts[high + 1] - starts[high] <= edits:
                    high += 1
                begin = max(0, starts[low] - edits)
                found = distance_within(pattern, text[begin : starts[high] + len(pattern) + edits], edits)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], begin + found[1])
                low = high + 1
            if best:
                out.append((item_id, *best))
        return out


@functools.lru_cache(maxsize=4)
def matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(items, rate)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple]:
    held, size = [], 0
    for item_id, text in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        held.append((item_id, text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def contamination(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance and match_end (in the lower-cased text with single spaces) for each item that a text has.

    An item matches where at most `rate` of its characters are inserted, deleted or replaced; of several places the one of
    the least distance is given, the first of equals. Null and empty texts and items match nothing; repeated rows and items
    are reported as often as they occur; other columns are not read; either table may be empty.
    """
    schema = common.arrow_schema(ddl := "doc_id long, item_id long, distance int, match_end long")
    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = df.sparkSession.createDataFrame([], ddl)
    found = []
    for items in blocks(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items: tuple = items) -> Iterator[pa.RecordBatch]:
            look = matcher(items, rate).hits
            for batch in batches:
                yield common.record_batch([(d, *hit) for d, t in zip(*(c.to_pylist() for c in batch.columns)) if t for hit in look(t)], schema)

        found.append(slim.mapInArrow(run, ddl))
    return functools.reduce(DataFrame.union, found) if found else out


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of df, with all their columns, whose text has none of the test items."""
    common.short_batches(df)
    for items in blocks(benchmark, item_id, item_text):
        at = df.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], items: tuple = items, at: int = at) -> Iterator[pa.RecordBatch]:
            look = matcher(items, rate).hits
            for batch in batches:
                yield batch.filter(pa.array([not (t and look(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
