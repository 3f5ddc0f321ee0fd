"""Substring deduplication over words by repeated-phrase automata.

A phrase is a window of `size` consecutive words. Which phrases recur in a document with a smaller id is confirmed in two
exchanges of sorted lists (see blocks.py). First, each block sends the anchors of its phrases: of the ANCHOR-word shingles in
a window the one with the least hash, which equal windows share. Only phrases whose anchor occurs in two documents go on:
their names, with the first document of the block that has them, tell every block which of its phrases start in an
earlier document than another of its own. Where such a phrase stands for the first time in the block, stretches of them in a
row are the block's passages. These are compiled into sharded Aho-Corasick automata over word numbers, and all documents of
the block are streamed through them: only what an automaton hits is an occurrence.

The keys of the automata are the pieces of (size + 1) / 2 words at every so many words of a passage, as every phrase has one
whole; the words around a hit are compared with the passage. A piece with over COMMON places would have many passages to
compare, so the phrases around it are keys themselves.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

SIZE = 13
#: Words of a shingle that can be an anchor.
ANCHOR = 6
#: Words of the keys of one automaton: a node of 50 bytes each.
AUTOMATON_WORDS = 500_000
#: Places of a piece up to which each is compared.
COMMON = 16
#: A null id is later than any other.
LAST = (1 << 63) - 1

ANCHOR_DDL = "range int, block int, names binary, several binary"
BITS_DDL = "block int, range int, bits binary, low binary"
PHRASE_DDL = "range int, block int, names binary, tails binary, low binary, several binary"
FOUND_DDL = "block int, names binary, tails binary, low binary"


class Batch:
    """Words and windows of some texts of a block."""

    def __init__(self, ids: list, texts: list[bytes], size: int):
        self.texts, self.ids, self.size = texts, ids, size
        self.words = common.Words(texts)
        self.docs = np.array([LAST if i is None else i for i in ids], np.int64)
        self.hash = self.words.hashes()
        self.at, self.window = self.words.windows(size, self.hash)
        self.doc = self.docs[self.words.text[self.at]]

    def tails(self, at: np.ndarray) -> np.ndarray:
        return common.span_tail(common.prefix_hash(self.hash, 1), at, at + self.size)

    def anchors(self) -> np.ndarray:
        """The least hash of the shingles in each window."""
        if not len(self.at):
            return self.window
        start = np.arange(len(self.hash) - ANCHOR + 1)
        shingle = common.span_hash(common.prefix_hash(self.hash), start, start + ANCHOR)
        least = shingle[self.at]
        for k in range(1, self.size - ANCHOR + 1):
            np.minimum(least, shingle[self.at + k], out=least)
        return least


def _batches(table: pa.Table, size: int):
    texts = [t or b"" for t in table.column("text").to_pylist()]
    return (Batch(i, t, size) for i, t in blocks.batches(table.column("doc_id").to_pylist(), texts))


def _different(names: np.ndarray, tails: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (name, tail) in order, each with its first and its last document."""
    order = np.lexsort((tails, names))
    names, tails = names[order], tails[order]
    first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (tails[1:] != tails[:-1])))) if len(names) else np.zeros(0, np.int64)
    if not len(first):
        return names, tails, low, high
    return names[first], tails[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _gathered(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _different(*(np.concatenate(x) for x in zip(*parts)))


def _anchors(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    parts = []
    for b in _batches(table, size):
        anchor = b.anchors()
        parts.append(_different(anchor, np.zeros(len(anchor), np.uint32), b.doc, b.doc))
    return _gathered(parts)


def recurring(base: DataFrame, size: int, n: int) -> DataFrame:
    """By n ranges, for each block the names of its phrases that start in an earlier document than its last one with them, and the first."""
    anchor_schema, phrase_schema = common.arrow_schema(ANCHOR_DDL), common.arrow_schema(PHRASE_DDL)

    def anchors(table: pa.Table) -> pa.Table:
        names, _, low, high = _anchors(table, size)
        return pa.Table.from_batches([common.record_batch(blocks.lists(n, table.column("block")[0].as_py(), names, low != high), anchor_schema)])

    def shared(table: pa.Table) -> list[tuple]:
        names = blocks.column(table, "names", "<u8")
        order, begin = blocks.merged(names, [np.zeros(len(x), np.uint32) for x in names])
        count = np.diff(np.concatenate((begin, [len(order)])))
        again = np.empty(len(order), bool)
        again[order] = np.repeat((count > 1) | np.maximum.reduceat(np.concatenate(blocks.column(table, "several", "?"))[order], begin), count)
        return blocks.answer(table.column("range")[0].as_py(), table, np.cumsum([0, *map(len, names)]), again)

    def phrases(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return phrase_schema.empty_table()
        sent = _anchors(docs, size)[0]
        known = sent[blocks.answers(n, list(zip(*(back.column(c).to_pylist() for c in ("range", "bits", "low")))), sent, 0, 1) > 0]
        parts = []
        for b in _batches(docs, size):
            on = _among(b.anchors(), known)
            parts.append(_different(b.window[on], b.tails(b.at[on]), b.doc[on], b.doc[on]))
        names, tails, low, high = _gathered(parts)
        return pa.Table.from_batches([common.record_batch(blocks.lists(n, docs.column("block")[0].as_py(), names, tails, low, low != high), phrase_schema)])

    def earliest(table: pa.Table) -> list[tuple]:
        names, tails, low = (blocks.column(table, c, t) for c, t in (("names", "<u8"), ("tails", "<u4"), ("low", "<i8")))
        order, begin = blocks.merged(names, tails)
        mine = np.concatenate(low)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(mine[order], begin), np.diff(np.concatenate((begin, [len(order)]))))
        later = np.concatenate(blocks.column(table, "several", "?")) | (least < mine)
        rows = []
        ends = np.cumsum([0, *map(len, names)]).tolist()
        for b, name, tail, lo, hi in zip(table.column("block").to_pylist(), names, tails, ends[:-1], ends[1:]):
            on = later[lo:hi]
            if on.any():
                rows.append((b, name[on].tobytes(), tail[on].tobytes(), least[lo:hi][on].tobytes()))
        return rows

    shared_bits = blocks.by_range(base.groupBy("block").applyInArrow(anchors, ANCHOR_DDL), shared, BITS_DDL, n)
    candidates = base.groupBy("block").cogroup(shared_bits.groupBy("block")).applyInArrow(phrases, PHRASE_DDL)
    return blocks.by_range(candidates, earliest, FOUND_DDL, n)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted list has."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Automata:
    """Aho-Corasick automata over word numbers, of a bounded size each.

    words: passages end to end; low: for each place the first document that has the phrase there, LAST where none begins;
    starts: where passages begin, and the end.
    """

    def __init__(self, words: np.ndarray, low: np.ndarray, starts: np.ndarray, size: int, limit: int):
        self.words, self.low, self.size, self.width = words, low, size, (size + 1) // 2
        self.shards, room = [], 0
        places: dict[tuple[int, ...], list[int]] = {}
        numbers = words.tolist()
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            for p in range(lo, hi - self.width + 1, self.width):
                places.setdefault(tuple(numbers[p : p + self.width]), []).append(p)
        keys: list[tuple[tuple[int, ...], list[int]]] = []
        phrases: dict[tuple[int, ...], list[int]] = {}
        for piece, at in places.items():
            if len(at) <= COMMON:
                keys.append((piece, at))
                continue
            for p in at:
                for q in range(max(0, p + self.width - size), p + 1):
                    if low[q] < LAST:
                        phrases.setdefault(tuple(numbers[q : q + size]), [q])
        keys += phrases.items()
        #: Of each key: its words, and where its places are in `place`.
        self.length = np.array([len(k) for k, _ in keys], np.int64)
        self.count = np.array([len(at) for _, at in keys], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.array([p for _, at in keys for p in at], np.int64)
        for number, (key, _) in enumerate(keys):
            if room <= 0:
                self.shards.append(ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE))
                room = limit
            self.shards[-1].add_word(key, number)
            room -= len(key)
        for shard in self.shards:
            shard.make_automaton()

    def covered(self, words: np.ndarray, doc: int) -> np.ndarray | None:
        """A mask of the words in phrases that begin in an earlier document; None if there are none."""
        sequence = tuple(words.tolist())
        hits = [hit for shard in self.shards for hit in shard.iter(sequence)]
        if not hits:
            return None
        end, key = np.array(hits, np.int64).T
        count = self.count[key]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        p = self.place[np.repeat(self.first[key], count) + within]
        length = np.repeat(self.length[key], count)
        d = np.repeat(end, count) + 1 - length
        back = np.arange(self.size - self.width + 1)
        s, q = (d[:, None] - back).ravel(), (p[:, None] - back).ravel()
        fits = (back[None, :] <= self.size - length[:, None]).ravel() & (s >= 0) & (s + self.size <= len(words)) & (q >= 0)
        s, q = s[fits], q[fits]
        earlier = self.low[q] < doc
        s, q = s[earlier], q[earlier]
        every = np.arange(self.size)
        s = s[(words[s[:, None] + every] == self.words[q[:, None] + every]).all(axis=1)]
        return common.covered(s, self.size, len(words)) if len(s) else None


def passages(held: list[tuple[Batch, np.ndarray]], known: np.ndarray, tails: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The words of a block's passages end to end, the first document of the phrase at each place, and where passages begin.

    held: the block's batches with their words' numbers. A phrase is in one passage, where the block has it first.
    """
    seen = np.zeros(len(known), bool)
    words, lows, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
    for b, number in held:
        on = np.flatnonzero(_among(b.window, known))
        entry = blocks.find(known, tails, b.window[on], b.tails(b.at[on]))
        on, entry = on[entry >= 0], entry[entry >= 0]
        one = np.sort(np.unique(entry, return_index=True)[1])
        one = one[~seen[entry[one]]]
        seen[entry[one]] = True
        at, entry = b.at[on[one]], entry[one]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (b.words.text[at[1:]] != b.words.text[at[:-1]]))))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
            words.append(number[at[lo] : at[hi - 1] + size])
            lows.append(np.concatenate((low[entry[lo:hi]], np.full(size - 1, LAST))))
            sizes.append(len(words[-1]))
    return np.concatenate(words), np.concatenate(lows), np.cumsum(sizes)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, kept_text (the words left, joined by one space) and removed (an array of [first, end) word spans).

    Words are `[^\\x20\\x09-\\x0D]+`. A word is removed if a window of `size` words around it also starts in a document
    with a smaller id; windows are judged on the input. A null or empty text has no words; texts shorter than a window
    keep all. Rows with equal ids are one document, none before the other; a null id is after all others. Other columns are
    not read, and an empty table gives no rows.
    """
    n = blocks.n_blocks(df, text_col)
    base = blocks.in_blocks(common.short_batches(df), id_col, text_col, n)
    found = recurring(base, size, blocks.n_ranges(n))
    ddl = "doc_id long, n_words long, kept_text string, removed array<long>"
    schema = common.arrow_schema(ddl)

    def cut(docs: pa.Table, back: pa.Table) -> pa.Table:
        lists = [(np.frombuffer(n, "<u8"), np.frombuffer(t, "<u4"), np.frombuffer(x, "<i8"), np.frombuffer(x, "<i8")) for n, t, x in zip(*(back.column(c).to_pylist() for c in ("names", "tails", "low")))]
        known, tails, low, _ = _gathered(lists)
        held = list(_batches(docs, size))
        numbers = np.unique(np.concatenate([b.hash for b in held]), return_inverse=True)[1] if held else np.zeros(0, np.int64)
        cuts = np.cumsum([0, *(len(b.hash) for b in held)])
        held = [(b, numbers[lo:hi]) for b, lo, hi in zip(held, cuts[:-1], cuts[1:])]
        automata = Automata(*passages(held, known, tails, low, size), size, AUTOMATON_WORDS)
        out = []
        for b, number in held:
            rows = []
            for k, text in enumerate(b.texts):
                lo, hi = int(b.words.first[k]), int(b.words.first[k + 1])
                words, spans = text.split(), []
                gone = automata.covered(number[lo:hi], int(b.docs[k])) if automata.shards and hi - lo >= size else None
                if gone is not None:
                    spans = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                    words = list(compress(words, (~gone).tolist()))
                rows.append((b.ids[k], hi - lo, b" ".join(words).decode("utf-8", "replace"), spans))
            out.append(common.record_batch(rows, schema))
        return pa.Table.from_batches(out, schema)

    return base.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, ddl)


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.expr("aggregate(sequence(0, cast(size(removed) / 2 as int) - 1), 0L, (n, i) -> n + removed[2 * i + 1] - removed[2 * i])")
    removed = F.when(F.size("removed") == 0, F.lit(0).cast("long")).otherwise(spans)
    return remove_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
