"""Suffix-array deduplication of strings of bytes, or of words.

Which strings of `size` symbols start twice anywhere is found in shards. The windows of a text are grouped in runs by their
minimizer, the least hash of the GRAM-symbol strings in a window, which equal windows share. Each block of documents sends
one (minimizer, name of the run) entry a run in sorted lists (see blocks.py). A run whose symbols occur twice is repeated as a
whole; a minimizer that occurs once can have no repeat; the runs left, whose minimizer occurs with other symbols too, are
open: repeats begin and end in them. For these each block is a shard. It builds suffix arrays of its open text by
Larsson-Sadakane refinement and takes suffixes that share `size` symbols by Kasai's common prefixes for one kind; a kind's
count is the only trace of repeats within an array. The shards are merged by binary search of the kinds' names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

SIZE = {"byte": 400, "word": 50}
GRAM = {"byte": 40, "word": 8}
#: Low bits of a minimizer's sort key that hold its place; texts are read in pieces of less than that.
PLACE_BITS = 24
PIECE = 1 << 20
#: Symbols of open text in one suffix array: it takes about 60 bytes for each.
ARRAY_SYMBOLS = 1 << 20
#: Positions that Kasai's pass takes in one lane; the lanes move in step.
LANE = 16
#: A document later than all, and one earlier.
NEVER, ALWAYS = (1 << 63) - 1, -(1 << 63)

U64 = np.uint64
RUN_DDL = "range int, block int, marks binary, names binary, tails binary, several binary, low binary"
WINDOW_DDL = "range int, block int, names binary, tails binary, several binary, low binary"
ANSWER_DDL = "block int, range int, round int, bits binary, low binary"


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first `depth` symbols or more, and the rank (the first place of its group) of each.

    The groups of equal prefixes of 8 bytes, or one word, are refined by the ranks as many symbols on, then twice as many and
    so on; groups of one are left alone.
    """
    n = len(text)
    if text.dtype == np.uint8:
        key, done = _packed(text), 8
    else:
        key, done = text, 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def number(slots: np.ndarray, new: np.ndarray) -> None:
        """Ranks of the suffixes in some slots, in order, where `new` marks the first of each group."""
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = first

    slots = np.arange(n)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    number(slots, new)
    while done < depth:
        alone = new & np.concatenate((new[1:], [True])) if len(new) else new
        slots = slots[~alone]
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + done < n, rank[np.minimum(at + done, n - 1)] + 1, 0)
        key = rank[at].astype(U64) << U64(32) | after.astype(U64)
        by = np.argsort(key)
        order[slots] = at[by]
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        number(slots, new)
        done *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    """For each place of the suffix array but the first, the symbols (at most `limit`) shared with the suffix before it.

    Kasai's pass: going through the text, a suffix shares at least one symbol less with its neighbour than the suffix one
    place earlier did with its own. That needs the true order, so it isn't used next to groups that were left tied (which
    share `limit` symbols and more). Lanes of the text are passed in step, and bytes compared eight at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tied = (before >= 0) & (rank == rank[before])
    afresh = ~tied & (np.bincount(rank, minlength=n)[rank] > 1)
    afresh[1:] |= tied[:-1]
    padded = np.concatenate((text, np.zeros(limit + 16, text.dtype)))
    step_by = 8 if text.dtype == np.uint8 else 1
    words = np.ndarray((n + limit + 8,), "<u8", padded.tobytes(), strides=(text.dtype.itemsize,))
    start = np.arange(0, n, LANE)
    shared = np.zeros(n, np.int64)
    held = np.zeros(len(start), np.int64)
    for step in range(LANE):
        at = start + step
        lanes = np.flatnonzero(at < n)
        at = at[lanes]
        other = before[at]
        h = np.where(tied[at], limit, np.where(afresh[at], 0, np.maximum(held[lanes] - 1, 0)))
        room = np.minimum(limit, n - np.maximum(at, other))
        going = np.flatnonzero((other >= 0) & (h < room))
        h = np.where(other >= 0, np.minimum(h, room), 0)
        while len(going):
            a, b = at[going] + h[going], other[going] + h[going]
            differ = words[a] ^ words[b]
            same = np.bitwise_count((differ & (~differ + U64(1))) - U64(1)).astype(np.int64) >> 3 if step_by == 8 else np.zeros(len(differ), np.int64)
            same[differ == 0] = step_by
            h[going] = np.minimum(h[going] + same, room[going])
            going = going[(differ == 0) & (h[going] < room[going])]
        held[lanes] = h
        shared[at] = h
    return shared[order][1:]


class Runs:
    """Windows of some pieces of text, in runs that share a minimizer: starts first .. last of each, in one array of symbols."""

    def __init__(self, pieces: list[np.ndarray], size: int, gram: int):
        self.size = size
        self.data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        #: Bytes are hashed as overlapping strings of eight, which leaves no pattern of single bytes in the polynomials.
        self.lead = 8 if self.data.dtype == np.uint8 else 1
        values = common.mix(_packed(self.data)) if self.lead == 8 else self.data
        self.prefix, self.prefix2 = common.prefix_hash(values), common.prefix_hash(values, 1)
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.end = np.cumsum(lengths)
        self.begin = self.end - lengths
        n = len(self.data)
        if n < size:
            self.first = self.last = np.zeros(0, np.int64)
            self.mark = np.zeros(0, U64)
            return
        start = np.arange(n - gram + 1)
        grams = self.names(start, start + gram)
        place = U64((1 << PLACE_BITS) - 1)
        least = _sliding_min(grams & ~place | start.astype(U64), size - gram + 1)
        valid = np.zeros(len(least), bool)
        for lo, hi in zip(self.begin.tolist(), self.end.tolist()):
            valid[lo : max(lo, hi - size + 1)] = True
        at = np.flatnonzero(valid)
        mark = (least[at] & place).astype(np.int64)
        if len(at):
            new = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1))))
            self.first, self.last = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
            self.mark = grams[mark[new]]
        else:
            self.first = self.last = at
            self.mark = np.zeros(0, U64)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.span_hash(self.prefix, start, end - (self.lead - 1))

    def tails(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.span_tail(self.prefix2, start, end - (self.lead - 1))

    def piece(self, start: np.ndarray) -> np.ndarray:
        """The piece that each start lies in; pieces without symbols hold none."""
        return np.searchsorted(self.end, start, "right")

    def starts(self, which: np.ndarray) -> np.ndarray:
        """Every start of some runs."""
        count = self.last[which] - self.first[which] + 1
        shift = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(count) else np.zeros(0, np.int64)
        return np.arange(int(count.sum())) + shift


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, first byte highest; zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(U64)
    key = padded[:-1] << U64(8) | padded[1:]
    key = key[:-2] << U64(16) | key[2:]
    key = key[:-4] << U64(32) | key[4:]
    return key[: len(data)]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from minima towards both ends of sections of that width."""
    n = len(values)
    padded = np.concatenate((values, np.full(-n % width, ~U64(0)))).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def pieces(texts: list[np.ndarray], size: int):
    """Lists of (text number, place in it, symbols): texts in order, those over PIECE in parts that overlap by a window less one."""
    held, total = [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), PIECE):
            part = t[lo : lo + PIECE + size - 1]
            if lo and len(part) < size:
                continue
            if held and total + len(part) > common.BATCH_BYTES:
                yield held
                held, total = [], 0
            held.append((k, lo, part))
            total += len(part)
    if held:
        yield held


class Block:
    """A block's texts as symbols, their runs, and one entry for each different run.

    docs: the number that stands for each text's document, in the order in which the first occurrence is looked for.
    """

    def __init__(self, texts: list[np.ndarray], docs: np.ndarray, size: int, gram: int):
        self.size = size
        self.parts = [(held, Runs([p for _, _, p in held], size, gram)) for held in pieces(texts, size)]
        self.doc = [docs[np.array([k for k, _, _ in held], np.int64)[r.piece(r.first)]] if len(r.first) else np.zeros(0, np.int64) for held, r in self.parts]
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        mark = join([r.mark for _, r in self.parts], U64)
        name = join([r.names(r.first, r.last + size) for _, r in self.parts], U64)
        tail = join([r.tails(r.first, r.last + size) for _, r in self.parts], np.uint32)
        doc = join(self.doc, np.int64)
        order = np.lexsort((tail, name, mark))
        changed = lambda x: x[order][1:] != x[order][:-1]
        first = np.flatnonzero(np.concatenate(([True], changed(mark) | changed(name) | changed(tail)))) if len(order) else np.zeros(0, np.int64)
        self.mark, self.name, self.tail = (x[order[first]] for x in (mark, name, tail))
        self.count = np.diff(np.concatenate((first, [len(order)]))) if len(first) else first
        self.low, self.high = (f.reduceat(doc[order], first) if len(first) else doc for f in (np.minimum, np.maximum))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), self.count)
        cuts = np.cumsum([0, *(len(r.first) for _, r in self.parts)])
        #: The entry of each run, by part.
        self.entry = [entry[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]


def window_kinds(texts: list[np.ndarray], starts: list[np.ndarray], size: int) -> np.ndarray:
    """The kind of the window at each of some starts of some texts, numbered from 0; equal windows are of one kind.

    The texts are joined to one suffix array; windows of one stretch without a common prefix under `size` are equal.
    """
    text = np.concatenate(texts)
    shift = np.cumsum([0, *(len(t) for t in texts[:-1])])
    at = np.concatenate([s + d for s, d in zip(starts, shift)])
    order, rank = suffix_array(text, size)
    kind = np.concatenate(([0], np.cumsum(common_prefixes(text, order, rank, size) < size)))
    of = np.empty(len(text), np.int64)
    of[order] = kind
    return np.unique(of[at], return_inverse=True)[1]


def open_windows(block: Block, is_open: np.ndarray, whole: np.ndarray, first: bool) -> tuple[np.ndarray, ...]:
    """Names, tails, several and low of the different windows in a block's open runs, in the order of their names.

    One run of each entry is read. several: a window is known to occur twice (first: in two documents); low: its first document.
    """
    lists: list[tuple[np.ndarray, ...]] = []
    held: list[list] = [[] for _ in range(6)]
    total = 0

    def build() -> None:
        texts, starts, name, tail, entry, _ = held
        kind = window_kinds(texts, starts, block.size)
        name, tail, entry = map(np.concatenate, (name, tail, entry))
        order = np.argsort(kind, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], np.diff(kind[order]) > 0)))
        one = order[begin]
        low, high = np.minimum.reduceat(block.low[entry[order]], begin), np.maximum.reduceat(block.high[entry[order]], begin)
        if first:
            several = low != high
        else:
            several = (np.diff(np.concatenate((begin, [len(order)]))) > 1) | np.maximum.reduceat(whole[entry[order]], begin)
        by = np.lexsort((tail[one], name[one]))
        lists.append((name[one][by], tail[one][by], several[by], low[by]))
        for x in held:
            x.clear()

    seen = np.zeros(len(block.mark), bool)
    for (_, r), entry in zip(block.parts, block.entry):
        fresh = is_open[entry] & ~seen[entry]
        _, one = np.unique(np.where(fresh, entry, -1), return_index=True)
        chosen = np.sort(one[fresh[one]]) if len(one) else one
        seen[entry[chosen]] = True
        near = np.flatnonzero(np.concatenate(([True], r.first[chosen][1:] > r.last[chosen][:-1] + 1))) if len(chosen) else []
        for lo, hi in zip(near, [*near[1:], len(chosen)]):
            part = chosen[lo:hi]
            begin, end = int(r.first[part[0]]), int(r.last[part[-1]]) + block.size
            at = r.starts(part)
            for x, y in zip(held, (r.data[begin:end], at - begin, r.names(at, at + block.size), r.tails(at, at + block.size), np.repeat(entry[part], r.last[part] - r.first[part] + 1))):
                x.append(y)
            total += end - begin
            if total >= ARRAY_SYMBOLS:
                build()
                total = 0
    if total:
        build()
    if not lists:
        return np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(0, np.int64)
    names, tails, several, low = (list(x) for x in zip(*lists))
    order, begin = blocks.merged(names, tails)
    names, tails, several, low = (np.concatenate(x)[order] for x in (names, tails, several, low))
    least = np.minimum.reduceat(low, begin)
    again = np.maximum.reduceat(several, begin)
    again |= np.maximum.reduceat(low, begin) != least if first else np.diff(np.concatenate((begin, [len(order)]))) > 1
    return names[begin], tails[begin], again, least


def _window_names(block: Block, is_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and tails of what open_windows gives, without its arrays."""
    names, tails = [], []
    for (_, r), entry in zip(block.parts, block.entry):
        at = r.starts(np.flatnonzero(is_open[entry]))
        names.append(r.names(at, at + block.size))
        tails.append(r.tails(at, at + block.size))
    if not names:
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    name, tail = np.concatenate(names), np.concatenate(tails)
    order = np.lexsort((tail, name))
    name, tail = name[order], tail[order]
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (tail[1:] != tail[:-1]))) if len(name) else np.zeros(0, bool)
    return name[new], tail[new]


def unhalved(piece: bytes, cut_before: bool, cut_after: bool) -> bytes:
    """A piece of UTF-8 without the bytes of characters that cuts at its ends halved."""
    lo, hi = 0, len(piece)
    while cut_before and lo < hi and piece[lo] & 0xC0 == 0x80:
        lo += 1
    if cut_after:
        lead = hi - 1
        while lead >= lo and piece[lead] & 0xC0 == 0x80:
            lead -= 1
        if lead >= lo and piece[lead] >= 0xC0 and hi - lead < (2 if piece[lead] < 0xE0 else 3 if piece[lead] < 0xF0 else 4):
            hi = lead
    return piece[lo:hi]


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte", size: int | None = None, first: bool = False, carry: tuple[str, ...] = (), whole_chars: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes left) and removed (an array of [first, end) byte spans, one after the other).

    Texts are UTF-8 bytes, a null text is empty. With unit `byte`, a byte is removed if a string of `size` bytes (400) around
    it also starts anywhere else, in the same text too. With unit `word`, strings are of `size` words `[^\\x20\\x09-\\x0D]+`
    (50), whatever lies between them, and the words removed go with the white space after them. first: a string is removed
    only where it also starts in a document with a smaller id, so that the first one keeps it, and repeats within one
    document stay. Strings are judged on the input and never cross texts, so shorter texts keep all.
    Repeated rows are texts of their own, so both lose what they share (first: rows with equal ids are one document, and a
    null id is later than any other); a null doc_id stays null; other columns are not read, or those named in `carry` come
    back in the struct `rest`; an empty table gives no rows. whole_chars: bytes of UTF-8 characters that a cut halved go from
    `kept` too.
    """
    size, gram = size or SIZE[unit], GRAM[unit]
    if size < gram + 8:
        raise ValueError(f"size must be {gram + 8} at least")
    n = blocks.n_blocks(df, text_col)
    ranges = blocks.n_ranges(n)
    base = blocks.in_blocks(common.short_batches(df), id_col, text_col, n, carry)
    ddl = "doc_id long, n_bytes long, kept binary, removed array<long>"
    run_schema, window_schema, schema = (common.arrow_schema(x) for x in (RUN_DDL, WINDOW_DDL, ddl))
    ddl += f", rest {base.schema['rest'].dataType.simpleString()}" if carry else ""

    def read(table: pa.Table) -> tuple[list[bytes], np.ndarray, list, Block]:
        """The texts, what stands for their documents, the places of their words, and the block."""
        texts = [t or b"" for t in table.column("text").to_pylist()]
        ids = np.array([NEVER if i is None else i for i in table.column("doc_id").to_pylist()], np.int64) if first else np.zeros(len(texts), np.int64)
        symbols, places = [], []
        for t in texts:
            if unit == "byte":
                symbols.append(np.frombuffer(t, np.uint8))
            else:
                w = common.Words([t])
                symbols.append(w.hashes())
                places.append(np.append(w.start, w.end[-1:]))
        return texts, ids, places, Block(symbols, ids, size, gram)

    def runs(table: pa.Table) -> pa.Table:
        *_, block = read(table)
        several = block.low != block.high if first else block.count > 1
        rows = blocks.lists(ranges, table.column("block")[0].as_py(), block.mark, block.name, block.tail, several, block.low if first else None)
        return pa.Table.from_batches([common.record_batch(rows, run_schema)])

    def least(several: np.ndarray, low: list[np.ndarray], order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each entry: whether its kind is repeated, and the first document that has it."""
        count = np.diff(np.concatenate((begin, [len(order)])))
        again = np.maximum.reduceat(several[order], begin)
        if first:
            by = np.concatenate(low)[order]
            lowest = np.minimum.reduceat(by, begin)
            again = again | (np.maximum.reduceat(by, begin) != lowest)
        else:
            again = again | (count > 1)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(again, count)
        if not first:
            return out, None
        value = np.empty(len(order), np.int64)
        value[order] = np.repeat(lowest, count)
        return out, value

    def judge_runs(table: pa.Table) -> list[tuple]:
        marks, names, tails = blocks.column(table, "marks", "<u8"), blocks.column(table, "names", "<u8"), blocks.column(table, "tails", "<u4")
        mark, name, tail, several = *map(np.concatenate, (marks, names, tails)), np.concatenate(blocks.column(table, "several", "?"))
        order = np.lexsort((tail, name, mark))
        changed = lambda x: x[order][1:] != x[order][:-1]
        new_mark = np.concatenate(([True], changed(mark)))
        new = new_mark | np.concatenate(([True], changed(name) | changed(tail)))
        again, value = least(several, blocks.column(table, "low", "<i8"), order, np.flatnonzero(new))
        group = np.cumsum(new_mark) - 1
        is_open = np.empty(len(mark), bool)
        is_open[order] = (np.bincount(group, new) > 1)[group]
        where, ends = table.column("range")[0].as_py(), np.cumsum([0, *map(len, marks)])
        whole = [(b, r, 1, bits, low) for b, r, bits, low in blocks.answer(where, table, ends, again, value)]
        return whole + [(b, r, 2, bits, low) for b, r, bits, low in blocks.answer(where, table, ends, is_open)]

    def answered(back: pa.Table, which: int, names: np.ndarray, none: int) -> np.ndarray:
        rows = [(r, bits, low) for r, k, bits, low in zip(*(back.column(c).to_pylist() for c in ("range", "round", "bits", "low"))) if k == which]
        return blocks.answers(ranges, rows, names, none, ALWAYS)

    def windows(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return window_schema.empty_table()
        *_, block = read(docs)
        whole = answered(back, 1, block.mark, NEVER) != NEVER
        names, tails, several, low = open_windows(block, answered(back, 2, block.mark, NEVER) != NEVER, whole, first)
        rows = blocks.lists(ranges, docs.column("block")[0].as_py(), names, tails, several, low if first else None)
        return pa.Table.from_batches([common.record_batch(rows, window_schema)])

    def judge_windows(table: pa.Table) -> list[tuple]:
        names, tails = blocks.column(table, "names", "<u8"), blocks.column(table, "tails", "<u4")
        order, begin = blocks.merged(names, tails)
        again, value = least(np.concatenate(blocks.column(table, "several", "?")), blocks.column(table, "low", "<i8"), order, begin)
        return [(b, r, 3, bits, low) for b, r, bits, low in blocks.answer(table.column("range")[0].as_py(), table, np.cumsum([0, *map(len, names)]), again, value)]

    def cut(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        texts, _, places, block = read(docs)
        whole, is_open = answered(back, 1, block.mark, NEVER), answered(back, 2, block.mark, NEVER) != NEVER
        names, tails = _window_names(block, is_open)
        window = answered(back, 3, names, NEVER)
        on = window != NEVER
        names, tails, window = names[on], tails[on], window[on]
        gone: list[list] = [[] for _ in texts]
        for (held, r), entry, doc in zip(block.parts, block.entry, block.doc):
            out = whole[entry] < doc
            asked = np.flatnonzero(is_open[entry] & ~out)
            starts = r.starts(asked)
            if len(names) and len(starts):
                found = blocks.find(names, tails, r.names(starts, starts + size), r.tails(starts, starts + size))
                starts = starts[(found >= 0) & (window[found] < np.repeat(doc[asked], r.last[asked] - r.first[asked] + 1))]
            else:
                starts = starts[:0]
            lo, hi = np.concatenate((r.first[out], starts)), np.concatenate((r.last[out], starts)) + size
            owner = r.piece(lo)
            order = np.lexsort((lo, owner))
            for p, a, b in zip(owner[order].tolist(), lo[order].tolist(), hi[order].tolist()):
                k, place, _ = held[p]
                a, b = a - int(r.begin[p]) + place, b - int(r.begin[p]) + place
                if gone[k] and a <= gone[k][-1][1]:
                    gone[k][-1][1] = max(b, gone[k][-1][1])
                else:
                    gone[k].append([a, b])
        rows = []
        for k, (i, t, spans) in enumerate(zip(docs.column("doc_id").to_pylist(), texts, gone)):
            if places:
                spans = [(int(places[k][lo]), int(places[k][hi])) for lo, hi in spans]
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(t[at:lo])
                at = hi
            kept.append(t[at:])
            if whole_chars:
                last = len(kept) - 1
                kept = [unhalved(x, j > 0, j < last) for j, x in enumerate(kept)]
            rows.append((i, len(t), b"".join(kept), [x for s in spans for x in s]))
        out = pa.Table.from_batches([common.record_batch(rows, schema)])
        return out.append_column("rest", docs.column("rest")) if carry else out

    judged = blocks.by_range(base.groupBy("block").applyInArrow(runs, RUN_DDL), judge_runs, ANSWER_DDL, ranges)
    late = blocks.by_range(base.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(windows, WINDOW_DDL), judge_windows, ANSWER_DDL, ranges)
    return base.groupBy("block").cogroup(judged.union(late).groupBy("block")).applyInArrow(cut, ddl)


def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte", size: int | None = None, first: bool = False) -> DataFrame:
    """df with the texts that remove_repeats leaves.

    What is left of a character that a cut halved goes; all else stays as it is, U+FFFD of the input too. So do rows go of
    which nothing but white space is left.
    """
    rest = tuple(c for c in df.columns if c != text_col)
    left = remove_repeats(df, id_col=id_col, text_col=text_col, unit=unit, size=size, first=first, carry=rest, whole_chars=unit == "byte")
    whole = F.col("kept").cast("string")
    out = left.select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), whole.alias(text_col)).where(F.col(text_col).rlike("\\S"))
    return out.select(*df.columns)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    n_spans = F.floor(F.size("removed") / 2).cast("long").alias("n_spans")
    return remove_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", n_removed, n_spans, F.sha2("kept", 256).alias("kept_sha256"))
