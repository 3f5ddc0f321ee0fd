"""Jaccard joins of shingle sets by signature trees.

A tree's nodes hold the OR of their sets' token bitmaps, the range of the sets' sizes, and `slack`, the most tokens of one set
that its bitmap does not show. Two sets share at most slack + (bits that both have) tokens, and two nodes' sets no more than
the smaller slack + (bits of both ORs). A dual traversal drops a pair of nodes when that is too little for the smallest sizes
in them, and compares what is left, set by set.

First trees, over bitmaps: distinct sets are dealt by size class and by minimum hashes to shards of about SHARD sets, and
each shard's tree finds candidate links. A link is missed if none of the minima agrees: with 12 of them at a similarity of 0.9
in 10**12 links, at most. Second trees, over the whole sets of each candidate component: exact links. Links come as spanning
forests, as only components are asked for, and a pair inside one component is not compared again.

A shard or component of too many sets is made smaller first: a set from its middle takes all sets linked to it, of which only
those stay that the triangle inequality does not keep away from all others. What is still large is cut into chunks by size,
and each pair of chunks whose sizes fit is a task of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.components import connected

from . import common

#: Sets of one shard, about, and sets and bytes above which a group is split.
SHARD, MOST_SETS, MOST_BYTES = 512, 4096, 16 << 20
#: Chance that a link is missed.
MISSED = 1e-12
#: Children of a node, and pairs of nodes that a task holds at once.
FAN, PIECE = 8, 1 << 14
#: Times that a middle set takes its neighbours out of a large group.
PEELS = 3

U64 = np.uint64


def ways(percent: int) -> int:
    return math.ceil(round(math.log(MISSED) / math.log(1 - percent / 100), 9))


def size_class(n: int) -> int:
    return n.bit_length()


def bitmap(tokens: np.ndarray, kind: int) -> bytes:
    """Of the tokens of a set in a size class: all below 64 tokens, else every other one, at 4 to 8 bits a token."""
    if kind > 6:
        tokens = tokens[(tokens & U64(1)) == 0]
    width = max(256, 1 << (kind + 1))
    bits = np.zeros(width, bool)
    bits[(tokens >> U64(8)) & U64(width - 1)] = True
    return np.packbits(bits).tobytes()


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted hashes of each text's distinct shingles; a text of fewer words is one shingle, without words none."""
    words = common.Words([t.lower() for t in texts])
    hashes = words.hashes()
    at, h = words.windows(width, hashes)
    first = np.searchsorted(at, words.first)
    prefix = common.prefix_hash(hashes)
    for k, n in enumerate(words.count.tolist()):
        if 0 < n < width:
            yield common.span_hash(prefix, words.first[k : k + 1], words.first[k + 1 : k + 2])
        else:
            yield np.unique(h[first[k] : first[k + 1]])


def set_name(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def enough(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many shared tokens of sets with so many in all make a link: 100 * shared >= percent * (total - shared)."""
    return (100 + percent) * shared >= percent * total


class SignatureTree:
    """Nodes over sets in the order given. bits: a bitmap of 64-bit words for each; n: sizes."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        self.bits, self.low, self.high = [bits], [n], [n]
        self.slack = [n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)]
        while len(self.bits[-1]) > 1:
            at = np.arange(0, len(self.bits[-1]), FAN)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.slack.append(np.maximum.reduceat(self.slack[-1], at))

    @property
    def top(self) -> int:
        return len(self.bits) - 1

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, child) of all children."""
        first = nodes * FAN
        count = np.minimum(first + FAN, len(self.bits[level - 1])) - first
        which = np.repeat(np.arange(len(nodes)), count)
        return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


class Join:
    """Links among the sets of one tree, or between those of two, as a forest over all of them."""

    def __init__(self, trees: list[SignatureTree], percent: int, sets: list[np.ndarray] | None = None):
        self.trees, self.percent, self.sets = trees, percent, sets
        self.offset = [0, len(trees[0].low[0])][: len(trees)]
        self.root = np.arange(sum(len(t.low[0]) for t in trees))
        self.compared = 0
        for t in (0, len(trees) - 1)[: len(trees)]:  # first, so that a dense group is one component before its pairs are met
            m = len(trees[t].low[0])
            self.visit(0, np.full(m, len(trees[0].low[0]) // 2), 0, np.arange(m), 0, t)
        self.traverse()

    def possible(self, la: int, a: np.ndarray, lb: int, b: np.ndarray, s: int, t: int) -> np.ndarray:
        """Whether nodes can hold a link: by sizes, then by the most tokens that two of their sets can share."""
        x, y, p = self.trees[s], self.trees[t], self.percent
        ok = (100 * x.high[la][a] >= p * y.low[lb][b]) & (100 * y.high[lb][b] >= p * x.low[la][a])
        a, b = a[ok], b[ok]
        both = np.bitwise_count(x.bits[la][a] & y.bits[lb][b]).sum(axis=1, dtype=np.int64)
        least = np.maximum(x.low[la][a], -(-p * y.low[lb][b] // 100)) + np.maximum(y.low[lb][b], -(-p * x.low[la][a] // 100))
        ok[ok] = enough(both + np.minimum(x.slack[la][a], y.slack[lb][b]), least, p)
        return ok

    def traverse(self) -> None:
        s, t = 0, len(self.trees) - 1
        x, y = self.trees[s], self.trees[t]
        zero = np.zeros(1, np.int64)
        stack = [(x.top, zero, y.top, zero)]
        while stack:
            la, a, lb, b = stack.pop()
            if len(a) > PIECE:
                stack += [(la, a[k : k + PIECE], lb, b[k : k + PIECE]) for k in range(0, len(a), PIECE)]
                continue
            keep = self.apart(la, a, lb, b, s, t)
            a, b = a[keep], b[keep]
            if la == lb == 0:
                self.visit(la, a, lb, b, s, t)
                continue
            keep = self.possible(la, a, lb, b, s, t)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if la >= lb:
                which, a = x.children(la, a)
                la, b = la - 1, b[which]
            else:
                which, b = y.children(lb, b)
                lb, a = lb - 1, a[which]
            if s == t and la == lb:
                once = a <= b if la else a < b
                a, b = a[once], b[once]
            stack.append((la, a, lb, b))

    def apart(self, la: int, a: np.ndarray, lb: int, b: np.ndarray, s: int, t: int) -> np.ndarray:
        """False for pairs of nodes whose sets are all of one component already."""
        one, two = (self.single(level, k) for level, k in ((la, s), (lb, t)))
        return (one[a] != two[b]) | (one[a] < 0)

    def single(self, level: int, t: int) -> np.ndarray:
        """The component of each node's sets, -1 where there are several."""
        lo = hi = self.root[self.offset[t] : self.offset[t] + len(self.trees[t].low[0])]
        for _ in range(level):
            at = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        return np.where(lo == hi, lo, -1)

    def visit(self, la: int, a: np.ndarray, lb: int, b: np.ndarray, s: int, t: int) -> None:
        """Compare sets with sets."""
        if not len(a):
            return
        keep = self.possible(0, a, 0, b, s, t)
        a, b = a[keep], b[keep]
        if not len(a):
            return
        x, y, p = self.trees[s], self.trees[t], self.percent
        u, v = x.bits[0][a], y.bits[0][b]
        total = x.low[0][a] + y.low[0][b]
        both = np.bitwise_count(u & v).sum(axis=1, dtype=np.int64)
        ok = enough(both + np.minimum(x.slack[0][a], y.slack[0][b]), total, p)
        root = self.root
        for i, j, n in zip((a[ok] + self.offset[s]).tolist(), (b[ok] + self.offset[t]).tolist(), total[ok].tolist()):
            i0, j0 = i, j
            while root[i] != i:
                i = root[i] = root[root[i]]
            while root[j] != j:
                j = root[j] = root[root[j]]
            if i == j:
                continue
            if self.sets is not None:
                self.compared += 1
                if not enough(shared(self.sets[i0], self.sets[j0]), n, p):
                    continue
            root[max(i, j)] = min(i, j)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def forest(side: np.ndarray, n: np.ndarray, signs: list[bytes], percent: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index, root index) of the sets of one group that have a link; side: 0, or 0 and 1 where only pairs of both are asked for."""
    sets = None
    if exact:
        sets = [np.frombuffer(x, U64) for x in signs]
        width = 1 << min(16, max(8, int(8 * n.max() - 1).bit_length()))
        bits = np.zeros((len(sets), width // 64), U64)
        for k, x in enumerate(sets):
            row = np.zeros(width, bool)
            row[(x >> U64(8)) & U64(width - 1)] = True
            bits[k] = np.packbits(row).view(U64)
    else:
        bits = np.frombuffer(b"".join(signs), U64).reshape(len(signs), -1)
    cut = int(np.searchsorted(side, 1))
    parts = [slice(0, cut), slice(cut, len(n))] if 0 < cut < len(n) else [slice(0, len(n))]
    if side[-1] and len(parts) == 1:  # one chunk of a pair is empty
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = Join([SignatureTree(bits[s], n[s]) for s in parts], percent, sets).root
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, n, name of the set, and of sets that can have a link: bits, guest (bits in the class below) and minima."""
    k = ways(percent)
    least = -(-percent // (100 - percent))  # a smaller set has a link to none but its equals
    ddl = "doc_id long, n long, name binary, bits binary, guest binary, minima array<long>"
    schema = common.arrow_schema(ddl)
    seeds = common.mix(np.arange(1, k + 1, dtype=U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.by_bytes(batches):
            rows = []
            for doc, x in zip(ids, shingle_sets(texts, width)):
                n, bits, guest, minima = len(x), None, None, None
                if n >= least:
                    kind = size_class(n)
                    bits = bitmap(x, kind)
                    if percent * n <= 100 * ((1 << (kind - 1)) - 1):
                        guest = bitmap(x, kind - 1)
                    minima = [int(common.mix(x ^ s).min().view(np.int64)) for s in seeds]
                rows.append((doc, n, set_name(x), bits, guest, minima))
            yield common.record_batch(rows, schema)

    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, ddl)


def dealt(distinct: DataFrame) -> DataFrame:
    """grp, v, name, n and sign: a row for each set, class and minimum."""
    kind = F.length(F.bin("n"))
    own = F.struct(kind.alias("kind"), F.col("bits").alias("sign"))
    below = F.struct((kind - 1).alias("kind"), F.col("guest").alias("sign"))
    placed = distinct.select("name", "n", "minima", F.explode(F.when(F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, below))).alias("p")).select("name", "n", "minima", "p.kind", "p.sign")
    shards = {r["kind"]: -(-r["count"] // SHARD) for r in placed.groupBy("kind").count().collect()}  # as many as bits in a length
    if not shards:
        shards = {0: 1}
    many = F.create_map(*(F.lit(x) for kv in shards.items() for x in kv))[F.col("kind")]
    placed = placed.select("name", "n", "kind", "sign", many.alias("many"), F.posexplode("minima").alias("way", "v"))
    return placed.select(F.xxhash64("kind", "way", F.pmod("v", "many")).alias("grp"), "v", "name", F.col("n").cast("long").alias("n"), "sign")


def links(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) between names: forests of the links within each group. rows: grp, v, name, n, sign."""
    rows, edges = _peeled(rows, percent, exact)
    ddl, schema = "a binary, b binary", pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(table):
                return
            grp = table.column("grp").combine_chunks()
            same = np.array(pc.equal(grp[1:], grp[:-1]).to_pylist(), bool)
            new = np.flatnonzero(np.concatenate(([True], ~same))).tolist()
            names, signs = table.column("name").to_pylist(), table.column("sign").to_pylist()
            n, side = table.column("n").to_numpy(), table.column("side").to_numpy()
            out = []
            for lo, hi in zip(new, [*new[1:], len(n)]):
                if hi - lo > 1:
                    a, b = forest(side[lo:hi], n[lo:hi], signs[lo:hi], percent, exact)
                    out += [(names[lo + i], names[lo + j]) for i, j in zip(a.tolist(), b.tolist())]
            yield common.record_batch(out, schema)

        for batch in batches:
            if not len(batch):
                continue
            grp = batch.column(0)
            if held and grp[0].as_py() != held[-1].column(0)[-1].as_py():
                yield from settle(pa.Table.from_batches(held))
                held = []
            held.append(batch)
            if sum(map(len, held)) >= 2048 or sum(x.nbytes for x in held) >= MOST_BYTES // 2:  # all groups but the last are whole
                table = pa.Table.from_batches(held)
                g = table.column("grp").combine_chunks()
                last = int(np.argmax(np.array(pc.equal(g, g[-1]).to_pylist(), bool)))
                if last:
                    yield from settle(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    sorted_rows = rows.select("grp", "side", "v", "n", "name", "sign").repartition("grp").sortWithinPartitions("grp", "side", "v", "n")
    found = sorted_rows.mapInArrow(run, ddl)
    return found.union(edges) if edges is not None else found


def _large(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("grp").agg(F.count("*").alias("sets"), F.sum(F.octet_length("sign")).alias("size"))
    return common.store(sizes.where((F.col("sets") > MOST_SETS) | (F.col("size") > MOST_BYTES)), "large")


def _peeled(rows: DataFrame, percent: int, exact: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a column `side`, large groups made smaller and cut; and the links that were found on the way."""
    edges = None
    whole = rows
    large = _large(rows)
    if not large.head(1):
        return rows.withColumn("side", F.lit(0)), None
    hot = common.store(whole.join(large.select("grp"), "grp", "left_semi"), "hot")
    whole = whole.join(large.select("grp"), "grp", "left_anti").withColumn("side", F.lit(0))
    for level in range(PEELS):
        sizes = hot.groupBy("grp", "n").agg(F.count("*").alias("c"), F.min_by("name", F.xxhash64("name", F.lit(level))).alias("name"))
        pivot = sizes.groupBy("grp").agg(F.max_by("name", F.struct("c", "n")).alias("name"))
        pivot = common.store(hot.join(pivot, ["grp", "name"]).select("grp", F.col("name").alias("top"), F.col("n").alias("top_n"), F.col("sign").alias("top_sign")), "middle").dropDuplicates(["grp"])
        met = common.store(_distances(hot.join(pivot, "grp"), percent, exact), "met")
        new = met.where("near and name <> top").select(F.col("name").alias("a"), F.col("top").alias("b"))
        edges = new if edges is None else edges.union(new)
        cut = met.where("not near").groupBy("grp").agg(F.min(F.col("far") - F.col("reach")).alias("cut"))
        stay = met.join(cut, "grp", "left").where("not near or far >= cut").select(*rows.columns)
        rest = common.store(stay, "rest")
        large = _large(rest)
        whole = whole.union(rest.join(large.select("grp"), "grp", "left_anti").withColumn("side", F.lit(0)).select(*whole.columns))
        hot = rest.join(large.select("grp"), "grp", "left_semi")
        if not large.head(1):
            return whole, edges
    return whole.union(_chunks(common.store(hot, "hot"), large, percent).select(*whole.columns)), edges


def _distances(pairs: DataFrame, percent: int, exact: bool) -> DataFrame:
    """near: a link to the middle set; far: a metric distance from it; reach: the farthest that a link of the set goes."""
    part = (100 - percent) / (100 + percent)
    keep = [f for f in pairs.columns if f not in ("top_n", "top_sign")]
    ddl = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in keep) + ", near boolean, far double, reach double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, sign, m, top in zip(*(batch.column(c).to_pylist() for c in ("n", "sign", "top_n", "top_sign"))):
                a, b = np.frombuffer(sign, U64), np.frombuffer(top, U64)
                if exact:
                    s = shared(a, b)
                    rows.append((enough(s, n + m, percent), 1 - s / (n + m - s), 1 - percent / 100 + 1e-9))
                else:
                    only = [int(np.bitwise_count(x).sum()) for x in (a & ~b, b & ~a)]
                    fits = 100 * n >= percent * m and 100 * m >= percent * n and enough(min(n - only[0], m - only[1]), n + m, percent)
                    rows.append((bool(fits), float(sum(only)), n * (1 + 100 / percent) * part + 1e-6))
            more = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.bool_(), pa.float64(), pa.float64()))] if rows else [pa.array([], t) for t in (pa.bool_(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, "near", "far", "reach"])

    return pairs.mapInArrow(run, ddl)


def _chunks(hot: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Large groups as pairs of chunks by size: a chunk meets itself and the later ones whose sizes fit."""
    sizes = hot.groupBy("grp", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("grp").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0)))  # as many rows as different sizes
    bytes_each = F.ceil(F.col("size") / F.col("sets"))
    per = F.greatest(F.lit(1), F.least(F.lit(MOST_SETS // 2), F.floor(F.lit(MOST_BYTES / 2) / bytes_each))).cast("long")
    cut = hot.join(sizes, ["grp", "n"]).join(large.select("grp", per.alias("per")), "grp")
    cut = cut.withColumn("chunk", F.floor((F.col("before") + F.pmod(F.xxhash64("name"), F.col("c"))) / F.col("per"))).drop("c", "before", "per")
    cut = common.store(cut, "chunks")
    spans = cut.groupBy("grp", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = (spans.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "lo", "hi"))) for s in ("a", "b"))
    fits = (F.col("chunk_a") <= F.col("chunk_b")) & (percent * F.col("lo_b") <= 100 * F.col("hi_a"))
    pairs = common.store(left.join(right, "grp").where(fits).select("grp", "chunk_a", "chunk_b"), "pairs")
    key = F.xxhash64("grp", "chunk_a", "chunk_b")
    key = F.unhex(F.md5(F.concat_ws(",", F.hex("grp"), "chunk_a", "chunk_b"))) if dict(hot.dtypes)["grp"] == "binary" else key
    one = cut.join(pairs.withColumn("chunk", F.col("chunk_a")), ["grp", "chunk"]).withColumn("side", F.lit(0))
    two = cut.join(pairs.where("chunk_a < chunk_b").withColumn("chunk", F.col("chunk_b")), ["grp", "chunk"]).withColumn("side", F.lit(1))
    return one.union(two).withColumn("grp", key)


def similar_sets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Two documents link when their sets of distinct `width`-word shingles (A-Z lower-cased) have a Jaccard similarity of
    percent / 100 or more. A text of fewer words is one shingle; without words or null it has none and links to nothing, and
    component_id is its own doc_id. Texts of any length are taken whole. Repeated rows come back as often as they went in; a
    row with a null doc_id keeps its null and takes the component of those that it links to (null if there are none). Other
    columns are not read. An empty table gives no rows.
    """
    prints = common.store(sketches(df, id_col, text_col, width, percent), "sketches")
    distinct = prints.where("n > 0").groupBy("name").agg(F.min_by(F.struct("n", "bits", "guest", "minima"), F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("x"), F.min("doc_id").alias("rep")).select("name", "rep", "x.*")
    distinct = common.store(distinct, "distinct")
    candidates = common.store(links(dealt(distinct.where("bits is not null")), percent, False).distinct(), "candidates")
    groups = connected(candidates).select(F.col("node").alias("name"), F.col("component").alias("grp"))
    wanted = groups.join(distinct.select("name", "rep"), "name")
    edges = common.store(links(_sets(df, id_col, text_col, width, wanted), percent, True).distinct(), "links")
    of = connected(edges).withColumnRenamed("node", "name").join(distinct.select("name", "rep"), "name")
    lowest = of.groupBy("component").agg(F.min("rep").alias("low"))
    of = of.join(lowest, "component").select("name", "low")
    known = common.store(distinct.join(of, "name", "left").select("name", F.coalesce("low", "rep").alias("low")), "components")
    return prints.join(known, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def _sets(df: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """grp, v, name, n and sign, the whole set, of one document for each name wanted; wanted: name, grp, rep (its doc_id)."""
    ddl = "grp binary, v long, name binary, n long, sign binary"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, groups, texts in common.by_bytes(batches):
            rows = []
            for name, grp, x in zip(names, groups, shingle_sets(texts, width)):
                if set_name(x) == name:  # rows may share an id
                    rows.append((grp, int(x[0].view(np.int64)), name, len(x), x.tobytes()))
            yield common.record_batch(rows, schema)

    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    met = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["rep"])).select("name", "grp", "text")
    return common.store(met.mapInArrow(run, ddl).dropDuplicates(["name"]), "sets")


def op11_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(common.documents(spark, sf_dir))
