"""SimHash near-duplicates through vantage-point trees.

Links of `radius` bits are found in shards of fingerprints. The first partition is by balls of Hamming distance on a part of
the bits: the bits are cut into `radius + b` blocks, two fingerprints within the radius agree on `b` blocks at least, and every
fingerprint is put in the shard of each choice of `b` blocks, that is in every shard whose boundary it may overlap. A shard
with over SHARD_POINTS of them is split further by rings of the distance to a vantage point, and again; a fingerprint is a
member of its own ring and a query of each ring within the radius. A task builds a vantage-point tree of a shard's members,
prunes branches by the triangle inequality, and returns a spanning forest of the exact pairs instead of all of them.
Equal fingerprints are merged before anything is shuffled, so a group of copies is one row in its shards.

Sixty-four bits tell similar texts from others up to a radius of about 8. Where a similarity of shingles is asked for, links
are wider: then the first partition is by minimum hashes of the shingles, of which similar texts share some, and the links
that the trees find in its shards are confirmed by LONG more words of fingerprint.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.components import connected

from . import common

SEED = 42
#: Comparisons that cost as much as one more row of a fingerprint in a shard.
ROW_COST = 2000
#: Members above which a shard is split by rings.
SHARD_POINTS = 1 << 15
#: Times that a shard can be split by rings; points that all lie at the same distances can't be.
MOST_SPLITS = 4
#: Words of 64 bits by which a fingerprint is longer where a similarity is asked for.
LONG = 15
#: Standard deviations of a long fingerprint's distance by which the bound for a similarity is wider.
SLACK = 2.5
#: Chance that texts just as similar as asked for share no shard.
MISSED = 1e-6
#: Numbers of the words of a long fingerprint; word 0 is the SimHash itself.
_WORDS = np.arange(LONG + 1, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the `width`-word shingles of a lower-cased (A-Z) text; a shorter one is one shingle, without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[width - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of the shingles; 0 without words."""
    hashes = shingle_hashes(text, width)
    return majority(hashes) if len(hashes) else 0


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash and LONG more words, of the shingles' hashes mixed with the number of the word."""
    return majorities(hashes, _WORDS).astype("<u8").tobytes() if len(hashes) else bytes(8 * (LONG + 1))


def minimum_hashes(hashes: np.ndarray, seeds: np.ndarray) -> list[int]:
    """The least of the shingles' hashes under each seed, as signed longs; none without shingles."""
    parts = [common.mix(hashes[k : k + 4096] ^ seeds[:, None]).min(axis=1) for k in range(0, len(hashes), 4096)]
    return np.min(parts, axis=0).view(np.int64).tolist() if parts else []


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    return int(majorities(hashes, _WORDS[:1])[0])


def majorities(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each number of a word the bits that are set in over half of the hashes mixed with it (0: as they are).

    All words are counted together: a bit is a one-byte lane, and 255 rows of lanes are added as longs at once.
    """
    counts = np.zeros(len(words) * 64, np.int64)
    for k in range(0, len(hashes), 255):
        part = hashes[k : k + 255, None]
        rows = common.mix(part + words) if len(words) > 1 else part.copy()
        rows[:, :1] = part
        lanes = np.unpackbits(rows.view(np.uint8), bitorder="little").view(np.uint64).reshape(len(part), -1)
        counts += lanes.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


class VantageTree:
    """Members within a ball of the vantage point go left, the others right; queries visit the sides that their balls overlap."""

    def __init__(self, points: np.ndarray):
        self.points = points
        #: Pairs compared, of all pairs of a member and a query.
        self.compared = 0

    def within(self, radius: int, members: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of indices of points at most `radius` apart, each once or more; members: one of each pair is among these."""
        everything = np.arange(len(self.points))
        stack = [(everything if members is None else members, everything)]
        leaf = radius * radius
        while stack:
            members, queries = stack.pop()
            if not len(members) or not len(queries):
                continue
            if len(members) <= leaf:
                self.compared += len(members) * len(queries)
                for part in range(0, len(queries), 4096):
                    q = queries[part : part + 4096]
                    i, j = np.nonzero(np.bitwise_count(self.points[q][:, None] ^ self.points[members][None, :]) <= radius)
                    yield q[i], members[j]
                continue
            top = members[len(members) // 2]
            d = np.bitwise_count(self.points[members] ^ self.points[top]).astype(np.int64)
            dq = np.bitwise_count(self.points[queries] ^ self.points[top]).astype(np.int64)
            self.compared += len(queries)
            near = queries[dq <= radius]  # first, so that a dense ball is one component before its pairs are met
            yield near, np.broadcast_to(top, near.shape)
            bound = int(np.partition(d, len(d) // 2)[len(d) // 2])
            if bound == d.max():
                bound -= 1
            inside = d <= bound
            if not inside.any():  # all members are at one distance, so they equal the vantage point
                continue
            stack.append((members[inside], queries[dq <= bound + radius]))
            stack.append((members[~inside], queries[dq > bound - radius]))


def forest(points: np.ndarray, radius: int, members: np.ndarray | None = None, words: np.ndarray | None = None, bound: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index, root index) of the points that have a link, roots left out: the components of one shard.

    words: further words of each fingerprint, of which linked ones differ in at most `bound` bits, the point's included.
    """
    root = np.arange(len(points))
    for i, j in VantageTree(points).within(radius, members):
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
        if words is not None and len(i):
            alike = np.bitwise_count(points[i] ^ points[j]).astype(np.int64) + np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= bound
            i, j = i[alike], j[alike]
        for a, b in zip(i.tolist(), j.tolist()):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(i):
            root = _flat(root)
    linked = np.flatnonzero(root != np.arange(len(points)))
    return linked, root[linked]


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _masks(radius: int, agree: int, bits: int = 64) -> list[int]:
    """A bit mask for each choice of `agree` of `radius + agree` blocks."""
    n = radius + agree
    blocks = [sum(1 << b for b in range(bits * k // n, bits * (k + 1) // n)) for k in range(n)]
    return [sum(choice) for choice in itertools.combinations(blocks, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, ways: int = 0) -> DataFrame:
    """doc_id, the fingerprint as a signed long `fp`, and `key`: the same.

    ways: of a similarity, the number of minimum hashes; then key is a digest of `words`, the bytes of the long fingerprint,
    and `minima` has the hashes, none for a text without words.
    """
    ddl = "doc_id long, fp long, key binary, words binary, minima array<long>" if ways else "doc_id long, fp long, key long"
    schema = common.arrow_schema(ddl)
    seeds = common.mix(np.arange(1, ways + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.by_bytes(batches):
            if ways:
                rows = []
                for doc, t in zip(ids, texts):
                    hashes = shingle_hashes(t, width)
                    words = long_fingerprint(hashes)
                    rows.append((doc, int.from_bytes(words[:8], "little", signed=True), hashlib.blake2b(words, digest_size=16).digest(), words, minimum_hashes(hashes, seeds)))
                yield common.record_batch(rows, schema)
            else:
                fps = [_signed(fingerprint(t, width)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(fps, pa.int64())], schema=schema)

    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, ddl)


def _agree(radius: int, n: int) -> int:
    """Blocks beyond the radius for which n evenly spread fingerprints cost least: a row a choice, and comparisons in its shard."""
    return min(range(1, 5), key=lambda b: math.comb(radius + b, b) * (ROW_COST + n / 2 ** (64 * b // (radius + b))))


def links(distinct: DataFrame, radius: int, n: int, bound: int = 0) -> DataFrame:
    """Edges (a, b) between keys: a forest over distinct fingerprints (fp, key) that spans every pair that is linked."""
    first = [F.lit(0).cast("long").alias("ring"), F.lit(True).alias("member")]
    if bound:
        placed = distinct.select("fp", "key", "words", F.posexplode("minima").alias("part", "value")).select("part", "value", *first, "fp", "key", "words")
    else:
        masks = _masks(radius, _agree(radius, n))
        shards = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)])
        placed = distinct.select("fp", "key", F.explode(shards).alias("s")).select("s.part", "s.value", *first, "fp", "key")
    placed = _split(placed, radius)
    kind = dict(distinct.dtypes)["key"].replace("bigint", "long")
    ddl = f"a {kind}, b {kind}"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        part, value, ring, fp = (table.column(c).to_numpy() for c in ("part", "value", "ring", "fp"))
        member, key = table.column("member").to_numpy(), table.column("key")
        order = np.lexsort((fp, ring, value, part))
        new = np.flatnonzero(np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (part, value, ring)], axis=0))))
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(fp)]):
            if hi - lo > 1:
                here = order[lo:hi]
                own = key.take(pa.array(here))
                words = np.frombuffer(b"".join(table.column("words").take(pa.array(here)).to_pylist()), "<u8").reshape(-1, LONG + 1)[:, 1:] if bound else None
                a, b = forest(fp[here].view(np.uint64), radius, np.flatnonzero(member[here]), words, bound)
                if len(a):
                    yield from pa.Table.from_arrays([own.take(pa.array(x)).cast(f.type) for x, f in zip((a, b), schema)], schema=schema).to_batches()

    return placed.repartition("part", "value", "ring").mapInArrow(run, ddl).distinct()


def _split(placed: DataFrame, radius: int) -> DataFrame:
    """Shards of too many members split by the distance of fingerprints to a vantage point, until they are small or can't be split.

    The distances of a shard's members are counted (65 numbers at most) and cut into rings of about SHARD_POINTS. A fingerprint
    goes to its own ring as what it was, and as a query to the others that hold a distance within the radius of its own.
    """
    shard = ("part", "value", "ring")
    for level in range(MOST_SPLITS):
        large = placed.where("member").groupBy(*shard).agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("top")).where(F.col("n") > SHARD_POINTS).drop("n")
        large = common.store(large, "large")
        if not large.head(1):
            break
        far = placed.join(large, list(shard)).withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("top"))))
        counts = far.where("member").groupBy(*shard, "d").count()
        before = F.sum("count").over(W.partitionBy(*shard).orderBy("d")) - F.col("count")
        rings = counts.select(*shard, "d", F.floor(before / SHARD_POINTS).alias("ring_no")).groupBy(*shard, "ring_no").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        own = F.col("d").between(F.col("lo"), F.col("hi"))
        split = far.join(rings, list(shard)).where((F.col("d") >= F.col("lo") - radius) & (F.col("d") <= F.col("hi") + radius))
        split = split.select("part", "value", F.xxhash64("ring", "ring_no").alias("ring"), (F.col("member") & own).alias("member"), *placed.columns[4:])
        placed = common.store(placed.join(large, list(shard), "left_anti").select(*split.columns).union(split), "rings")
    return placed


def bits_apart(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts with this Jaccard similarity of shingles differ at most, but for chance.

    Texts of equal size whose shingles have the Jaccard similarity s are at the angle whose cosine is 2 s / (1 + s); a bit
    differs with the share p of that angle in a half turn, and SLACK standard deviations of that many bits are added.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Fingerprints link at `radius` differing bits or fewer. similarity (under 1): of these links only those stay whose long
    fingerprints (1024 bits) differ in at most bits_apart(similarity), and that share a minimum hash, which texts of that
    similarity fail to do with a chance of MISSED. A null or empty text has fingerprint zero and is linked like any
    other. Repeated rows come back as often as they went in; a row with a null doc_id keeps its null and takes the component
    of the others with its fingerprint (null if there are none). Other columns are not read. An empty table gives no rows.
    """
    bound = bits_apart(similarity, 64 * (LONG + 1)) if similarity else 0
    ways = math.ceil(round(math.log(MISSED) / math.log(1 - similarity), 9)) if similarity else 0
    prints = common.store(fingerprints(df, id_col, text_col, width, ways), "fingerprints")
    kept = [F.first(c).alias(c) for c in ("words", "minima") if ways]
    distinct = common.store(prints.groupBy("fp", "key").agg(F.min("doc_id").alias("rep"), *kept), "distinct")
    edges = common.store(links(distinct.drop("rep"), radius, distinct.count(), bound), "links")
    member = connected(edges)
    linked = member.join(distinct.withColumnRenamed("key", "node"), "node")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("low"))
    of = member.join(lowest, "component").select(F.col("node").alias("key"), "low")
    known = common.store(distinct.join(of, "key", "left").select("key", F.coalesce("low", "rep").alias("component_id")), "components")
    return prints.join(known, "key").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 20, similarity: float | None = 0.8) -> DataFrame:
    """The rows of df, with all their columns, without those that share a component with a smaller doc_id.

    By default texts of which five-word shingles are similar to 0.8 are near copies: fingerprints within 20 bits, and confirmed
    by the long ones. Of texts of just that similarity 99 in 100 are so near. Rows with equal ids are one document and stay or
    go together; rows with a null id can't be chosen among and stay.
    """
    found = near_duplicates(df, id_col=id_col, text_col=text_col, width=width, radius=radius, similarity=similarity)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return df.join(gone, df[id_col].cast("long") == gone["gone_id"], "left_anti")
