"""Prefix tries of conversations, summed up by leaf-peeling message passing.

A node is a prefix of turns. Its name is a digest of sums over its turns of hashes of (turn, position), so names come from
running sums instead of one round a depth, and the name of a node's parent from the same sums without the last turn. Every
order and running sum is over ranges or blocks of turns with carries, so one conversation of very many turns is spread.

Nodes hold the number of children they wait for. Completed nodes send their subtree's totals to their parents, in one grouped
message a parent, until only the root finishes. A node that waits for a single child holds a pointer to it and jumps in each
round to what that one waits for, so a long unbranched conversation takes as many rounds as its length has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Turns of one conversation whose running sums are made in one group.
BLOCK = 4096
#: Bytes of a list of ids that a task holds at once.
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
_SUMS = ("s0", "s1", "s2", "s3")


def numbered(df: DataFrame, id_col: str, order: list[Column], keep: list[str]) -> DataFrame:
    """id_col, `pos` (1 for the first row of an id in the given order) and the columns kept.

    Rows are sorted in ranges, counted inside each, and carried on over the ranges that an id fills, which are at most as
    many as there are partitions.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(id_col).asc(), *order]
    ordered = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by, F.col("tie").asc()).sortWithinPartitions(*by, F.col("tie").asc())
    ordered = ordered.select(id_col, *keep)
    ddl = ", ".join(f"{n} {t}" for n, t in [*ordered.dtypes, ("part", "int"), ("k", "bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ks = []
            for i in batch.column(0).to_pylist():
                last, n = i, n + 1 if i == last else 1
                ks.append(n)
            arrays = [*batch.columns, pa.array([part] * len(ks), pa.int32()), pa.array(ks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "part", "k"])

    at = common.store(ordered.mapInArrow(run, ddl), "numbered")
    ends = at.groupBy("part").agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.max_by("k", F.struct(id_col, "k")).alias("n")).orderBy("part").collect()
    carry, open_id, seen = [], None, 0
    for e in ends:  # as many as partitions
        if e["lo"] == open_id:
            carry.append((e["part"], e["lo"], seen))
        else:
            seen = 0
        seen = seen + e["n"] if e["hi"] == open_id else e["n"]
        open_id = e["hi"]
    carried = df.sparkSession.createDataFrame(carry, f"part int, {id_col} long, before long")
    return at.join(F.broadcast(carried), ["part", id_col], "left").select(id_col, (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), *keep)


def turns_of(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, pos, `item` (a digest of role and text) and `bytes`, the length of the text in UTF-8."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    item = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    slim = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), item.alias("item"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("item").asc()], ["item", "bytes"])


def shared_openings(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of conversation c - c % group; h = crc32(c as decimal) % (most + 1).

    Returns the rebuilt turns, and conv_id with `length`, the number of rebuilt turns (0 for a conversation without any).
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"source": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % (most + 1)})
    lengths = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    convs = convs.join(lengths, "source", "left").withColumn("base", F.least("h", F.coalesce("source_n", F.lit(0))))
    convs = common.store(convs.withColumn("length", F.col("base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    own = turns.join(convs.select("conv_id", "h", "base"), "conv_id").where("pos > h").select("conv_id", (F.col("base") + F.col("pos") - F.col("h")).alias("pos"), "item", "bytes")
    firsts = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "source")
    given = firsts.join(convs.select("conv_id", "source", "h"), "source").where("pos <= h").select("conv_id", "pos", "item", "bytes")
    return own.union(given), convs.select("conv_id", "length")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *(c.cast("string") for c in (depth, *sums)))))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent and bytes: a row for each conversation and prefix of one turn or more."""
    one, two = F.xxhash64("item", "pos"), F.xxhash64("pos", F.lit("second"), "item")
    low = F.lit(0xFFFFFFFF)
    halves = dict(zip(("v0", "v1", "v2", "v3"), (x for h in (one, two) for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32)))))
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("long")
    valued = turns.withColumns({**halves, "block": block})
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = valued.groupBy("conv_id", "block").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(4)))
    carry = blocks.select("conv_id", "block", *(F.sum(f"v{k}").over(earlier).alias(f"c{k}") for k in range(4))).where("block > 0")
    run = valued.select("*", *(F.sum(f"v{k}").over(inside).alias(f"r{k}") for k in range(4))).join(carry, ["conv_id", "block"], "left")
    run = run.withColumns({s: F.col(f"r{k}") + F.coalesce(f"c{k}", F.lit(0)) for k, s in enumerate(_SUMS)})
    sums = [F.col(s) for s in _SUMS]
    return run.select("conv_id", F.col("pos").alias("depth"), _name(F.col("pos"), sums).alias("node"), _name(F.col("pos") - 1, [s - F.col(f"v{k}") for k, s in enumerate(sums)]).alias("parent"), "bytes")


def peeled(nodes: DataFrame) -> DataFrame:
    """node, n_children, leaves and saved, summed over each node's subtree; nodes: node, parent (null: the root), own.

    Each round is written to the shared folder. A parent's messages are one aggregate, whatever its number of children.
    """
    kids = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    first = nodes.join(kids.withColumnRenamed("parent", "node"), "node", "left").select("node", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.lit(None).cast("binary").alias("heir"), "own")
    now = first.select("node", "parent", "n_children", F.col("n_children").alias("waiting"), "heir", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"), (F.col("n_children") == 0).alias("done"))
    finished = []
    while True:
        now = common.store(now, "peel")
        fresh, rest = now.where("done"), now.where("not done")
        finished.append(fresh)
        if not rest.head(1):
            break
        mail = fresh.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("m"), F.sum("leaves").alias("ml"), F.sum("saved").alias("ms"))
        ends = fresh.select(F.col("node").alias("heir"), F.col("leaves").alias("el"), F.col("saved").alias("es"))
        met = rest.join(mail, "node", "left").join(ends, "heir", "left")
        counts, ended = F.col("heir").isNull() & F.col("m").isNotNull(), F.col("el").isNotNull()
        pick = lambda a, b: F.when(counts, F.col(a)).when(ended, F.col(b)).otherwise(0)
        met = met.select("node", "parent", "n_children", F.when(ended, 0).when(counts, F.col("waiting") - F.col("m")).otherwise(F.col("waiting")).alias("waiting"), "heir", (F.col("leaves") + pick("ml", "el")).alias("leaves"), (F.col("saved") + pick("ms", "es")).alias("saved"))
        met = common.store(met.withColumn("done", F.col("waiting") == 0), "met")
        still = met.where("not done")
        only = still.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("kid"))
        ahead = still.where("heir is not null").select(F.col("node").alias("heir"), F.col("heir").alias("next"), F.col("leaves").alias("al"), F.col("saved").alias("as_"))
        moved = still.join(only, "node", "left").join(ahead, "heir", "left")
        heir = F.when(F.col("heir").isNull() & (F.col("waiting") == 1), F.col("kid")).otherwise(F.coalesce("next", "heir"))
        moved = moved.select("node", "parent", "n_children", "waiting", heir.alias("heir"), (F.col("leaves") + F.coalesce("al", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("as_", F.lit(0))).alias("saved"), "done")
        now = moved.union(met.where("done").select(*moved.columns))
    out = finished[0]
    for f in finished[1:]:
        out = out.union(f)
    return out.select("node", "n_children", "leaves", "saved")


def id_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of each node's conv_ids in rising order, joined by commas; ends: node, conv_id.

    Ids are sorted in ranges. A node inside one range is done there; the ids of others travel as texts of CHUNK bytes and
    are streamed through one hash, which has to see them in turn but never holds them.
    """
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.select("node", "conv_id").repartitionByRange(ranges, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    ddl = "node binary, part int, seq long, text binary, ends_sha256 string"
    schema = pa.schema([("node", pa.binary()), ("part", pa.int32()), ("seq", pa.int64()), ("text", pa.binary()), ("ends_sha256", pa.string())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, held, size, seq, first = TaskContext.get().partitionId(), None, [], 0, 0, True
        rows: list[tuple] = []
        for batch in batches:
            for name, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if held:
                        text = ",".join(held).encode()
                        alone = not first and seq == 0
                        rows.append((node, part, seq, None if alone else text, hashlib.sha256(text).hexdigest() if alone else None))
                    first = node is None
                    node, held, size, seq = name, [], 0, 0
                held.append(str(c))
                size += len(held[-1]) + 1
                if size >= CHUNK:
                    rows.append((node, part, seq, ",".join(held).encode(), None))
                    held, size, seq = [], 0, seq + 1
            if len(rows) >= 64:
                yield common.record_batch(rows, schema)
                rows = []
        if held:
            rows.append((node, part, seq, ",".join(held).encode(), None))
        yield common.record_batch(rows, schema)

    found = common.store(ordered.mapInArrow(collect, ddl), "ends")
    out = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, rows = None, None, []
        for batch in batches:
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("node", "text"))):
                if name != node:
                    if node is not None:
                        rows.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
        if node is not None:
            rows.append((node, state.hexdigest()))
        yield common.record_batch(rows, out)

    cut = found.where("text is not null").select("node", "part", "seq", "text").repartition("node").sortWithinPartitions("node", "part", "seq")
    return found.where("text is null").select("node", "ends_sha256").union(cut.select("node", "text").mapInArrow(join, "node binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node of the trie of all conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. turns: conv_id, pos, item, bytes; lengths: conv_id, length."""
    rows = common.store(prefixes(turns), "prefixes")
    top = _name(F.lit(0), [F.lit(0)] * 4)
    count = F.count("*").alias("n_convs")
    root = lengths.agg(count, F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(top.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("bytes"))
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), count, F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"))
    nodes = common.store(nodes.union(root), "nodes")
    totals = peeled(nodes.select("node", "parent", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")))
    last = rows.join(lengths, "conv_id").where("depth = length").select("node", "conv_id").union(lengths.where("length = 0").select(top, "conv_id"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(totals, "node").join(id_digests(last), "node", "left").join(parents, "parent", "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared: bool = False) -> DataFrame:
    """The prefix trie of the conversations in df; shared: of conversations with the openings of shared_openings.

    Turns are ordered by turn, null first; rows with the same turn by role and a digest of role and text; repeated rows are
    turns of their own. A null role or text is empty, rows without an id belong to no conversation. Conversations and texts
    of any length are taken whole. Other columns are not read. An empty table gives no rows, not even a root.
    """
    turns = turns_of(df, id_col, turn_col, role_col, text_col)
    if shared:
        return prefix_trie(*shared_openings(turns))
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared=True)
