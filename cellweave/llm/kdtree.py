"""K-d tree partitioning into shards of near-equal bytes, with DataFrame functions alone.

A node that stands for several shards is split at the weighted median (or the fraction that its shards ask for) along the
metadata dimension in which it is widest, relative to the whole table. The median is found by counting: the bytes of a
node's rows are summed in intervals of the dimension, the interval that the wanted weight falls into is divided again, and
so on; only these sums, a thousand for each node, reach the driver. Rows are ordered by the dimension, then by the text's
CRC, then by id, so equal texts stay together unless one text's copies are more than the tolerance allows to move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

INTERVALS = 1024
#: Share of a shard's bytes by which a cut may miss the wanted weight.
TOLERANCE = 0.002
#: Rows of one window when slots are numbered.
SLOT_ROWS = 250_000

#: What rows are ordered by; a doc_id as its upper and its lower 32 bits, so that counting can't overflow.
STEPS = ("dim", "text_crc32", "id_high", "id_low")
#: The least and the largest value of each step after the first; a null id is below all others.
ENDS = {"text_crc32": (0, (1 << 32) - 1), "id_high": (-(1 << 31) - 1, (1 << 31) - 1), "id_low": (0, (1 << 32) - 1)}


def metadata(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.shiftright(F.col(id_col).cast("long"), 32), F.lit(ENDS["id_high"][0])).alias("id_high"),
        F.coalesce(F.col(id_col).cast("long").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)).alias("id_low"),
        F.floor(F.log2(F.octet_length(text) + 1.0) * (1 << 20)).cast("long").alias("d_length"),
        F.floor(F.octet_length(text) * float(1 << 20) / (F.char_length(text) + 1)).cast("long").alias("d_width"),
        F.floor(F.octet_length(F.regexp_replace(text, "[^ \n]", "")) * float(1 << 20) / (F.octet_length(text) + 1)).cast("long").alias("d_spaces"),
    )


DIMENSIONS = ("d_length", "d_width", "d_spaces")


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table as literals in the plan."""
    values = ", ".join("(" + ", ".join("cast(null as bigint)" if x is None else f"bigint('{x}')" for x in r) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({names})")


class Node:
    """Shards first .. first + k - 1; the state of the search for its cut."""

    def __init__(self, first: int, k: int):
        self.first, self.k = first, k
        self.step = 0
        self.fixed: list[int] = []  # the values of earlier steps at which the cut lies

    def begin(self, low: int, high: int, before: int) -> None:
        self.low, self.high, self.before = low, high, before

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // INTERVALS)


def partition(df: DataFrame, *, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32 and shard of each row; `shards` of them, or as many as make leaves of target_bytes.

    size is the text's UTF-8 bytes plus 1. A null text is an empty one and a null doc_id is ordered first; repeated rows are
    rows of their own; other columns are not read. An empty table gives no rows. Rows that agree in every dimension, the
    text's CRC and the id can't be told apart and go to one side of a cut.
    """
    spark = df.sparkSession
    meta = common.store(metadata(df, id_col, text_col), "metadata")
    total, *ends = meta.agg(F.sum("size"), *(f(d) for d in DIMENSIONS for f in (F.min, F.max))).first()
    if target_bytes:
        shards = max(1, round((total or 0) / target_bytes))
    spans = [max(1, (ends[2 * i + 1] or 0) - (ends[2 * i] or 0)) for i in range(len(DIMENSIONS))]
    placed = meta.withColumn("shard", F.lit(0).cast("long"))
    nodes = [Node(0, shards)] if total else []
    while nodes := [n for n in nodes if n.k > 1]:
        placed, nodes = _split(spark, placed, nodes, spans, tolerance * total / shards)
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))


def _split(spark: SparkSession, placed: DataFrame, nodes: list[Node], spans: list[int], slack: float) -> tuple[DataFrame, list[Node]]:
    """Split every node once; returns the table with the new shards, and the new nodes."""
    by = {n.first: n for n in nodes}
    firsts = _table(spark, [(n.first,) for n in nodes], "shard")
    for row in placed.join(F.broadcast(firsts), "shard").groupBy("shard").agg(F.sum("size").alias("w"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max))).collect():
        node = by[row["shard"]]
        widths = [(row[f"max_{d}"] - row[f"min_{d}"]) / s for d, s in zip(DIMENSIONS, spans)]
        node.dim = max(range(len(DIMENSIONS)), key=lambda i: widths[i])
        node.want = row["w"] * (node.k // 2) // node.k
        node.begin(row[f"min_{DIMENSIONS[node.dim]}"], row[f"max_{DIMENSIONS[node.dim]}"], 0)
        node.cut = None
        node.present = True
    live = [n for n in nodes if hasattr(n, "present")]
    dimmed = placed.join(F.broadcast(_table(spark, [(n.first, n.dim) for n in live], "shard, dim_no")), "shard").withColumn("dim", F.element_at(F.array(*DIMENSIONS), (F.col("dim_no") + 1).cast("int")))
    while open_ := [n for n in live if n.cut is None]:
        state = _table(spark, [(n.first, n.step, *(n.fixed + [None] * 3)[:3], n.low, n.high, n.width) for n in open_], "shard, step, fixed0, fixed1, fixed2, low, high, width")
        value = F.element_at(F.array(*STEPS), (F.col("step") + 1).cast("int"))
        here = (F.col("fixed0").isNull() | (F.col("dim") == F.col("fixed0"))) & (F.col("fixed1").isNull() | (F.col("text_crc32") == F.col("fixed1"))) & (F.col("fixed2").isNull() | (F.col("id_high") == F.col("fixed2"))) & value.between(F.col("low"), F.col("high"))
        sums = dimmed.join(F.broadcast(state), "shard").where(here).groupBy("shard", F.floor((value - F.col("low")) / F.col("width")).cast("long").alias("i")).agg(F.sum("size").alias("w"))
        tallies: dict[int, list] = {}
        for shard, i, w in sums.collect():
            tallies.setdefault(shard, []).append((i, w))
        for n in open_:
            _narrow(n, sorted(tallies[n.first]), slack)
    cuts = _table(spark, [(n.first, n.k // 2, *n.cut) for n in live], "shard, k, cut0, cut1, cut2, cut3")
    right = F.struct(*STEPS) > F.struct("cut0", "cut1", "cut2", "cut3")
    moved = dimmed.join(F.broadcast(cuts), "shard").select(*(c for c in placed.columns if c != "shard"), (F.col("shard") + F.when(right, F.col("k")).otherwise(0)).alias("shard"))
    rest = placed.join(F.broadcast(firsts), "shard", "left_anti").select(*moved.columns)
    out = moved.union(rest)
    new = [m for n in live for m in (Node(n.first, n.k // 2), Node(n.first + n.k // 2, n.k - n.k // 2))]
    return common.store(out, "tree"), new


MOST = (1 << 63) - 1


def _narrow(n: Node, tally: list[tuple[int, int]], slack: float) -> None:
    """Choose the interval that the wanted weight falls into, or the cut. Rows up to the cut, inclusive, go left."""
    before = n.before
    for i, w in tally:
        if before + w > n.want:
            break
        before += w
    else:
        i, w = tally[-1]
        before -= w
    low, high = n.low + i * n.width, min(n.high, n.low + (i + 1) * n.width - 1)
    below, above = n.want - before, before + w - n.want
    if below <= slack or above <= slack:
        end = low - 1 if below <= above else high
        n.cut = tuple((n.fixed + [end, MOST, MOST, MOST])[:4])
    elif low < high:
        n.begin(low, high, before)
    elif n.step == 3:
        n.cut = tuple((n.fixed + [low - 1 if below <= above else low])[:4])
    else:
        n.fixed, n.step = [*n.fixed, low], n.step + 1
        n.begin(*ENDS[STEPS[n.step]], before)


def slots(df: DataFrame, rows_per_window: int = SLOT_ROWS) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: numbered in sections of a shard, with the sizes of the sections before."""
    sections = max(1, -(-df.groupBy("shard").count().agg(F.max("count")).first()[0] // rows_per_window)) if df.head(1) else 1
    cut = df.withColumn("section", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(sections)))
    sizes = cut.groupBy("shard", "section").count()
    first = sizes.select("shard", "section", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(W.partitionBy("shard", "section").orderBy("doc_id", "text_crc32")) - 1
    return cut.withColumn("own", own).join(first, ["shard", "section"]).withColumn("slot", (F.col("base") + F.col("own")).cast("long")).drop("section", "own", "base")


def op6_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    null: Column = F.lit(None).cast("int")
    return slots(partition(common.documents(spark, sf_dir))).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", null.alias("grown_shard"))
