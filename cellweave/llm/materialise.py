"""Training-order materialisation: token sequences of one length, permuted and written as fixed-stride shards.

The text is tokenised once; the sequences of each input partition are stored, and counted. Sequence i of partition p has the
index i plus the sequences of the partitions before. A keyed Feistel network over the smallest even number of bits that holds
all indices, walked along its cycle until it lands among them, permutes the indices: the image is the sequence's global slot.
Equal ranges of slots are the shards, one partition each, written in the order of the slots. Record k of a shard starts at
byte k * stride, and `read` goes through the slots in order from any of them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Bytes of a shard, about, and the most shards (beyond, shards are larger: a task streams its own).
SHARD_BYTES, MOST_SHARDS = 16 << 20, 20_000
#: Bytes of token ids, of the first characters of some rows, that intermediate files are compressed against. Which rows these
#: are changes the size of those files and nothing else.
SEEN_BYTES, SEEN_ROWS, SEEN_CHARS = 1 << 18, 200, 20_000
LEVEL = 6
ROUNDS = 6
MANIFEST = "manifest.json"


class Feistel:
    """A keyed permutation of range(size)."""

    def __init__(self, size: int, key: int):
        if not 0 < size <= 1 << 62:
            raise ValueError(f"size {size} is not in 1..2**62")
        self.size = size
        self.half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = common.mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (common.mix(right ^ k) & self.mask)
        return left << self.half | right

    def _walk(self, x, once) -> np.ndarray:
        out = once(np.atleast_1d(np.asarray(x, np.uint64)))
        while (beyond := out >= self.size).any():
            out[beyond] = once(out[beyond])
        return out

    def forward(self, x) -> np.ndarray:
        return self._walk(x, lambda v: self._once(v, self.keys))

    def backward(self, y) -> np.ndarray:
        def once(v: np.ndarray) -> np.ndarray:
            left, right = v >> self.half, v & self.mask
            for k in self.keys[::-1]:
                left, right = right ^ (common.mix(left ^ k) & self.mask), left
            return left << self.half | right

        return self._walk(y, once)


def sequences(docs, length: int, pad_id: int) -> Iterator[tuple[np.ndarray, list, list, list]]:
    """(doc_id, ids) in order, joined and cut every `length` ids -> (ids, doc_ids, starts, lengths); the last is padded."""
    held, who, starts, sizes, room = [], [], [], [], length
    for doc_id, ids in docs:
        at = 0
        while at < len(ids):
            piece = ids[at : at + room]
            held.append(piece)
            who.append(doc_id)
            starts.append(at)
            sizes.append(len(piece))
            at += len(piece)
            room -= len(piece)
            if not room:
                yield np.concatenate(held), who, starts, sizes
                held, who, starts, sizes, room = [], [], [], [], length
    if held:
        yield np.concatenate([*held, np.full(room, pad_id, held[0].dtype)]), who, starts, sizes


def materialise(df: DataFrame, out_uri: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 50256, pad_id: int = 50256, length: int = 2048, key: int = 1234, shards: int | None = None, dtype: str = "<u2") -> DataFrame:
    """Write shards `shard-NNNNNN.bin` and a manifest below out_uri; returns one row per sequence with its slot and its documents.

    slot, shard, record, byte_offset, doc_ids, starts, lengths (the pieces in the record, in order) and ids_crc32 of the
    record's bytes. A null or empty text is the closing id alone; a null doc_id stays null in the list; repeated rows are
    repeated; other columns are not read; an empty table writes no shard. Sequences are cut from the rows of an input
    partition in their order, so their contents follow the partitions. `shards` is by default as many as make SHARD_BYTES each.
    An id that dtype can't hold is an error. Shards are written under another name and then moved, so that a task that is
    run again replaces its shard, and what broken attempts have left is removed. out_uri is any store that
    pyarrow.fs.FileSystem.from_uri opens.
    """
    most = np.iinfo(dtype).max
    if max(end_id, pad_id) > most:
        raise ValueError(f"{dtype} can't hold the ids {end_id} and {pad_id}")
    path = vocabulary or tokens.vocabulary("byte_bpe_50k.tiktoken")
    stride = length * np.dtype(dtype).itemsize
    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = "part int, i long, tokens binary, doc_ids array<long>, starts array<long>, lengths array<int>"
    schema = common.arrow_schema(ddl)

    def encoded(text: str | None) -> np.ndarray:
        ids = tokens.token_ids(text, path, end_id)
        if len(ids) and ids.max() > most:
            raise ValueError(f"{dtype} can't hold the id {ids.max()}")
        return ids.astype(dtype)

    few = slim.select(F.substring("text", 1, SEEN_CHARS).alias("text")).limit(SEEN_ROWS).collect()
    seen = b"".join(encoded(x["text"]).tobytes() for x in few)[:SEEN_BYTES]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=LEVEL, dict_data=_against(seen)).compress
        docs = ((d, encoded(t)) for b in batches for d, t in zip(*(c.to_pylist() for c in b.columns)))
        rows = []
        for n, (ids, *spans) in enumerate(sequences(docs, length, pad_id)):
            rows.append((part, n, pack(ids.tobytes()), *spans))
            if len(rows) == 512:
                yield common.record_batch(rows, schema)
                rows = []
        yield common.record_batch(rows, schema)

    staged = common.store(slim.mapInArrow(cut, ddl), "sequences")
    # one number for each input partition
    counts = sorted(map(tuple, staged.groupBy("part").agg(F.count("*")).collect()))
    total = sum(n for _, n in counts)
    if not total:
        return staged.sparkSession.createDataFrame([], RESULT)
    before = np.cumsum([0, *(n for _, n in counts)])[:-1]
    base = np.zeros(counts[-1][0] + 1, np.int64)
    base[[p for p, _ in counts]] = before
    n_shards = min(total, shards or min(MOST_SHARDS, -(-total * stride // SHARD_BYTES)))
    per_shard = -(-total // n_shards)
    permute = Feistel(total, key)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute.forward(base[batch.column(0).to_numpy()] + batch.column(1).to_numpy()).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard, pa.int32()), pa.array(slot), *batch.columns[2:]], names=["shard", "slot", *batch.schema.names[2:]])

    meta_ddl = "slot long, shard int, doc_ids array<long>, starts array<long>, lengths array<int>, ids_crc32 long"
    meta = common.arrow_schema(meta_ddl)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out_uri)
        attempt, shard, out = TaskContext.get().taskAttemptId(), None, None
        unpack = zstandard.ZstdDecompressor(dict_data=_against(seen)).decompress
        for batch in batches:
            rows = []
            for s, slot, ids, *spans in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    shard, out = s, store.open_output_stream(f"{root}/.{attempt}-{s}")
                ids = unpack(ids)
                out.write(ids)
                rows.append((slot, s, *spans, zlib.crc32(ids)))
            yield common.record_batch(rows, meta)
        if out:
            out.close()
            store.move(f"{root}/.{attempt}-{shard}", f"{root}/{_name(shard)}")

    from pyarrow import fs

    store, root = _store(out_uri)
    store.create_dir(root, recursive=True)
    in_ranges = staged.mapInArrow(placed, "shard int, slot long, tokens binary, doc_ids array<long>, starts array<long>, lengths array<int>").repartitionById(n_shards, "shard").sortWithinPartitions("slot")
    done = common.store(in_ranges.mapInArrow(write, meta_ddl), "slots")
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith("."):
            store.delete_file(left.path)
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps({"sequences": total, "per_shard": per_shard, "length": length, "dtype": dtype, "key": key}).encode())
    record = F.col("slot") - F.col("shard") * F.lit(per_shard).cast("long")
    return done.select("slot", "shard", record.alias("record"), (record * stride).alias("byte_offset"), "doc_ids", "starts", "lengths", "ids_crc32")


RESULT = "slot long, shard int, record long, byte_offset long, doc_ids array<long>, starts array<long>, lengths array<int>, ids_crc32 long"


def _against(seen: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(seen, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(seen) >= 8 else None


def _name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read(uri: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in order: after a stop, go on at the slot that comes next."""
    store, root = _store(uri)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    stride = manifest["length"] * np.dtype(manifest["dtype"]).itemsize
    while slot < manifest["sequences"]:
        shard, record = divmod(slot, manifest["per_shard"])
        with store.open_input_file(f"{root}/{_name(shard)}") as f:
            f.seek(record * stride)
            while raw := f.read(stride):
                yield np.frombuffer(raw, manifest["dtype"])
                slot += 1


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(common.documents(spark, sf_dir), common.shared_dir(spark, "training-order"))
