import itertools
import os
import zlib

import numpy as np
import pytest

from cellweave.llm import common, kdtree, materialise, packing, tokens
from tests.llm import plain


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_both_vocabulary_files_give_the_same_ids():
    texts = ["", " a  b\n\n c\t", "don't WE'LL é日本 😀", "x" * 3000, "a\x1cb \x85 c", "<|endoftext|> 12 345"]
    for t in texts:
        assert tokens.encoder(tokens.vocabulary("byte_bpe_50k.tiktoken"))(t) == ids_of(t)


def test_added_token_is_one_id():
    """As the plain call of tokenizers has it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plainly = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n x", "<|endoftext|", "don't é日本 😀", "a  <|endoftext|>  b"]:
        expected = [*plainly.encode(t, add_special_tokens=False).ids, 7]
        for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
            assert tokens.token_ids(t, tokens.vocabulary(name), 7).tolist() == expected


def test_pieces_make_up_the_documents(spark):
    df, rows = plain.awkward(spark)
    got = packing.pack(df.coalesce(1), window=256).collect()
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append(x)
    part = 0
    for seq in by.values():
        seq.sort(key=lambda x: x["offset"])
        at = 0
        for x in seq:
            assert x["offset"] == at
            at += x["length"]
        assert at <= 256
        part += at < 256
    assert part <= 1
    seen = {}
    for x in got:
        seen.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]))
    for i, t in {i: t for i, t in rows if i != 8}.items():
        ids = np.array([*ids_of(t), 1], "<u4")
        pieces, at = sorted(seen[i]), 0
        for start, n, crc, total in pieces:
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    assert sum(n for _, n, _, _ in seen[8]) == 2 * (len(ids_of(dict(rows)[8])) + 1)
    assert packing.pack(df.limit(0)).count() == 0


def test_sum_of_squares_takes_the_cheapest_level():
    draw = np.random.default_rng(0)
    window = 20
    packer = packing.SumOfSquares(window)
    level = [0] * (window + 1)
    for k in range(400):
        s = int(draw.integers(1, window))
        costs = {}
        for h in range(window - s + 1):
            if h == 0 or level[h]:
                n = list(level)
                if h:
                    n[h] -= 1
                if h + s < window:
                    n[h + s] += 1
                costs[h] = sum(x * x for x in n[1:window])
        packer.place(k, 0, s, np.zeros(s, np.uint32))
        now = packer.level[1:window]
        assert (now**2).sum() == min(costs.values())
        level = packer.level.tolist()


def test_any_number_of_open_windows():
    """Thousands that no other piece fits: memory holds their shapes, and closing them loses no token and leaves one short."""
    docs = [(k, np.arange(k, k + 12, dtype=np.uint32)) for k in range(6000)]
    windows = list(packing.pack_documents(docs, 20))
    assert sum(sum(p[3] for p in w) < 20 for w in windows) <= 1
    seen = {}
    for w in windows:
        for doc, start, total, length, crc in w:
            assert total == 12 and crc == zlib.crc32(docs[doc][1][start : start + length].tobytes())
            seen.setdefault(doc, []).append((start, length))
    for pieces in seen.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == 12
    assert len(seen) == 6000


def test_scratch_slots_are_used_again():
    packer = packing.SumOfSquares(20)
    for k in range(500):
        assert packer.place(k, 0, 13, np.arange(13, dtype=np.uint32)) is None
        assert [p[3] for p in packer.place(k, 0, 7, np.arange(7, dtype=np.uint32))] == [13, 7]
    assert packer.slots == 1


@pytest.mark.parametrize("size", [1, 2, 3, 100, 1000, 4097])
def test_feistel_permutes(size):
    f = materialise.Feistel(size, 99)
    image = f.forward(np.arange(size))
    assert sorted(image.tolist()) == list(range(size))
    assert (f.backward(image) == np.arange(size)).all()
    if size > 99:
        assert (image != materialise.Feistel(size, 98).forward(np.arange(size))).any()


def test_shards_round_trip(spark, tmp_path):
    df, rows = plain.awkward(spark)
    out = f"file://{tmp_path}/shards"
    got = materialise.materialise(df.coalesce(2), out, length=128, shards=3).orderBy("slot").collect()
    assert [x["slot"] for x in got] == list(range(len(got)))
    pieces = {}
    for x in got:
        with open(f"{tmp_path}/shards/shard-{x['shard']:06d}.bin", "rb") as f:
            f.seek(x["byte_offset"])
            raw = f.read(256)
        assert len(raw) == 256 and zlib.crc32(raw) == x["ids_crc32"]
        ids, at = np.frombuffer(raw, "<u2"), 0
        for doc, start, n in zip(x["doc_ids"], x["starts"], x["lengths"]):
            pieces.setdefault(doc, []).append((start, ids[at : at + n].tolist()))
            at += n
    for i, t in {i: t for i, t in rows if i != 8}.items():
        assert [k for _, p in sorted(pieces[i]) for k in p] == [*ids_of(t), 50256]
    assert materialise.materialise(df.limit(0), f"file://{tmp_path}/none").count() == 0
    by_slot = [x["ids_crc32"] for x in got]
    for at in (0, 1, len(got) // 2, len(got) - 1):
        assert [zlib.crc32(x.tobytes()) for x in materialise.read(out, at)] == by_slot[at:]
    assert len(list(itertools.islice(materialise.read(out), 5))) == 5 and not list(materialise.read(out, len(got)))
    assert not [x for x in os.listdir(f"{tmp_path}/shards") if x.startswith(".")]
    with pytest.raises(ValueError, match="can't hold"):
        materialise.materialise(df, out, end_id=70_000)
    again = materialise.materialise(df.coalesce(2), out, length=128, shards=3).orderBy("slot").collect()
    assert [x["ids_crc32"] for x in again] == [x["ids_crc32"] for x in got]


def test_slots_are_the_plain_ones(spark, tmp_path):
    """Sequences joined by hand from each partition, and a Feistel network and its cycle walk in plain numbers."""
    docs = [(k, plain.prose(k, 20 + 7 * k % 90)) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    parts = df.rdd.glom().collect()
    got = {x["slot"]: x["ids_crc32"] for x in materialise.materialise(df, f"file://{tmp_path}/slots", length=64, key=77, shards=4).collect()}
    crcs = []
    for rows in parts:
        ids = [k for x in rows for k in [*ids_of(x["text"]), 50256]]
        ids += [50256] * (-len(ids) % 64)
        crcs += [zlib.crc32(np.array(ids[k : k + 64], "<u2").tobytes()) for k in range(0, len(ids), 64)]
    half = ((len(crcs) - 1).bit_length() + 1) // 2
    keys = [plain.splitmix(77 + k * 0x9E3779B97F4A7C15) for k in range(1, materialise.ROUNDS + 1)]

    def image(x):
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for k in keys:
                left, right = right, left ^ (plain.splitmix(right ^ k) & (1 << half) - 1)
            x = left << half | right
            if x < len(crcs):
                return x

    assert got == {image(k): c for k, c in enumerate(crcs)}


def balanced(rows, shards, tolerance):
    size = {}
    for x in rows:
        size[x["shard"]] = size.get(x["shard"], 0) + x["size"]
    whole = sum(size.values())
    biggest = max(x["size"] for x in rows)
    assert all(abs(size.get(k, 0) - whole / shards) <= tolerance * whole / shards + 4 * biggest for k in range(shards))


def test_kd_tree_on_documents(spark):
    docs = common.documents(spark, plain.SF)
    rows = kdtree.slots(kdtree.partition(docs, shards=5), 20).collect()
    plain_rows = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert len(rows) == len(plain_rows)
    for x in rows:
        raw = (plain_rows[x["doc_id"]] or "").encode()
        assert x["size"] == len(raw) + 1 and x["text_crc32"] == zlib.crc32(raw)
    balanced(rows, 5, 0.05)
    for k in range(5):
        assert sorted(x["slot"] for x in rows if x["shard"] == k) == list(range(sum(x["shard"] == k for x in rows)))


def test_kd_tree_splits_a_hot_group(spark):
    rows = [(k, "the same text") for k in range(300)] + [(1000 + k, plain.prose(k, 1 + k % 9)) for k in range(300)]
    got = kdtree.partition(spark.createDataFrame(rows, "doc_id long, text string"), shards=16).collect()
    balanced(got, 16, 0.05)
    assert len(got) == 600


def test_kd_tree_is_the_plain_one(spark):
    docs = [(k * 37 - 900, plain.prose(k % 50, 3 + k * k % 71)) for k in range(200)] + [(-(1 << 63), ""), ((1 << 63) - 1, ""), (None, ""), (-1, None), (-2, None), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["shard"]) for x in kdtree.partition(df, shards=7, tolerance=0).collect())
    assert got == sorted((i is None, i or 0, k) for i, k in plain.kd_tree(docs, 7))


def test_kd_tree_awkward(spark):
    df, rows = plain.awkward(spark)
    got = kdtree.slots(kdtree.partition(df, shards=4)).collect()
    assert sorted(x["doc_id"] or -1 for x in got) == sorted(i or -1 for i, _ in rows)
    assert {x["shard"] for x in got} <= {0, 1, 2, 3} and {x["size"] for x in got if x["doc_id"] in (1, 2)} == {1}
    assert kdtree.slots(kdtree.partition(df.limit(0), shards=4)).count() == 0
    assert kdtree.partition(df, shards=None, target_bytes=10**9).select("shard").distinct().count() == 1
