import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellweave.llm import tries

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(item):
    return hashlib.sha256(f"{len(item[0].encode())}:{item[0]}{item[1]}".encode()).digest()[:16]


def plain_trie(rows, shared):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2], digest(x[2:])))] for c, v in own.items()}
    if shared:
        built = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - c % 5, [])[:h] + v[h:]
        own = built
    members, ends = {}, {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below = [out[k] for k in kids.get(p, [])]
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        up = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), up, len(members[p]), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(ids.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[0], r[1]))


def ours(df, shared):
    return sorted((tuple(r[c] for c in COLUMNS) for r in tries.conversation_trie(df, shared=shared).collect()), key=lambda r: (r[0], r[1]))


def talk(draw, convs, most=9):
    rows = []
    for c in convs:
        for t in range(draw.randint(1, most)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", "", None, "été"])))
    return rows


@pytest.mark.parametrize("shared", [False, True])
def test_against_the_plain_trie(spark, shared):
    draw = random.Random(5)
    rows = talk(draw, draw.sample(range(400), 250)) + [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "user", "lost"), (1000, 2, "user", "x" * 100_000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert ours(df, shared) == plain_trie(rows, shared)


def test_copies_share_one_leaf(spark, monkeypatch):
    """Ids of one node in several ranges, streamed in chunks, hash as one list."""
    monkeypatch.setattr(tries, "CHUNK", 50)
    rows = [(c, t, "user", f"same {t}") for c in range(900) for t in range(2)] + [(c, 0, "user", "other") for c in range(1000, 1100)]
    assert ours(spark.createDataFrame(rows, DDL).repartition(6), False) == plain_trie(rows, False)


def test_a_long_conversation_is_spread(spark, monkeypatch):
    """Runs over several blocks and partitions, and takes rounds as its length has digits."""
    monkeypatch.setattr(tries, "BLOCK", 16)
    rounds = []
    store = tries.common.store
    monkeypatch.setattr(tries.common, "store", lambda df, label: (rounds.append(label), store(df, label))[1])
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(700)] + [(8, t, "user", f"turn {t % 3}") for t in range(300)] + talk(random.Random(1), range(20, 40))
    df = spark.createDataFrame(rows, DDL).repartition(4)
    assert ours(df, False) == plain_trie(rows, False)
    assert rounds.count("peel") <= 16


def test_empty_and_clashing(spark):
    assert ours(spark.createDataFrame([], DDL), True) == []
    assert ours(spark.createDataFrame([(None, 1, "user", "x")], DDL), True) == []
    rows = talk(random.Random(2), range(12))
    df = spark.createDataFrame(rows, DDL)
    clash = df.withColumns({c: F.lit(1) for c in ("pos", "item", "bytes", "node", "parent", "part", "k", "h", "n", "block", "heir", "own", "depth", "tie")})
    assert ours(clash, True) == ours(df, True) == plain_trie(rows, True)
