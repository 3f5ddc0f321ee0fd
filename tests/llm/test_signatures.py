import itertools
import random

import numpy as np
import pytest

from cellweave.llm import signatures
from tests.llm import plain


def alike(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def plain_components(docs, width=3, percent=90):
    """(id, size, smallest id reachable) by all pairs."""
    sets = [(i, frozenset(plain.shingles(t, width))) for i, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and alike(x, y, percent):
            root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(x), low.get(find(k)) if x else i) for k, (i, x) in enumerate(sets)), key=str)


def ours(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in signatures.similar_sets(df, **more).collect()), key=str)


def family(draw, base, copies, edits):
    """Copies of a text with up to so many words changed, dropped or added."""
    out = []
    for _ in range(copies):
        w = base.split()
        for _ in range(draw.randint(0, edits)):
            at = draw.randrange(len(w))
            w[at : at + draw.randint(0, 1)] = [f"new{draw.randrange(10**6)}"] * draw.randint(0, 2)
        out.append(" ".join(w))
    return out


def corpus(draw):
    texts = [plain.prose(1000 + k, draw.randint(1, 150)) for k in range(120)]
    for k, size in enumerate((9, 12, 20, 40, 63, 64, 70, 128, 200, 255, 257, 600, 3000)):
        texts += family(draw, plain.prose(k, size), 12, max(1, size // 40))
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("percent", [90, 70])
def test_against_all_pairs(spark, percent):
    docs = corpus(random.Random(percent))
    assert ours(spark, docs, percent=percent) == plain_components(docs, percent=percent)


def test_large_groups_are_peeled_and_cut(spark, monkeypatch):
    """The same links when groups of a few sets count as large: middle sets, chunks and pairs of chunks."""
    docs = corpus(random.Random(3))
    docs += list(enumerate(family(random.Random(4), plain.prose(77, 90), 150, 6), start=10_000))
    for name, value in (("MOST_SETS", 8), ("SHARD", 24), ("PEELS", 2)):
        monkeypatch.setattr(signatures, name, value)
    assert ours(spark, docs) == plain_components(docs)


def test_a_tree_that_finds_nothing_finds_no_link(monkeypatch):
    sets = list(signatures.shingle_sets([t.encode() for t in family(random.Random(5), plain.prose(5, 200), 20, 2)], 3))
    args = np.zeros(20, np.int64), np.array([len(x) for x in sets]), [x.tobytes() for x in sets], 90, True
    assert len(signatures.forest(*args)[0]) == 19
    monkeypatch.setattr(signatures.Join, "possible", lambda self, la, a, *rest: np.zeros(len(a), bool))
    assert len(signatures.forest(*args)[0]) == 0


@pytest.mark.parametrize("exact", [False, True])
def test_pruning_keeps_every_pair(exact):
    """Node pairs are dropped only without a link in them, and far fewer sets are compared than there are pairs."""
    draw = random.Random(8)
    texts = [plain.prose(k, 150).encode() for k in range(300)] + [t.encode() for t in family(draw, plain.prose(999, 150), 30, 3)]
    sets = [x for x in signatures.shingle_sets(texts, 3)]
    kind = signatures.size_class(128)
    n = np.array([len(x) for x in sets])
    signs = [x.tobytes() if exact else signatures.bitmap(x, kind) for x in sets]
    visited = []
    visit = signatures.Join.visit
    signatures.Join.visit = lambda self, la, a, lb, b, s, t: (visited.append(len(a)), visit(self, la, a, lb, b, s, t))[1]
    try:
        a, _ = signatures.forest(np.zeros(len(n), np.int64), n, signs, 90, exact)
    finally:
        signatures.Join.visit = visit
    lists = [set(x.tolist()) for x in sets]
    want = {k for k, x in enumerate(lists) if any(k != j and alike(x, y, 90) for j, y in enumerate(lists))}
    assert len(want) > 20 and len(want - {*a.tolist()}) <= 1  # the root of its one component is not listed
    assert sum(visited) < len(n) ** 2 / 6


def test_awkward_rows(spark):
    df, docs = plain.awkward(spark)
    got = sorted((tuple(r) for r in signatures.similar_sets(df).collect()), key=str)
    assert got == plain_components(docs)
    assert signatures.similar_sets(df.limit(0)).collect() == []
    nulls = [(None, plain.prose(3, 40)), (None, plain.prose(3, 40) + " end"), (None, ""), (4, None), (5, plain.prose(6, 300)), (None, plain.prose(6, 300) + " x")]
    assert ours(spark, nulls) == plain_components(nulls)
