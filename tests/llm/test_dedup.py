import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import blocks, common, phrases, simhash, suffixes
from cellweave.operators import components
from tests.llm import plain


def small(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@given(st.binary(max_size=400).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_suffix_array_and_prefixes(text, copies):
    data = np.frombuffer(text * copies, np.uint8)
    order, rank = suffixes.suffix_array(data, 64)
    raw = data.tobytes()
    assert sorted(order.tolist()) == list(range(len(raw)))
    cut = [raw[k : k + 64] for k in order.tolist()]
    assert cut == sorted(cut)
    shared = suffixes.common_prefixes(data, order, rank, 64)
    for k, n in enumerate(shared.tolist()):
        a, b = cut[k], cut[k + 1]
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_byte_repeats_are_the_plain_ones(spark):
    draw = random.Random(3)
    shared = [plain.prose(100 + k, draw.randint(20, 60)) for k in range(4)]
    texts = []
    for k in range(30):
        parts = [plain.prose(k, draw.randint(0, 80))]
        if k % 2:
            parts += [draw.choice(shared), plain.prose(1000 + k, draw.randint(0, 30))]
        texts.append(" ".join(parts))
    texts += [texts[1], "é" * 500, "ab" * 300, "x" * 99, "", texts[2] + texts[2]]
    got = suffixes.remove_repeats(small(spark, list(enumerate(texts))), size=100).orderBy("doc_id").collect()
    expected = plain.cut_bytes([t.encode() for t in texts], 100)
    assert [(bytes(x["kept"]), x["removed"]) for x in got] == expected


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    texts = [plain.prose(1, 900).encode(), plain.prose(2, 300).encode()]
    texts.append(texts[0][500:1900])
    block = suffixes.Block([np.frombuffer(t, np.uint8) for t in texts], np.zeros(3, np.int64), 400, 40)
    assert sum(len(r.starts(np.arange(len(r.first)))) for _, r in block.parts) == sum(len(t) - 399 for t in texts)


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_windows_are_counted_by_the_arrays_alone(monkeypatch, unit):
    """Repeats within a block are known from the suffix arrays; without common prefixes none is found."""
    raw = [plain.prose(k, 120) + " " + plain.prose(7, 60) for k in range(3)]
    texts = [np.frombuffer(t.encode(), np.uint8) if unit == "byte" else common.Words([t.encode()]).hashes() for t in raw]
    size = suffixes.SIZE[unit] // 2
    block = suffixes.Block(texts, np.zeros(3, np.int64), size, suffixes.GRAM[unit])
    every, none = np.ones(len(block.mark), bool), np.zeros(len(block.mark), bool)
    names, _, several, _ = suffixes.open_windows(block, every, none, False)
    seen = {}
    for t in texts:
        for k in range(len(t) - size + 1):
            seen[t[k : k + size].tobytes()] = seen.get(t[k : k + size].tobytes(), 0) + 1
    chosen = [n for n in seen.values()]
    assert len(names) == len(chosen) and several.any()
    monkeypatch.setattr(suffixes, "common_prefixes", lambda text, order, rank, limit: np.zeros(len(text) - 1, np.int64))
    monkeypatch.setattr(blocks, "merged", lambda names, tails: (np.arange(sum(map(len, names))), np.arange(sum(map(len, names)))))
    assert not suffixes.open_windows(block, every, none, False)[2].any()


@pytest.mark.parametrize("first", [False, True])
def test_repeated_word_windows_are_the_plain_ones(spark, first):
    draw = random.Random(5)
    shared = [plain.prose(300 + k, draw.randint(20, 40)) for k in range(4)]
    docs = [(k * 7 % 41, "\n ".join([plain.prose(k, draw.randint(0, 60)), draw.choice(shared) if k % 3 else "", plain.prose(600 + k, draw.randint(0, 25))])) for k in range(40)]
    docs += [(90, docs[1][1]), (91, docs[1][1] + " tail"), (92, docs[2][1] * 2), (None, docs[4][1]), (None, docs[4][1])]
    got = suffixes.remove_repeats(small(spark, docs), unit="word", size=20, first=first).collect()
    words = lambda t: plain.WORD.findall(t)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x["doc_id"], words(bytes(x["kept"]).decode())) for x in got), key=key) == sorted(plain.cut_words(docs, 20, first), key=key)


def test_lists_are_merged_in_order_of_both_parts_of_a_name():
    names = [np.array(x, np.uint64) for x in ([1, 5, 5, 9], [5, 5, 7], [], [5])]
    tails = [np.array(x, np.uint32) for x in ([0, 1, 3, 0], [1, 2, 0], [], [3])]
    order, begin = blocks.merged(names, tails)
    pairs = list(zip(np.concatenate(names)[order].tolist(), np.concatenate(tails)[order].tolist()))
    assert pairs == sorted(pairs) and begin.tolist() == [k for k in range(len(pairs)) if not k or pairs[k] != pairs[k - 1]]
    name, tail = np.array([1, 5, 5, 9], np.uint64), np.array([0, 1, 3, 0], np.uint32)
    assert blocks.find(name, tail, np.array([5, 5, 9, 4], np.uint64), np.array([3, 2, 0, 0], np.uint32)).tolist() == [2, -1, 3, -1]


def test_word_repeats_are_the_plain_ones(spark):
    draw = random.Random(4)
    shared = [plain.prose(200 + k, 40) for k in range(3)]
    docs = []
    for k in range(40):
        parts = [plain.prose(k, draw.randint(0, 60)), draw.choice(shared) if k % 3 else "", plain.prose(500 + k, draw.randint(0, 25))]
        docs.append((k * 3 % 41, "\n ".join(parts)))
    docs += [(90, docs[0][1]), (91, docs[0][1]), (92, "a " * 200), (93, "a " * 100), (94, "b " * 200)]
    got = phrases.remove_repeats(small(spark, docs)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = sorted((x["doc_id"], x["n_words"], sum(b - a for a, b in zip(x["removed"][::2], x["removed"][1::2])), digest(x["kept_text"])) for x in got)
    assert rows == sorted(plain.cut_phrases(docs))


@pytest.mark.parametrize("common_places", [0, 1, 16])
def test_automata_find_every_phrase(monkeypatch, common_places):
    """Phrases of one passage, of parts of it, and across pieces that several passages share."""
    monkeypatch.setattr(phrases, "COMMON", common_places)
    draw = np.random.default_rng(8)
    for _ in range(20):
        parts = [draw.integers(0, 5, draw.integers(5, 30)) for _ in range(6)]
        words, low = np.concatenate(parts), np.full(sum(map(len, parts)), phrases.LAST)
        starts = np.cumsum([0, *map(len, parts)])
        for lo, hi in zip(starts[:-1], starts[1:]):
            low[lo : max(lo, hi - 4)] = 3
        known = {tuple(words[k : k + 5]) for k in np.flatnonzero(low < phrases.LAST)}
        automata = phrases.Automata(words, low, starts, 5, 40)
        doc = draw.integers(0, 5, 60)
        expected = np.zeros(60, bool)
        for k in range(56):
            if tuple(doc[k : k + 5]) in known:
                expected[k : k + 5] = True
        got = automata.covered(doc, 4)
        assert (got if got is not None else np.zeros(60, bool)).tolist() == expected.tolist()
        assert automata.covered(doc, 3) is None


def test_simhash_is_the_plain_one(spark):
    base = plain.prose(9, 400).split()
    docs = []
    for k in range(30):
        words = list(base)
        for j in range(k % 6):
            words[(37 * j + k) % 400] = f"changed{k}"
        docs.append((50 - k, " ".join(words).upper() if k % 2 else " ".join(words)))
    docs += [(100 + k, plain.prose(300 + k, 50)) for k in range(10)] + [(200, ""), (201, None), (202, "One two"), (203, "one TWO")]
    got = {x["doc_id"]: x for x in simhash.near_duplicates(small(spark, docs)).collect()}
    fps = {i: plain.fingerprint(t) for i, t in docs}
    assert {i: x["fingerprint"] for i, x in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: x["component_id"] for i, x in got.items()} == plain.components(fps)


@pytest.mark.parametrize("radius", [2, 4])
def test_forest_spans_all_links(radius):
    draw = np.random.default_rng(radius)
    centres = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (15, 3)).astype(np.uint64), axis=1) for c in centres])
    points = np.unique(points)
    linked, root = simhash.forest(points, radius)
    mine = dict(zip(linked.tolist(), root.tolist()))
    expected = plain.components({i: int(p) for i, p in enumerate(points)}, radius)
    assert {i: mine.get(i, i) for i in range(len(points))} == expected


def test_trees_prune(monkeypatch):
    """Points around few centres: most pairs are not compared, and without the tree's search none is found."""
    draw = np.random.default_rng(5)
    centres = draw.integers(0, 1 << 63, 50, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (40, 3)).astype(np.uint64), axis=1) for c in centres]))
    tree = simhash.VantageTree(points)
    pairs = {(min(a, b), max(a, b)) for i, j in tree.within(4) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    every = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    assert pairs == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(every))) if a < b}
    assert tree.compared < 0.5 * len(points) ** 2
    monkeypatch.setattr(simhash.VantageTree, "within", lambda self, radius, members=None: iter(()))
    assert not len(simhash.forest(points, 4)[0])


def test_queries_reach_members_only_links():
    points = np.array([0, 1, 3, 255 << 40, (255 << 40) + 1], np.uint64)
    linked, root = simhash.forest(points, 1, members=np.array([0, 3]))
    assert dict(zip(linked.tolist(), root.tolist())) == {1: 0, 4: 3}


def test_large_shards_are_split_by_rings(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 16)
    draw = random.Random(9)
    fps = {}
    for k in range(40):
        centre = draw.getrandbits(64)
        for j in range(8):
            x = centre
            for b in draw.sample(range(64), draw.randint(0, 3)):
                x ^= 1 << b
            fps[8 * k + j] = x
    rows = [(i, simhash._signed(x), simhash._signed(x)) for i, x in fps.items()]
    distinct = spark.createDataFrame(rows, "doc_id long, fp long, key long")
    edges = simhash.links(distinct.select("fp", "key").distinct(), 4, len(rows))
    got = {x["node"]: x["component"] for x in components.connected(edges).collect()}
    expected = plain.components(fps)
    parts = lambda of: sorted(sorted(g) for g in of.values())
    mine, theirs = {}, {}
    for i, x in fps.items():
        key = simhash._signed(x)
        mine.setdefault(got.get(key, key), set()).add(i)
        theirs.setdefault(expected[i], set()).add(i)
    assert parts(mine) == parts(theirs)


def edited(seed, words, share):
    """A text, with this share of its words replaced."""
    draw = random.Random(seed)
    return " ".join(f"new{draw.randrange(10**6)}" if draw.random() < share else w for w in words)


def test_near_copies_go_and_others_stay(spark):
    docs = [(k, plain.prose(700 + k, 300)) for k in range(60)]
    near = {100 + k: edited(k, docs[k][1].split(), 0.01) for k in range(30)}
    far = {200 + k: edited(k, docs[k][1].split(), 0.2) for k in range(30)}
    every = dict(docs) | near | far
    similar = {i for i in near if plain.similarity(every[i], every[i - 100]) >= 0.85}
    left = {x["doc_id"] for x in simhash.one_of_each(small(spark, list(every.items()))).collect()}
    assert len(similar) > 20 and len(similar - left) >= 0.95 * len(similar)
    assert left >= {i for i, _ in docs} | set(far)


def test_similar_components_are_the_plain_ones(spark):
    docs = [(k, plain.prose(k % 12, 150) if k < 12 else edited(k, plain.prose(k % 12, 150).split(), 0.005 * (k // 12))) for k in range(60)] + [(90, None), (91, "")]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(small(spark, docs), width=5, radius=20, similarity=0.8).collect()}
    fps = {i: plain.fingerprint(t, 5) for i, t in docs}
    more = {i: [plain.fingerprint(t, 5, k) for k in range(1, simhash.LONG + 1)] for i, t in docs}
    assert got == plain.components(fps, 20, more, simhash.bits_apart(0.8, 1024))


def test_recall_of_similar_pairs(spark):
    """Of all pairs of different texts with a five-word Jaccard similarity of 0.8 or more in the documents, 98 % are linked."""
    docs = [(x["doc_id"], x["text"]) for x in common.documents(spark, plain.SF.replace("0.001", "0.01")).collect()]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(common.documents(spark, plain.SF.replace("0.001", "0.01")), width=5, radius=20, similarity=0.8).collect()}
    sets, having = {}, {}
    for i, t in docs:
        sets[i] = frozenset(plain.shingles(t, 5))
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    pairs = {(a, b) for ids in having.values() if len(ids) < 200 for a in ids for b in ids if a < b}
    alike = [(a, b) for a, b in pairs if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 5 and sum(got[a] == got[b] for a, b in alike) >= 0.98 * len(alike)
    together = {}
    for i, c in got.items():
        together.setdefault(c, []).append(i)
    for c, ids in together.items():  # and nothing else is merged: some member is similar to 0.6 at least
        assert all(i == c or any(j != i and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) for j in ids) for i in ids)


def test_the_input_keeps_its_replacement_characters(spark):
    """Only what a cut leaves of a character goes."""
    shared = "é" * 250
    texts = ["plain \ufffd text without any repeat " * 3, "é" + shared + "\ufffdx", "ab" + shared + "y"]
    got = {x["doc_id"]: x["text"] for x in suffixes.without_repeats(small(spark, list(enumerate(texts))), size=400).collect()}
    assert got[0] == texts[0] and "\ufffdx" in got[1] and got[2] == "aby"
    assert suffixes.unhalved(b"\xa9abc\xc3", True, True) == b"abc" and suffixes.unhalved("é\ufffd".encode(), True, True) == "é\ufffd".encode()
    assert suffixes.unhalved(b"x\xf0\x9f\x98", False, True) == b"x" and suffixes.unhalved(b"\x9f\x98", True, True) == b""


def test_every_close_pair_shares_a_shard():
    draw = random.Random(1)
    for radius, agree in ((4, 1), (4, 2), (4, 3), (12, 1), (12, 2)):
        masks = simhash._masks(radius, agree)
        for _ in range(300):
            diff = 0
            for b in draw.sample(range(64), radius):
                diff |= 1 << b
            assert any(not diff & m for m in masks)


def test_components(spark):
    draw = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + draw.randrange(80), 200 + draw.randrange(80)) for _ in range(70)]
    got = {x["node"]: x["component"] for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    df, rows = plain.awkward(spark)
    cut = phrases.remove_repeats(df).collect()
    assert sorted(x["doc_id"] or -1 for x in cut) == sorted(i or -1 for i, _ in rows)
    by = {x["doc_id"]: x for x in cut}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[7]["kept_text"] == "" and by[6]["removed"] == []
    left = suffixes.remove_repeats(df).collect()
    kept = {x["doc_id"]: bytes(x["kept"]) for x in left}
    assert kept[1] == kept[2] == b"" and kept[6] == kept[7] == b"" and kept[5] == dict(rows)[5].encode() and kept[9] == b""
    assert len([x for x in left if x["doc_id"] == 8]) == 2
    whole = suffixes.without_repeats(df)
    assert whole.columns == df.columns and {x["doc_id"] for x in whole.collect()} == {4, None, 5, 11}
    near = simhash.near_duplicates(df).collect()
    assert len(near) == len(rows)
    comp = {x["doc_id"]: x["component_id"] for x in near}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[7] == 6
    one = simhash.one_of_each(df)
    assert one.columns == df.columns
    assert {x["doc_id"] for x in one.collect()} >= {1, 4, 5, 6, None} and not {2, 3, 7} & {x["doc_id"] for x in one.collect()}


def test_empty_tables(spark):
    df = plain.awkward(spark)[0].limit(0)
    for run in (phrases.remove_repeats, suffixes.remove_repeats, suffixes.without_repeats, lambda d: suffixes.without_repeats(d, unit="word", first=True), simhash.near_duplicates, simhash.one_of_each):
        assert run(df).count() == 0


def test_words_are_those_of_the_pattern():
    texts = ["a\x0bb\x0cc\td\r\ne f", "", " x ", "\x1c\x85 é"]
    words = common.Words([t.encode() for t in texts])
    assert words.count.tolist() == [len(plain.WORD.findall(t)) for t in texts]


@pytest.mark.parametrize("n", [256, 1000])
def test_more_ranges_give_the_same(spark, monkeypatch, n):
    """Ranges grow with the blocks; nothing depends on their number."""
    texts = [(k, plain.prose(k, 60) + " " + plain.prose(900 + k % 3, 70)) for k in range(12)]
    df = small(spark, texts)
    want = {i: (w, r, h) for i, w, r, h in plain.cut_phrases(texts)}
    monkeypatch.setattr(blocks, "RANGES", n)
    got = {x["doc_id"]: (x["n_words"], sum(x["removed"][1::2]) - sum(x["removed"][::2]), hashlib.sha256(x["kept_text"].encode()).hexdigest()) for x in phrases.remove_repeats(df).collect()}
    assert got == want
    kept = [bytes(x["kept"]) for x in suffixes.remove_repeats(df, size=100).orderBy("doc_id").collect()]
    assert kept == [t for t, _ in plain.cut_bytes([t.encode() for _, t in texts], 100)]
    assert blocks.n_ranges(32 * n + 1) == n + 1 and blocks.n_ranges(5) == n


def test_words_of_a_fingerprint_are_counted_together():
    """Against a count of every bit of every word; 255 and 256 shingles fill a byte of a counter and pass it."""
    seeds = common.mix(np.arange(1, 10, dtype=np.uint64))
    assert simhash.minimum_hashes(np.zeros(0, np.uint64), seeds) == [] and simhash.long_fingerprint(np.zeros(0, np.uint64)) == bytes(128)
    for n in (1, 2, 255, 256, 511, 5000):
        hashes = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(n))
        words = [common.mix(hashes + np.uint64(k)) if k else hashes for k in range(simhash.LONG + 1)]
        plain_words = [sum(1 << b for b in range(64) if 2 * int((w >> np.uint64(b) & np.uint64(1)).sum()) > n) for w in words]
        assert simhash.long_fingerprint(hashes) == np.array(plain_words, "<u8").tobytes() and simhash.majority(hashes) == plain_words[0]
        assert simhash.minimum_hashes(hashes, seeds) == [int(common.mix(hashes ^ s).min().view(np.int64)) for s in seeds]
