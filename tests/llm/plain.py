"""Plain versions of the operators, and small tables."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
ALPHABET = "the of and to in is that for it as was with be by on not he his but at".split()


def prose(seed, words):
    draw = np.random.default_rng(seed)
    return " ".join(ALPHABET[k] + str(draw.integers(30)) for k in draw.integers(0, len(ALPHABET), words))


def awkward(spark):
    """Nulls, empty, blank, short and very long texts, a null id, repeated rows, and columns whose names operators use inside."""
    long = prose(1, 60_000)
    copy = prose(2, 300)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "short"), (None, prose(3, 40)), (5, long), (6, copy), (7, copy), (8, copy + " end"), (8, copy + " end"), (9, "x" * 3000), (10, "日本語のテキスト " * 30), (11, "a\u0000b ퟿ \U0001f600 c")]
    names = ("block", "range", "rest", "fp", "a", "b", "node", "component", "shard", "slot", "kind", "size", "hashes", "dim")
    data = [(i, t, None if i == 4 else "en", "s", None, *[k] * len(names)) for k, (i, t) in enumerate(rows)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame(data, ddl), rows


def cut_phrases(docs, size=13):
    """(id, text) -> id: (words, removed, digest) by a table of all windows."""
    words = [(LATE if i is None else i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, LATE), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


LATE = (1 << 63) - 1


def cut_bytes(texts, size):
    """For each text what is left, and its removed spans, by a table of all windows."""
    seen = {}
    for t in texts:
        for k in range(len(t) - size + 1):
            seen[t[k : k + size]] = seen.get(t[k : k + size], 0) + 1
    out = []
    for t in texts:
        spans = []
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + size
                else:
                    spans.append([k, k + size])
        kept, at = b"", 0
        for lo, hi in spans:
            kept, at = kept + t[at:lo], hi
        out.append((kept + t[at:], [x for s in spans for x in s]))
    return out


def cut_words(docs, size, first):
    """(id, text) -> (id, the words left): windows that start twice go, or, with first, those that start in an earlier document."""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    count, low = {}, {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            count[key] = count.get(key, 0) + 1
            low[key] = min(low.get(key, LATE), LATE if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if low[key] < (LATE if i is None else i) if first else count[key] > 1:
                gone[k : k + size] = [True] * size
        out.append((i, [x for x, g in zip(w, gone) if not g]))
    return out


def shingles(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []


def similarity(a, b, width=5):
    """Jaccard's, of the sets of shingles."""
    a, b = set(shingles(a, width)), set(shingles(b, width))
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprint(text, width=4, number=0):
    """number: of the word of a long fingerprint, whose hashes are mixed by the splitmix64 finaliser."""
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    if number:
        h = [splitmix(x + number) for x in h]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def splitmix(x):
    x &= MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


MASK = (1 << 64) - 1


def components(fps, radius=4, more=None, bound=0):
    """id -> the smallest id that links reach; fps: id -> fingerprint; more: id -> further words, all together within bound."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            d = (fps[i] ^ fps[j]).bit_count()
            if d <= radius and (more is None or d + sum((a ^ b).bit_count() for a, b in zip(more[i], more[j])) <= bound):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edit_within(pattern, text):
    """The least distance of the pattern to any part of the text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for k, c in enumerate(text):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


def kd_tree(docs, shards):
    """(id, shard) of each (id, text): exact weighted medians along the dimension in which a node is widest."""
    import math
    import zlib

    rows = []
    for i, t in docs:
        raw = (t or "").encode()
        spaces = sum(c in b" \n" for c in raw)
        dims = (math.floor(math.log2(len(raw) + 1) * 2**20), math.floor(len(raw) * 2.0**20 / (len(t or "") + 1)), math.floor(spaces * 2.0**20 / (len(raw) + 1)))
        rows.append((dims, zlib.crc32(raw), (i is not None, i or 0), len(raw) + 1, i))
    span = [max(1, max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) for d in range(3)]
    out = []

    def split(rows, first, k):
        if k == 1 or not rows:
            out.extend((r[4], first) for r in rows)
            return
        widths = [(max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / span[d] for d in range(3)]
        d = widths.index(max(widths))
        key = lambda r: (r[0][d], r[1], r[2])
        rows = sorted(rows, key=key)
        want, before, cut = sum(r[3] for r in rows) * (k // 2) // k, 0, len(rows)
        at = 0
        while at < len(rows):
            end = next((e for e in range(at, len(rows)) if key(rows[e]) != key(rows[at])), len(rows))
            w = sum(r[3] for r in rows[at:end])
            if before + w > want:
                cut = at if want - before <= before + w - want else end
                break
            before, at = before + w, end
        split(rows[:cut], first, k // 2)
        split(rows[cut:], first + k // 2, k - k // 2)

    split(rows, 0, shards)
    return out


class KneserNey:
    """Interpolated character 4-grams of one language, in dictionaries; alphabet: the different symbols of all languages."""

    def __init__(self, texts):
        from collections import Counter

        self.counts = {4: Counter(g for t in texts for g in self.grams(t))}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, c in self.counts.items():
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
            self.total[k], self.kinds[k] = Counter(), Counter(g[:-1] for g in c)
            for g, v in c.items():
                self.total[k][g[:-1]] += v

    @staticmethod
    def grams(text):
        """Letters in lower case, every other run one boundary, boundaries before the text and one after it."""
        flat = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line = "   " + " ".join(flat) + " "
        return [tuple(line[k - 3 : k + 1]) for k in range(3, len(line))]

    def prob(self, gram, alphabet):
        k = len(gram)
        if not k:
            return 1 / alphabet
        total = self.total[k][gram[:-1]]
        lower = self.prob(gram[1:], alphabet)
        if not total:
            return lower
        return max(self.counts[k][gram] - self.discount[k], 0) / total + self.discount[k] * self.kinds[k][gram[:-1]] / total * lower


def votes(text):
    """Each labeller's vote on a text."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n = max(1, len(w))
    upper, lower, digit = (sum(lo <= c <= hi for c in raw) for lo, hi in ((65, 90), (97, 122), (48, 57)))
    other = sum(c & 0xC0 == 0xC0 for c in raw)
    chars = max(1, sum(c & 0xC0 != 0x80 and c not in b" \t\n\v\f\r" for c in raw))
    marks = b"#*$%&|<>"
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines)) / max(1, len(lines))
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    again = len({k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(5)}) / n
    variety, mean = len(set(w)) / n, chars / n
    breaks = raw.count(b"\n")
    ends = sum(raw[k - 1] in b".!?:;\"')" for k in range(1, len(raw)) if raw[k] == 10) / max(1, breaks)
    letters = (upper + lower + other) / chars
    bad = [
        upper / max(1, upper + lower) > 0.5,
        raw.count(b"!") / n > 0.2,
        sum(c in marks for c in raw) / chars > 0.02,
        sum(x[-1] in marks for x in w) / n > 0.15,
        len(w) < 10,
        dup > 0.3,
        again > 0.2,
        len(w) >= 30 and variety < min(0.35, 6 / n**0.5),
        mean < 2.5 or mean > 14,
        digit / chars > 0.15,
        letters < 0.75,
        breaks > 1 and ends < 0.2,
    ]
    good = [False] * 4 + [len(w) >= 50] + [False] * 5 + [letters > 0.9, breaks > 0 and ends > 0.8]
    return [-1 if b else 1 if g else 0 for b, g in zip(bad, good)]


def weak_posteriors(rows, rounds=200):
    """Expectation-maximisation over texts' votes, text by text."""
    import math

    good = [0.1 if -1 in v else 0.95 for v in rows]
    for _ in range(rounds):
        prior = min(0.98, max(0.5, (sum(good) + 8) / (len(rows) + 10)))
        chance = []
        for share in (good, [1 - g for g in good]):
            table = []
            for j in range(len(rows[0])):
                mass = {x: 0.5 + sum(s for v, s in zip(rows, share) if v[j] == x) for x in (-1, 0, 1)}
                table.append({x: m / sum(mass.values()) for x, m in mass.items()})
            chance.append(table)
        new = []
        for v in rows:
            odds = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                each = math.log(chance[0][j][x] / chance[1][j][x])
                odds += min(each, 0) if x < 0 else max(each, 0) if x > 0 else each
            new.append(1 / (1 + math.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, good)) < 1e-9
        good = new
        if done:
            break
    return good
