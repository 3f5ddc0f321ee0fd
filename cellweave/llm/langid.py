"""Language identification by interpolated Kneser-Ney character models, one per language.

Letters are lower-cased and every other run is one boundary. The counts of all 4-grams of all training rows are gathered
with Spark, and so are the continuation counts, absolute discounts and interpolated probabilities of Kneser and Ney: nothing
is left out, however many n-grams there are. The models are looked up together in sorted hash arrays, for each order the
hashes of all n-grams that any language has, and for each its interpolated log probability in every language. The arrays are
cut by hash into parts of bounded size, which are broadcast one by one. A text goes to the language of least cross-entropy per character. Rejection is calibrated:
a text is accepted up to the cross-entropy that training rows of that language have, with an allowance for its length. All
training rows are scored for that, and counted by their cross-entropies in steps of 1 / STEPS nats.
"""

from __future__ import annotations

import functools
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Bytes of rows in a part of a hash array, about.
PART_BYTES = 32 << 20
#: Bytes of parts that a worker keeps; it loads the others for each batch.
HELD_BYTES = 256 << 20
#: Steps of a nat in which the cross-entropies of training rows are counted.
STEPS = 4096
#: The least share of a language where the rejection bounds are fitted on some rows only.
LEAST_SHARE = 200
#: Letters of a row that counts as long for calibration, and long rows that give a language a bound of its own.
LONG, LEAST_LONG = 100, 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letter() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def symbols(text: str) -> np.ndarray:
    """Letters with single boundaries (0) between words and at both ends; the start has ORDER - 1 boundaries.

    A letter is its 16-bit code point; one beyond is the pair of its UTF-16, which no other letter has a part of.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter()[points], points, 0)
    if len(points) and points.max() > 0xFFFF:
        pair = points > 0xFFFF
        points = np.repeat(points, 1 + pair)
        place = np.arange(len(pair)) + np.cumsum(pair) - pair
        second = place[pair] + 1
        over = points[second] - 0x10000
        points[second - 1], points[second] = 0xD800 + (over >> 10), 0xDC00 + (over & 0x3FF)
    s = points.astype(np.uint16)
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    if len(s):
        keep[0] = s[0] != 0
    s = s[keep]
    tail = np.zeros(0 if len(s) and s[-1] == 0 else 1, np.uint16)
    return np.concatenate((np.zeros(ORDER - 1, np.uint16), s, tail))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed 4-gram at every letter or boundary of the texts, where each text begins, and its number of letters."""
    parts = [symbols(t) for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    s = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    packed = s.copy()
    for k in range(1, ORDER):
        packed[k:] |= s[:-k] << np.uint64(16 * k)
    end = np.cumsum(size)
    inner = np.ones(len(s), bool)
    for k in range(ORDER - 1):
        inner[end - size + k] = False
    first = np.concatenate(([0], np.cumsum(size - ORDER + 1)))
    letters = np.array([np.count_nonzero(p) - np.count_nonzero((p & 0xFC00) == 0xDC00) for p in parts], np.int64)
    return packed[inner], first, letters


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2 if doc_id is not None else False


class Model:
    """Log probabilities of all languages in sorted hash arrays; levels[k] is of (k + 1)-grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: language -> (packed 4-grams, sorted, and how often each was seen)."""
        self.languages = sorted(counts)
        keys = [np.unique(np.concatenate([self._types(counts[x][0], k) for x in self.languages])) if counts else np.zeros(0, np.uint64) for k in range(1, ORDER + 1)]
        self.prob, self.back = [], []
        alphabet = max(2, len(keys[0]))
        below = {x: None for x in self.languages}
        for k in range(1, ORDER + 1):
            prob = np.zeros((len(keys[k - 1]), len(self.languages)))
            context = np.unique(keys[k - 1] >> np.uint64(16))
            back = np.ones((len(context), len(self.languages)))
            for j, x in enumerate(self.languages):
                gram, count = self._counted(*counts[x], k)
                n1, n2 = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
                discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
                total = np.zeros(len(context))
                kinds = np.zeros(len(context))
                at = np.searchsorted(context, gram >> np.uint64(16))
                np.add.at(total, at, count)
                np.add.at(kinds, at, 1)
                seen = total > 0
                back[seen, j] = discount * kinds[seen] / total[seen]
                own = np.zeros(len(keys[k - 1]))
                own[np.searchsorted(keys[k - 1], gram)] = np.maximum(count - discount, 0) / total[at]
                suffix = keys[k - 1] & np.uint64((1 << 16 * (k - 1)) - 1)
                lower = 1 / alphabet if k == 1 else below[x][np.searchsorted(keys[k - 2], suffix)]
                prob[:, j] = own + back[np.searchsorted(context, keys[k - 1] >> np.uint64(16)), j] * lower
                below[x] = prob[:, j]
            self.prob.append(Hashed(keys[k - 1], np.log(np.maximum(prob, 1e-12))))
            self.back.append(Hashed(context, np.log(back)))
        self.floor = np.full(len(self.languages), -np.log(alphabet), np.float32)

    @staticmethod
    def _types(packed: np.ndarray, k: int) -> np.ndarray:
        return np.unique(packed & np.uint64((1 << 16 * k) - 1)) if k < 4 else packed

    @classmethod
    def _counted(cls, packed: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """k-grams with their counts: as seen at the highest order, of different left neighbours below it."""
        if k == ORDER:
            return packed, count
        longer = cls._types(packed, k + 1)
        return np.unique(longer & np.uint64((1 << 16 * k) - 1), return_counts=True)

    def log_probs(self, packed: np.ndarray) -> np.ndarray:
        """(len(packed), languages): interpolated where the 4-gram was seen by any language, else backed off."""
        out, found = self.prob[-1].get(packed)
        missing = np.flatnonzero(~found)
        if len(missing):
            rest = packed[missing]
            value = np.zeros((len(rest), len(self.languages)), np.float32)
            left = np.arange(len(rest))
            for k in range(ORDER, 0, -1):
                back, known = self.back[k - 1].get(rest[left] >> np.uint64(16))
                value[left[known]] += back[known]
                if k == 1:
                    value[left] += self.floor
                    break
                rest[left] &= np.uint64((1 << 16 * (k - 1)) - 1)
                lower, hit = self.prob[k - 2].get(rest[left])
                value[left[hit]] += lower[hit]
                left = left[~hit]
                if not len(left):
                    break
            out[missing] = value
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in every language, and the number of letters."""
        packed, first, letters = grams(texts)
        if not len(texts):
            return np.zeros((0, len(self.languages))), letters
        total = np.add.reduceat(self.log_probs(packed), first[:-1], axis=0, dtype=np.float64)
        return -total / np.diff(first)[:, None], letters


class Hashed:
    """Rows by the sorted hashes of their keys, with a directory of the hashes' leading bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = common.mix(keys)
        order = np.argsort(h)
        self.hash, self.rows = h[order], rows[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, (4 * len(h)).bit_length()))
        self.directory = np.searchsorted(self.hash, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, found): rows of keys that aren't found are of no use."""
        if not len(self.hash):
            return np.zeros((len(keys), self.rows.shape[1]), np.float32), np.zeros(len(keys), bool)
        h = common.mix(keys)
        last = len(self.hash) - 1
        at = np.minimum(self.directory[h >> self.shift], last)
        behind = np.flatnonzero((self.hash[at] < h) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.hash[at[behind]] < h[behind]) & (at[behind] < last)]
        return self.rows[at], self.hash[at] == h


class Parts:
    """Broadcast `Hashed` parts of one array; a key is in the part of its hash modulo their number."""

    held = 0

    def __init__(self, parts: list, width: int):
        self.parts, self.width = parts, width

    @staticmethod
    def part_of(keys: np.ndarray, n: int) -> np.ndarray:
        return (common.mix(keys) & np.uint64(0xFFFFFF)) % np.uint64(n)

    @classmethod
    def _load(cls, part) -> Hashed:
        new = not hasattr(part, "_value")
        table = part.value
        if new:
            size = table.rows.nbytes + table.hash.nbytes + table.directory.nbytes
            if cls.held + size > HELD_BYTES:
                del part._value
            else:
                cls.held += size
        return table

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self._load(self.parts[0]).get(keys)
        rows, found = np.zeros((len(keys), self.width), np.float32), np.zeros(len(keys), bool)
        of = self.part_of(keys, len(self.parts))
        for k, part in enumerate(self.parts):
            if len(at := np.flatnonzero(of == k)):
                rows[at], found[at] = self._load(part).get(keys[at])
        return rows, found


class BroadcastModel(Model):
    """A Model whose arrays are broadcast in parts; it goes to the tasks in their closures."""

    def __init__(self, languages: list[str], prob: list[Parts], back: list[Parts], alphabet: int):
        self.languages, self.prob, self.back = languages, prob, back
        self.floor = np.full(len(languages), -np.log(alphabet), np.float32)


def _parts(table: DataFrame, width: int, part_bytes: int) -> Parts:
    """The logarithms of the rows (`key`, `value` of `width` doubles), each part collected and broadcast on its own."""
    spark = table.sparkSession
    n = max(1, -(-table.count() * 4 * width // part_bytes))
    ddl = "part int, key long, row binary"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            rows = np.log(np.maximum(batch.column(1).flatten().to_numpy(), 1e-12)).astype("<f4")
            ends = pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * (4 * width))
            part = Parts.part_of(keys.view(np.uint64), n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys), pa.Array.from_buffers(pa.binary(), len(keys), [None, ends, pa.py_buffer(rows.tobytes())])], schema=schema)

    path = common.shared_dir(spark, "parts")
    table.select("key", "value").mapInArrow(run, ddl).write.partitionBy("part").parquet(path)
    stored = spark.read.schema("key long, row binary, part int").parquet(path)
    out = []
    for k in range(n):
        own = stored.where(F.col("part") == k).select("key", "row").toArrow()
        rows = np.frombuffer(b"".join(own.column(1).to_pylist()), "<f4").reshape(-1, width)
        out.append(spark.sparkContext.broadcast(Hashed(own.column(0).to_numpy().view(np.uint64), rows)))
    return Parts(out, width)


def build(counts: DataFrame, part_bytes: int = PART_BYTES) -> Model:
    """Model(counts) of a stored table lang, gram, n, with Spark: the driver holds one part at a time."""
    spark = counts.sparkSession
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        tables[k] = common.store(tables[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), f"grams{k}")
    tally = functools.reduce(DataFrame.unionAll, [t.select(F.lit(k).alias("k"), "lang", "n") for k, t in tables.items()])
    tally = tally.groupBy("k", "lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()
    languages = sorted({x["lang"] for x in tally})
    if not languages:
        return Model({})
    discount = {(x["k"], x["lang"]): min(0.95, max(0.1, x["n1"] / (x["n1"] + 2 * x["n2"]) if x["n1"] else 0.5)) for x in tally}
    alphabet = max(2, tables[1].select("gram").distinct().count())
    width = len(languages)

    def dense(pairs: DataFrame, key: str, value: str, empty: float) -> DataFrame:
        found = pairs.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("j", value))).alias("m"))
        return found.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(empty))).alias(value))

    prob, back, below = [], [], None
    for k in range(1, ORDER + 1):
        known = spark.createDataFrame([(x, j, discount[k, x]) for j, x in enumerate(languages)], "lang string, j int, d double")
        seen = tables[k].join(F.broadcast(known), "lang").withColumn("context", F.shiftrightunsigned("gram", 16))
        total = seen.groupBy("context", "j").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("back"))
        total = common.store(total, f"totals{k}")
        backs = common.store(dense(total, "context", "back", 1.0), f"backs{k}")
        own = seen.join(total, ["context", "j"]).withColumn("own", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"))
        own = dense(own, "gram", "own", 0.0).withColumn("context", F.shiftrightunsigned("gram", 16)).join(backs, "context")
        if k == 1:
            own = own.withColumn("lower", F.array_repeat(F.lit(1 / alphabet), width))
        else:
            own = own.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)))
            own = own.join(below.select(F.col("key").alias("shorter"), F.col("value").alias("lower")), "shorter")
        rest = F.zip_with("back", "lower", lambda a, b: a * b)
        below = common.store(own.select(F.col("gram").alias("key"), F.zip_with("own", rest, lambda a, b: a + b).alias("value")), f"probs{k}")
        prob.append(_parts(below, width, part_bytes))
        back.append(_parts(backs.select(F.col("context").alias("key"), F.col("back").alias("value")), width, part_bytes))
    return BroadcastModel(languages, prob, back, alphabet)


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", part_bytes: int = PART_BYTES) -> Model:
    """Count the 4-grams of every training row (not held out, with a text and a language) and build the models."""
    slim = common.short_batches(df).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    ddl = "lang string, gram long, n long"
    schema = common.arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(x: str) -> tuple[np.ndarray, np.ndarray]:
            gram, n = (np.concatenate(p) for p in zip(*held[x]))
            order = np.argsort(gram)
            gram, n = gram[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            return gram[first], np.add.reduceat(n, first)

        def rows(x: str) -> pa.RecordBatch:
            gram, n = merged(x)
            return pa.RecordBatch.from_arrays([pa.array([x] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], schema=schema)

        for ids, langs, texts in common.by_bytes(batches):
            by: dict[str, list[str]] = {}
            for d, x, t in zip(ids, langs, texts):
                if not held_out(d):
                    by.setdefault(x, []).append(t.decode("utf-8", "replace"))
            for x, part in by.items():
                held.setdefault(x, []).append(np.unique(grams(part)[0], return_counts=True))
                if len(held[x]) >= 32:
                    held[x] = [merged(x)]
                    if len(held[x][0][0]) > 1 << 20:
                        yield rows(x)
                        del held[x]
        for x in list(held):
            yield rows(x)

    counts = common.store(slim.mapInArrow(count, ddl).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return build(counts, part_bytes)


def quantile(values: np.ndarray, times: np.ndarray, q: float) -> float:
    """np.quantile of values that occur some times each."""
    order = np.argsort(values)
    upto = np.cumsum(times[order])
    place = q * (upto[-1] - 1)
    below = math.floor(place)
    a, b = (values[order][np.searchsorted(upto, min(k, upto[-1] - 1), side="right")] for k in (below, below + 1))
    return float(a + (b - a) * (place - below))


class Calibration:
    """Accepts a cross-entropy up to `bound[language]` + spread[language] * sqrt(30 / letters).

    A language with few long rows takes the bound of the long rows of all languages together (where these are few too, of
    all rows), raised to what its own rows have; without any rows the bound is `limit`. So every bound is finite.
    """

    def __init__(self, languages: list[str], rows: list[tuple], limit: float = ORDER * 16 * math.log(2)):
        """rows: predicted language, cross-entropy, letters and, if not 1, how many such rows there are; limit: nats per
        character that no text of a language has."""
        self.bound = dict.fromkeys(languages, limit)
        self.spread = dict.fromkeys(languages, 0.0)
        own = {x: ([], []) for x in languages}
        for x, v, n, *times in rows:
            if x in own and n > 0:
                own[x][n < LONG].append((v, n, *times, 1)[:3])
        long = [row for few, _ in own.values() for row in few]
        pool = long if sum(k for *_, k in long) >= LEAST_LONG else [row for kind in own.values() for part in kind for row in part]
        pooled, middle = self._fitted(pool) if pool else (limit, 0.0)
        for x, (few, short) in own.items():
            if sum(k for *_, k in few) >= LEAST_LONG:
                self.bound[x], self.spread[x] = self._fitted(few)
            else:
                over = [(v - middle * (30 / n) ** 0.5, k) for v, n, k in few + short]
                raised = quantile(*np.array(over).T, 0.995) + 0.25 if over else 0.0
                self.bound[x], self.spread[x] = min(limit, max(pooled, raised)), middle

    @staticmethod
    def _fitted(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
        e, _, times = np.array(rows).T
        middle = quantile(e, times, 0.5)
        deviation = 1.4826 * quantile(np.abs(e - middle), times, 0.5)
        return max(quantile(e, times, 0.995), middle + 6 * deviation) + 0.25, middle

    def accepts(self, language: str, entropy: float, letters: int) -> bool:
        return letters > 0 and entropy <= self.bound[language] + self.spread[language] * (30 / letters) ** 0.5


class Identifier:
    def __init__(self, model: Model, calibration: Calibration | None = None):
        self.model, self.calibration = model, calibration

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cross-entropy, letters, accepted) of each text."""
        out = [(UNKNOWN, 0.0, None, 0, False)] * len(texts)
        if not self.model.languages:
            return out
        entropy, letters = self.model.entropies([t.decode("utf-8", "replace") for t in texts])
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(letters, 40)[:, None]
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        for i, j in enumerate(best.tolist()):
            if letters[i]:
                x, e = self.model.languages[j], float(entropy[i, j])
                out[i] = x, float(score[i]), e, int(letters[i]), self.calibration is None or self.calibration.accepts(x, e, int(letters[i]))
        return out


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int | None = None) -> Identifier:
    """Models and rejection bounds of all training rows; rows: bounds of about that many, chosen by a hash in each language."""
    model = fit(df, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model.languages:
        return Identifier(model, Calibration([], []))
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if rows:
        known = calibration_rows(df, max(LEAST_SHARE, rows // len(model.languages)), id_col, text_col, lang_col)
    scored = _scored(_training(known, id_col), Identifier(model), id_col, text_col).where("letters > 0").select("lang_pred", "entropy", "letters")
    return Identifier(model, Calibration(model.languages, _counted(common.store(scored, "entropies")), -float(model.floor[0])))


def _training(df: DataFrame, id_col: str) -> DataFrame:
    """The rows that are not held out."""
    crc = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    return df.where(F.coalesce(crc % 4 != 2, F.lit(True)))


def _counted(scored: DataFrame) -> list[tuple[str, float, int, int]]:
    """Rows of a Calibration from all of (lang_pred, entropy, letters): as many as there are steps of cross-entropy, not rows.

    Long rows count by language and step; where a language has few of them, all its rows count by their letters too.
    """
    step = scored.withColumn("step", F.round(F.col("entropy") * STEPS).cast("long"))
    long = step.where(F.col("letters") >= LONG).groupBy("lang_pred", "step").agg(F.count("*").alias("n")).collect()
    held: dict[str, int] = {}
    for x in long:
        held[x["lang_pred"]] = held.get(x["lang_pred"], 0) + x["n"]
    own = [x for x, n in held.items() if n >= LEAST_LONG]
    rest = step.where(~F.col("lang_pred").isin(own)) if own else step
    few = rest.groupBy("lang_pred", "step", "letters").agg(F.count("*").alias("n")).collect()
    return [(x["lang_pred"], x["step"] / STEPS, LONG, x["n"]) for x in long if held[x["lang_pred"]] >= LEAST_LONG] + [(x["lang_pred"], x["step"] / STEPS, x["letters"], x["n"]) for x in few]


def calibration_rows(df: DataFrame, share: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """About `share` of the long rows and about `share` of the short rows of each language (all where there are fewer)."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), (F.char_length(F.col(text_col)) >= LONG).alias("_long"))
    rate = known.groupBy("_lang", "_long").agg((F.lit(float(share << 40)) / F.count("*")).alias("_rate"))
    kept = known.join(F.broadcast(rate), ["_lang", "_long"]).where(F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 40)) < F.col("_rate"))
    return kept.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.col("_lang").alias(lang_col))


SCORED = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, letters long, accepted boolean"


def _scored(df: DataFrame, identifier: Identifier, id_col: str, text_col: str) -> DataFrame:
    schema = common.arrow_schema(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.by_bytes(batches):
            yield common.record_batch([(d, held_out(d), *found) for d, found in zip(ids, identifier.predict(texts))], schema)

    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, SCORED)


def identify(df: DataFrame, identifier: Identifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and accepted for each row.

    lang_pred is `und`, with score 0 and not accepted, for a null text, one without letters, and where no language was
    learned; equal cross-entropies go to the first language by name. Repeated rows stay repeated, a null doc_id stays null
    and is not held out, other columns are not read, and an empty table gives no rows.
    """
    return _scored(df, identifier, id_col, text_col).drop("letters")


def keep_accepted(df: DataFrame, identifier: Identifier, *, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text is accepted as one of the languages."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [r[4] for [texts] in common.by_bytes([batch.select([at])]) for r in identifier.predict(texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.short_batches(df).mapInArrow(run, df.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, train(docs))
