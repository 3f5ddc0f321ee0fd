"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. The distinct vote patterns of all texts, at most 3 to the
number of labellers, are counted with Spark, and expectation-maximisation over the counts estimates each labeller's
accuracy and, from them, the posterior of each pattern. The posteriors are the labels of a linear scorer over hashed words
and word shapes, fitted on a bounded sample of rows that a hash of the id chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textstats

#: Rows, about, on which the scorer is fitted.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 17
LABELLERS = ("capitals", "exclamation", "symbols", "marks", "length", "dup_lines", "repeats", "variety", "word_length", "digits", "letters", "line_ends")

_UPPER, _LOWER, _DIGIT, _END, _SHOUT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_END[[*b".!?:;\"')"]] = True
_SHOUT[33] = True
#: A letter for each class of byte: A, a, 0, u (not ASCII) or the byte itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 117


def votes(texts: list[bytes], words: common.Words) -> np.ndarray:
    """(texts, LABELLERS): 1 good, -1 bad, 0 abstains."""
    b, n = words.bytes, np.maximum(words.count, 1)
    upper, lower, digit = (textstats.per_text(words, m[b]) for m in (_UPPER, _LOWER, _DIGIT))
    other = textstats.per_text(words, (b & 0xC0) == 0xC0)
    chars = np.maximum(textstats.per_text(words, ((b & 0xC0) != 0x80) & ~common._SPACE[b]), 1)
    symbols = textstats.per_text(words, textstats._SYMBOL[b]) / chars
    shout = textstats.per_text(words, _SHOUT[b]) / n
    lines = np.array([textstats.duplicate_lines(t) for t in texts], np.int64).reshape(-1, 2)
    dup = lines[:, 1] / np.maximum(lines[:, 0], 1)
    again = textstats.per_text_words(words, textstats.repeated(words, words.hashes())) / n
    variety = textstats.distinct_words(words) / n
    mean = chars / n
    last = b[words.end - 1] if len(words.end) else b[:0]
    marks = textstats.per_text_words(words, textstats._SYMBOL[last]) / n
    newline = np.flatnonzero(b == 10)
    before = b[newline - 1] if len(newline) else b[:0]
    ended = np.zeros(len(b), bool)
    ended[newline[_END[before] & (newline > 0)]] = True
    breaks = textstats.per_text(words, b == 10)
    ends = textstats.per_text(words, ended) / np.maximum(breaks, 1)
    capital = upper / np.maximum(upper + lower, 1)
    never = np.zeros(len(texts), bool)
    cases = (
        (never, capital > 0.5),
        (never, shout > 0.2),
        (never, symbols > 0.02),
        (never, marks > 0.15),
        (words.count >= 50, words.count < 10),
        (never, dup > 0.3),
        (never, again > 0.2),
        (never, (words.count >= 30) & (variety < np.minimum(0.35, 60 / np.sqrt(n) / 10))),
        (never, (mean < 2.5) | (mean > 14)),
        (never, digit / chars > 0.15),
        ((upper + lower + other) / chars > 0.9, (upper + lower + other) / chars < 0.75),
        ((breaks > 0) & (ends > 0.8), (breaks > 1) & (ends < 0.2)),
    )
    return np.stack([np.where(bad, -1, np.where(good, 1, 0)) for good, bad in cases], axis=1).astype(np.int8)


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ 3 ** np.arange(len(LABELLERS))


class WeakLabels:
    """For each labeller the chance of each vote on good and on bad texts, and the prior, by expectation-maximisation.

    It starts from texts with and without a bad vote; `accuracy` is the chance that a vote is right.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
        bad = (v < 0).sum(axis=1)
        good = np.where(bad > 0, 0.1, 0.95)
        for _ in range(rounds):
            self._maximise(v, counts, good)
            new = self._posterior(v)
            done = np.abs(new - good).max(initial=0) < 1e-9
            good = new
            if done:
                break
        right = (good[:, None] * (v > 0) + (1 - good)[:, None] * (v < 0)) * counts[:, None]
        self.accuracy = (right.sum(axis=0) + 1) / (((v != 0) * counts[:, None]).sum(axis=0) + 2)

    def _maximise(self, v: np.ndarray, counts: np.ndarray, good: np.ndarray) -> None:
        total = counts.sum()
        self.prior = float(np.clip((good @ counts + 8) / (total + 10), 0.5, 0.98))
        table = np.empty((2, len(LABELLERS), 3))
        for k, part in enumerate((good * counts, (1 - good) * counts)):
            for vote in (-1, 0, 1):
                table[k, :, vote + 1] = (v == vote).T @ part + 0.5
        self.table = np.log(table / table.sum(axis=2, keepdims=True))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        each = (self.table[0] - self.table[1])[np.arange(len(LABELLERS)), v + 1]
        # a labeller's vote may only speak for its own side, and abstaining only for the other
        each = np.where(v < 0, np.minimum(each, 0), np.where(v > 0, np.maximum(each, 0), each))
        odds = np.log(self.prior / (1 - self.prior)) + each.sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return self._posterior(v.astype(np.int64))


N_FEATURES = 4


def features(words: common.Words, buckets: int = BUCKETS) -> np.ndarray:
    """(words, N_FEATURES) hashed: the word, the shapes of its first and last four bytes, and how repetitive it and its text are."""
    shapes = common.prefix_hash(_SHAPE[words.bytes])
    head = common.span_hash(shapes, words.start, np.minimum(words.end, words.start + 4))
    tail = common.span_hash(shapes, np.maximum(words.start, words.end - 4), words.end)
    own = words.hashes()
    echo = np.zeros(len(own), np.uint64)
    for lag in (3, 2, 1):
        echo[lag:][(own[lag:] == own[:-lag]) & (words.text[lag:] == words.text[:-lag])] = lag
    variety = (10 * textstats.distinct_words(words) / np.maximum(words.count, 1)).astype(np.uint64)
    repeat = common.mix(np.repeat(variety, words.count) * np.uint64(8) + echo + np.uint64(1))
    return np.stack([h >> np.uint64(20) for h in (own, head ^ np.uint64(0x5555 << 40), tail ^ np.uint64(0x3333 << 40), repeat ^ np.uint64(0x6666 << 40))], axis=1).astype(np.int64) % buckets


class Scorer:
    """Logistic regression over the mean of hashed features."""

    def __init__(self, buckets: int = BUCKETS):
        self.weight, self.bias = np.zeros(buckets), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 200, rate: float = 1.0, decay: float = 1e-6) -> Scorer:
        """rows: (buckets, shares, label) of each text; full-batch AdaGrad."""
        if not rows:
            return self
        index, share = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        size = np.array([len(r[0]) for r in rows])
        label, doc = np.array([r[2] for r in rows]), np.repeat(np.arange(len(rows)), size)
        squares, bias_squares = np.full(len(self.weight), 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(doc, share * self.weight[index], len(rows)) + self.bias
            error = (1 / (1 + np.exp(-z)) - label) / len(rows)
            gradient = np.bincount(index, share * error[doc], len(self.weight)) + decay * self.weight
            squares += gradient**2
            bias_squares += error.sum() ** 2
            self.weight -= rate * gradient / np.sqrt(squares)
            self.bias -= rate * error.sum() / np.sqrt(bias_squares)
        return self

    def score(self, words: common.Words) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weight[features(words, len(self.weight))].sum(axis=1))))
        z = self.bias + (total[words.first[1:]] - total[words.first[:-1]]) / (N_FEATURES * np.maximum(words.count, 1))
        return 1 / (1 + np.exp(-z))


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[WeakLabels, Scorer]:
    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    one = common.arrow_schema("pattern long")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.by_bytes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_pattern(votes(texts, common.Words(texts))))], schema=one)

    tally = slim.mapInArrow(vote, "pattern long").groupBy("pattern").count().orderBy("pattern").toPandas()
    labels = WeakLabels(tally["pattern"].to_numpy(np.int64), tally["count"].to_numpy(np.int64))
    share = min(1.0, sample_rows / max(1, int(tally["count"].sum())))
    ddl = "bucket binary, share binary, label double"
    schema = common.arrow_schema(ddl)

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.by_bytes(batches):
            words = common.Words(texts)
            label = labels.posterior(votes(texts, words))
            f = features(words)
            rows = []
            for i in range(len(texts)):
                bucket, n = np.unique(f[words.first[i] : words.first[i + 1]], return_counts=True)
                rows.append((bucket.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes(), float(label[i])))
            yield common.record_batch(rows, schema)

    picked = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).mapInArrow(example, ddl)
    rows = [(np.frombuffer(r[0], "<i4"), np.frombuffer(r[1], "<f4"), r[2]) for r in picked.toLocalIterator()]
    return labels, Scorer().fit(rows)


def classify(df: DataFrame, model: tuple[WeakLabels, Scorer], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), kept, weak_label (the votes' posterior) of each row.

    A null or empty text has no words: its score is the scorer's constant, and it is not kept. Repeated rows stay repeated,
    a null doc_id stays null, other columns are not read, and an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, score double, kept boolean, weak_label double"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        for ids, texts in common.by_bytes(batches):
            words = common.Words(texts)
            score = scorer.score(words)
            kept = (score >= threshold) & (words.count > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score), pa.array(kept), pa.array(labels.posterior(votes(texts, words)))], schema=schema)

    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, ddl)


def op10_weak_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classify(docs, train(docs))
