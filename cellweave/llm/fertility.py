"""Quality rules from tokeniser fertility.

Two public vocabularies read every text: a byte-level one gives characters per token and the entropy of its tokens, one
with byte fallback gives the share of tokens that are single bytes. For each language, or the script of its letters where
the language is unknown, the quartiles over all texts give a band for each measure, and texts far outside one are rejected.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textstats, tokens

MEASURES = ("chars_per_token", "fallback_chars_per_token", "byte_share", "token_entropy")
#: Interquartile ranges beyond a quartile at which a band ends, for long texts.
REACH = 4.0
#: The least interquartile range that a band is built on.
LEAST_RANGE = {"chars_per_token": 0.08, "fallback_chars_per_token": 0.08, "byte_share": 0.01, "token_entropy": 0.01}
#: Tokens of a window whose entropy is taken, at least (a shorter text is one window).
WINDOW = 64
#: Tokens at which a band is wider by the square root of 2, as short texts scatter more.
SCATTER = 100
#: Languages and scripts up to which the bands are sent to all tasks.
MOST_BROADCAST = 10_000
#: Rows of a language or script at which its bands are wider by the square root of 2, as quartiles of few rows scatter more.
FEW_ROWS = 20


@functools.lru_cache(maxsize=4)
def _byte_ids(path: str) -> np.ndarray:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())])


@functools.lru_cache(maxsize=1 << 16)
def _script_of(letter: str) -> str:
    return unicodedata.name(letter, "UNNAMED").split()[0].lower()


def script(text: str) -> str:
    """The script of most of the letters, by their Unicode names; `none` without letters."""
    names: dict[str, int] = {}
    for c, n in Counter(text).items():
        if c.isalpha():
            name = _script_of(c)
            names[name] = names.get(name, 0) + n
    return max(sorted(names), key=names.get) if names else "none"


def window_entropy(ids: np.ndarray) -> float:
    """Entropy of the tokens in a window as a share of its most, on average over all tokens of a text of two or more.

    The text is cut into as many windows of nearly equal length as WINDOW goes into it, so every token is in one.
    """
    n = len(ids)
    edge = np.arange(max(1, n // WINDOW) + 1) * n // max(1, n // WINDOW)
    size = np.diff(edge)
    keys = np.sort((np.repeat(np.arange(len(size)), size) << 32) + ids)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, n))
    spent = np.bincount(keys[first] >> 32, counts * np.log2(counts), len(size)) / size
    return float(((1 - spent / np.log2(size)) * size).sum() / n)


def measures(text: str, bpe_path: str, piece_path: str) -> tuple[int, float, float, float, float]:
    """Tokens and MEASURES; without two tokens and a piece there are none."""
    ids = np.array(tokens.encoder(bpe_path)(text), np.int64)
    pieces = np.array(tokens.encoder(piece_path)(text), np.int64)
    if len(ids) < 2 or not len(pieces):
        return len(ids), None, None, None, None
    return len(ids), len(text) / len(ids), len(text) / len(pieces), float(_byte_ids(piece_path)[pieces].mean()), window_entropy(ids)


DDL = "doc_id long, kind string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_chars_per_token double, byte_share double, token_entropy double"


def _band(m: str) -> Column:
    low, _, high = (F.col(f"{m}_q")[k] for k in range(3))
    reach = REACH * F.greatest(high - low, F.lit(LEAST_RANGE[m])) * F.sqrt((1 + SCATTER / F.greatest(F.col("n_tokens"), F.lit(1))) * (1 + FEW_ROWS / F.col("rows")))
    return F.col(m).isNull() | F.col(f"{m}_q").isNull() | F.col(m).between(low - reach, high + reach)


def quality(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """Base counts, base_failed, kept and the measures of each row.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept is false for those and for
    rows outside a band. A null or empty text has counts of 0 and so fails; a null language is replaced by the text's
    script; every kind has bands of its own rows, and a text without measures is inside them. Repeated rows stay repeated and weigh in the quartiles, a null
    doc_id stays null, other columns are not read, and an empty table gives no rows.
    """
    bpe, pieces = bpe or tokens.vocabulary("byte_bpe_50k.tiktoken"), pieces or tokens.vocabulary("piece_bpe_32k.model")
    schema = common.arrow_schema(DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, langs, texts in common.by_bytes(batches):
            base = textstats.basics(texts)
            columns = [base[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            plain = [t.decode("utf-8", "replace") for t in texts]
            kinds = [x or script(t) for x, t in zip(langs, plain)]
            yield common.record_batch([(*row, *measures(t, bpe, pieces)) for *row, t in zip(ids, kinds, *columns, plain)], schema)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    slim = common.short_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).cast("binary").alias("text"))
    measured = common.store(slim.mapInArrow(run, DDL), "fertility")
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(f"{m}_q") for m in MEASURES]
    bands = measured.where("n_tokens > 1").groupBy("kind").agg(F.count("*").alias("rows"), *quartiles)
    bands = common.store(bands, "bands")
    if bands.count() <= MOST_BROADCAST:
        bands = F.broadcast(bands)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = functools.reduce(Column.__and__, map(_band, MEASURES))
    return measured.join(bands, "kind", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"), "kind", "n_tokens", *MEASURES)


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))
