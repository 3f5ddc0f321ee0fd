"""Counts of words, lines and repeats of texts, shared by the quality operators."""

from __future__ import annotations

import numpy as np

from . import common

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def per_text(words: common.Words, mask: np.ndarray) -> np.ndarray:
    """How often the mask over the batch's bytes is set in each text."""
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[words.text_end] - total[words.text_start]


def per_text_words(words: common.Words, mask: np.ndarray) -> np.ndarray:
    """How often the mask over the batch's words is set in each text."""
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[words.first[1:]] - total[words.first[:-1]]


def repeated(words: common.Words, hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A mask of the words in windows of `size` words that their text has twice or more, the first included."""
    at, h = words.windows(size, hashes)
    h = h ^ common.mix(words.text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return common.covered(at[again], size, len(hashes))


def distinct_words(words: common.Words) -> np.ndarray:
    """Different words of each text."""
    h = np.sort(words.hashes() & np.uint64((1 << 40) - 1) | words.text.astype(np.uint64) << np.uint64(40))
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return np.bincount((h[new] >> np.uint64(40)).astype(np.int64), minlength=len(words.count))


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def basics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each text."""
    words = common.Words(texts)
    lead = (words.bytes & 0xC0) != 0x80
    lines = np.array([duplicate_lines(t) for t in texts], np.int64).reshape(-1, 2)
    return {
        "n_words": words.count,
        "word_chars": per_text(words, lead & ~common._SPACE[words.bytes]),
        "n_symbols": per_text(words, _SYMBOL[words.bytes]),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": per_text_words(words, repeated(words, words.hashes())),
    }
