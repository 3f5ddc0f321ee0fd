"""Tokenisers from public vocabulary files; a worker loads each file once."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np

#: The added token of byte_bpe_50k.
END = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=8)
def encoder(path: str, special: bool = False) -> Callable[[str], list[int]]:
    """text -> ids for a .json (tokenizers), .tiktoken or .model (sentencepiece) file.

    special: the added token END in a text is one id, as tokenizers has it by default; else it is ordinary text.
    """
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = {END: ranks.pop(END.encode(), len(ranks))} if special else {}
        encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return functools.partial(encoding.encode, allowed_special={END}) if special else encoding.encode_ordinary
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text, num_threads=1)
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def token_ids(text: str | None, path: str, end_id: int) -> np.ndarray:
    """The ids of a text (null: none) and the closing id."""
    ids = encoder(path, True)(text) if text else []
    ids.append(end_id)
    return np.array(ids, "<u4")
