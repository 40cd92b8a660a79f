"""Encoders over vocabulary files that lie on every machine; their paths are parameters."""

from __future__ import annotations

import base64

import numpy as np

END_OF_TEXT = "<|endoftext|>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_file_tokenizer(path: str, pattern: str, specials: dict[str, int]):
    """A factory for executors: text -> array of ids, each worker loading the file once."""

    def build():
        key = (path, pattern)
        if key not in _LOADED:
            import tiktoken

            _LOADED[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=specials)
        encoding = _LOADED[key]

        def encode(text: str) -> np.ndarray:
            return encoding.encode_to_numpy(text, allowed_special="all")

        return encode

    return build


_LOADED: dict = {}
