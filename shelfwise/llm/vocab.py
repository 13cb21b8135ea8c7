"""Public tokenizers, cached by chunk inside the workers.

A text is cut before every single space that stands between two characters that aren't white space (`space_chunks`). No token of
the vocabularies used here reaches over such a place, so chunks are encoded apart and repeated chunks once.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from .common import CACHE_ENTRIES, worker_cache

_OPEN: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hf_tokenizer(path: str, plain: bool = False):
    """plain: special tokens' strings inside texts are plain text."""
    if (path, plain) not in _OPEN:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = plain
        _OPEN[path, plain] = found
    return _OPEN[path, plain]


def rank_encoding(path: str):
    """A tiktoken encoding of a file of ranks, without special tokens."""
    if path not in _OPEN:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _OPEN[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path]


def piece_model(path: str):
    if path not in _OPEN:
        import sentencepiece

        _OPEN[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _OPEN[path]


_CUT = re.compile(r"(?<=\S)(?= \S)")


def space_chunks(text: str) -> list[str]:
    """The text in chunks; all but the first begin with a space and a character that isn't white space."""
    parts = text.split(" ")
    # the quick way holds where no piece is empty or has other white space at either end
    if all(parts) and not any(p[0].isspace() or p[-1].isspace() for p in parts):
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else parts
    return _CUT.split(text)


class ByteBpe(dict):
    """Cache: chunk -> its ids as little-endian unsigned 32-bit bytes, as the tokenizers library has them.

    Plain chunks (characters below U+0250, no special token's text) go through the equal rank table, which is several times
    faster; all others through the library itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.full = hf_tokenizer(json_path)
        self.fast = rank_encoding(ranks_path)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if "<|" in chunk or (not chunk.isascii() and max(chunk) >= "ɐ"):
            ids = self.full.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(chunk)
        value = np.array(ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = value
        return value


def byte_bpe(json_path: str, ranks_path: str) -> ByteBpe:
    return worker_cache(("byte_bpe", json_path, ranks_path), lambda: ByteBpe(json_path, ranks_path))
