"""Counts over whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from .common import windows, word_hashes

#: ASCII white space, and the characters that count as symbols.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words inside of windows of `width` words that the text has twice or more, the first one included."""
    found = windows(hashes, width)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k : k + len(found)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    full = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(full) - len(set(full))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def base_counts(text: str | None, hashed: tuple[list[bytes], np.ndarray] | None = None) -> tuple[list[bytes], np.ndarray, int, int, int, int]:
    """Words, their hashes (both taken from `hashed` if known), code points in words, symbols, repeated lines, words in repeated windows."""
    if not text:
        return [], np.empty(0, np.uint64), 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = hashed[0] if hashed else raw.split()
    hashes = hashed[1] if hashed else word_hashes(words)
    chars = len(text) - sum(raw.count(x) for x in SPACES)
    return words, hashes, chars, sum(raw.count(x) for x in SYMBOLS), repeated_lines(text), repeated_words(hashes)
