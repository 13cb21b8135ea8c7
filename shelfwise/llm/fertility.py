"""Quality rules on tokeniser fertility: what public vocabularies make of a text's words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, SLICE_ROWS, table, worker_cache
from .textstats import base_counts, words_of
from .vocab import piece_model, rank_encoding, tokenizer_path

#: Scripts by ranges of code points; a text's script is the one with most of its letters outside of ASCII if those are at least a
#: fifth of its word characters, else latin.
SCRIPTS = {
    "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ",
    "indic": "ऀ-෿", "thai": "฀-๿", "hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿",
}
#: Closed-class words by which a text in Latin letters is taken for one of these languages; "latin" without any.
CLOSED = {
    "en": "the and of to in is that it for on with as are this was be at by or from not an have which",
    "es": "el los las y en un una del que se por con para como su al lo más pero es son fue sobre entre",
    "fr": "le les et des une du dans qui pour sur au aux avec ce est pas par plus sont cette ou mais nous vous",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch an werden aus er",
}
#: By language or script: least and most characters a token, for the piece vocabulary and for the multilingual byte vocabulary; most
#: share of byte-fallback tokens; least relative entropy of the tokens. The least values of the four languages are the 0.1 % quantiles
#: of documents with quality 1 (not held out) less 2 %, those of the others are set wide.
BANDS = {
    "en": (1.92, 9.0, 2.02, 9.0, 0.05, 0.60), "es": (1.77, 9.0, 1.88, 9.0, 0.05, 0.59), "fr": (1.69, 9.0, 1.83, 9.0, 0.05, 0.58), "de": (2.03, 9.0, 2.12, 9.0, 0.05, 0.58),
    "latin": (1.5, 9.0, 1.5, 9.0, 0.10, 0.40), "greek": (0.6, 6.0, 0.6, 6.0, 0.30, 0.35), "cyrillic": (1.0, 8.0, 1.0, 8.0, 0.15, 0.35),
    "other": (0.3, 6.0, 0.3, 6.0, 0.75, 0.3),
}
#: Tokens from which on a text is expected to hold no more entropy.
SATURATED = 2048
_VOTES = {w.encode(): k for k, (_, words) in enumerate(CLOSED.items(), 1) for w in words.split()}
_RUNS = {name: re.compile(f"[{span}]") for name, span in SCRIPTS.items()}


def script_of(text: str, word_chars: int) -> str:
    if text.isascii():
        return "latin"
    wide = [c for c in text if c > "ɏ"]
    if 5 * len(wide) < word_chars:
        return "latin"
    wide_text = "".join(wide)
    found = {name: len(run.findall(wide_text)) for name, run in _RUNS.items()}
    name = max(found, key=found.get)
    return name if 2 * found[name] >= len(wide) else "other"


class WordPieces(dict):
    """Cache: word in bytes -> its number in the columns of `view`; emptied by `limit` between slices of rows."""

    def __init__(self, piece_path: str, ranks_path: str):
        self.pieces, self.ranks = piece_model(piece_path), rank_encoding(ranks_path)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids, self.starts = array("H"), array("q", [0])
        self.hashes, self.tokens, self.fallbacks, self.votes = array("Q"), array("q"), array("q"), array("B")

    def limit(self) -> None:
        """Call between slices: a slice's words keep their numbers."""
        if len(self) > CACHE_ENTRIES or len(self.ids) > 16 * CACHE_ENTRIES:
            self.empty()

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def view(self) -> dict[str, np.ndarray]:
        """The columns as arrays, new words included; to be let go before the next view."""
        if self.new:
            texts = [w.decode("utf-8", "replace") for w in self.new]
            found = self.pieces.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = array("H", chain.from_iterable(found))
            self.starts.frombytes((sizes.cumsum() + self.starts[-1]).tobytes())
            self.ids.extend(flat)
            ids = np.frombuffer(flat, np.uint16)
            fallback = np.concatenate([[0], ((ids >= 3) & (ids < 259)).cumsum()])
            ends = sizes.cumsum()
            self.fallbacks.frombytes((fallback[ends] - fallback[ends - sizes]).tobytes())
            self.hashes.extend(map(xxhash.xxh64_intdigest, self.new))
            self.tokens.extend([len(x) for x in map(self.ranks.encode_ordinary, [" " + t for t in texts])])
            self.votes.extend([_VOTES.get(w.lower().strip(b".,;:!?"), 0) for w in self.new])
            self.new = []
        return {name: np.frombuffer(getattr(self, name), dtype) for name, dtype in (("ids", np.uint16), ("starts", np.int64), ("hashes", np.uint64), ("tokens", np.int64), ("fallbacks", np.int64), ("votes", np.uint8))}


def fertility(words: np.ndarray, chars: int, view: dict[str, np.ndarray]) -> tuple[float, float, float, float, str]:
    """Characters a token by either vocabulary, share of byte-fallback tokens, relative entropy of the tokens, and the language.

    words: numbers of WordPieces. The entropy in bits is relative to the most that as many tokens can have, but no more than
    SATURATED. The language is the one with most closed-class words, the first of CLOSED in a tie, "latin" without any.
    """
    first = view["starts"][words]
    sizes = view["starts"][words + 1] - first
    n = int(sizes.sum())
    if n == 0:
        return 0.0, 0.0, 0.0, 0.0, "latin"
    ids = np.sort(view["ids"][np.repeat(first - sizes.cumsum() + sizes, sizes) + np.arange(n)])
    counts = np.diff(np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [n]]))
    entropy = np.log2(n) - float((counts * np.log2(counts)).sum()) / n
    votes = np.bincount(view["votes"][words], minlength=len(CLOSED) + 1)[1:]
    language = list(CLOSED)[int(votes.argmax())] if votes.any() else "latin"
    tokens, fallbacks = int(view["tokens"][words].sum()), int(view["fallbacks"][words].sum())
    return chars / n, chars / max(1, tokens), fallbacks / n, entropy / np.log2(min(n, SATURATED)) if n > 1 else 1.0, language


def measured(texts: list[str | None], cache: WordPieces) -> Iterator[tuple[tuple, str, tuple]]:
    """For each text: base counts, script, and what `fertility` measures."""
    cache.limit()
    split = [words_of(t) for t in texts]
    numbers = [cache.numbers(w) for w in split]
    view = cache.view()
    for text, words, at in zip(texts, split, numbers):
        base = base_counts(text, (words, view["hashes"][at]))
        yield base, script_of(text or "", base[2]), fertility(at, base[2], view)


def within(bands: dict, script: str, measured: tuple[float, float, float, float, str]) -> bool:
    a, b, fallback, entropy, language = measured
    low, high, low2, high2, most_fallback, least_entropy = bands.get(language if script == "latin" else script, bands["other"])
    return low <= a <= high and low2 <= b <= high2 and fallback <= most_fallback and entropy >= least_entropy


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _cache(piece_path: str, ranks_path: str) -> WordPieces:
    return worker_cache(("fertility", piece_path, ranks_path), lambda: WordPieces(piece_path, ranks_path))


def quality_rules(documents: DataFrame, bands: dict | None = None, piece_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """A row per document: base counts, base_failed, kept; then script, both fertilities, byte-fallback share, relative entropy, language.

    A map over the documents without a shuffle; whole texts count. `kept` is false if the base rules fail (under 50 words, or over
    half of the words in repeated three-word windows), else true within the bands of the text's language, or of its script
    where that isn't Latin. Words are encoded apart,
    each once while a worker's bounded cache holds it.

    Null or empty text: no words, base_failed. Null ids and repeated rows keep their row; an empty table gives no rows; other
    columns are ignored.
    """
    bands = bands or BANDS
    piece_path, ranks_path = piece_path or tokenizer_path("piece_bpe_32k.model"), ranks_path or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string()), ("chars_per_piece", pa.float64()), ("chars_per_byte_token", pa.float64()), ("fallback_share", pa.float64()), ("relative_entropy", pa.float64()), ("language", pa.string())]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(piece_path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                rows = []
                for doc_id, ((words, _, *counts), script, found) in zip(batch.column(0).to_pylist(), measured(batch.column(1).to_pylist(), cache), strict=True):
                    failed = fails_base(len(words), counts[-1])
                    rows.append((doc_id, len(words), *counts, failed, not failed and within(bands, script, found), script, *found))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        measure,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_piece double, chars_per_byte_token double, fallback_share double, relative_entropy double, language string",
    )


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def keeps(bands: dict | None = None, piece_path: str | None = None, ranks_path: str | None = None):
    """The verdict `kept` as a function of a text column, for filters."""
    bands = bands or BANDS
    piece_path, ranks_path = piece_path or tokenizer_path("piece_bpe_32k.model"), ranks_path or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        cache, verdicts = _cache(piece_path, ranks_path), []
        for at in range(0, len(text), SLICE_ROWS):
            verdicts += [not fails_base(len(base[0]), base[-1]) and within(bands, script, found) for base, script, found in measured(text[at : at + SLICE_ROWS].tolist(), cache)]
        return pd.Series(verdicts, dtype=bool)

    return kept
