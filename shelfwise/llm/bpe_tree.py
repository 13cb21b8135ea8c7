"""BPE encoding and decoding by tree concatenation.

A text is halved until its parts have at most LEAF characters, wherever the cuts fall; the parts are encoded and joined pairwise,
level by level. At a join a window of text around it is encoded again and grows until its tokens agree with those of the left and
of the right part at its ends; the tokens in between are the window's. Texts of more than PART characters are dealt out in parts
over tasks, each part a tree, and the parts' trees are joined in the same way.

No token reaches over white space, so agreement is first looked for between whole chunks. Where the chunk at the cut is longer than
LONG (unsplit text), it's looked for token by token: a token of the left part, and one of the right part, stand in the window's
tokens at the same place. In BPE a sequence is right if any two neighbours are, and every pair of neighbours comes from one of the
encodings.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import CACHE_ENTRIES, SLICE_ROWS, stored, table, worker_cache
from .vocab import hf_tokenizer, space_chunks, tokenizer_path

#: Most characters of a tree's leaf, of a part that one task encodes, of a chunk joined as a whole; and the window that a join begins
#: with, to either side.
LEAF, PART, LONG, WINDOW = 512, 1 << 15, 128, 16
#: The same for joins within a chunk.
INNER = 64
#: Characters that a token must lie away from a cut or from a window's edge to count: more than any look-ahead of the splitter.
MARGIN = 16


class Spans(dict):
    """Cache: chunk -> (ids, spans within the chunk)."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> tuple[list[int], list[tuple[int, int]]]:
        if len(self) >= CACHE_ENTRIES // 4:
            self.clear()
        plain = chunk.lstrip(" ")
        stem = plain.rstrip(".,;:!?")
        if not plain.isascii() or not stem.isalpha():
            found = self.tokenizer.encode(chunk, add_special_tokens=False)
            value = found.ids, found.offsets
        elif stem.lower() == chunk:
            tokens = self.tokenizer.model.tokenize(chunk)
            value = [t.id for t in tokens], [t.offsets for t in tokens]
        else:
            at = len(chunk) - len(plain)
            ids, spans = self[stem.lower()]
            value = ids, [(a + at, b + at) for a, b in spans]
            if len(stem) < len(plain):
                more, spans = self[plain[len(stem) :]]
                value = ids + more, value[1] + [(a + at + len(stem), b + at + len(stem)) for a, b in spans]
        if len(chunk) <= 64:
            self[chunk] = value
        return value


class Chunks(dict):
    """Cache: chunk -> (ids as text, tokens as text, count).

    A word of Latin-1 letters with closing punctuation is put together from the lower-case word and the punctuation: the tokenizer
    lowers letters, and splits between letters and other characters.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, hf_tokenizer(path)
        self.model, self.bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.names: dict[int, str] = {}
        self.spans = Spans(self.tokenizer)

    def __missing__(self, chunk: str) -> tuple[str, str, int]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        plain = chunk.lstrip(" ")
        stem = plain.rstrip(".,;:!?")
        if stem.isalpha() and stem.lower() != chunk and max(plain) < "Ā":
            value = self[stem.lower()]
            if len(stem) < len(plain):
                value = tuple(f"{a} {b}" if isinstance(a, str) else a + b for a, b in zip(value, self[plain[len(stem) :]]))
        elif stem == chunk and stem.isalpha() and max(stem) < "Ā":
            # a word in its normal form goes to the vocabulary's merges at once
            found = self.model.tokenize(stem if stem.isascii() else self.bytes.pre_tokenize_str(stem)[0][0])
            value = " ".join([str(t.id) for t in found]), " ".join([t.value for t in found]), len(found)
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            value = " ".join(map(str, ids)), self.tokens(ids), len(ids)
        if len(chunk) <= 64:
            self[chunk] = value
        return value

    def items(self, text: str) -> list[tuple[str, str, int]]:
        """One for each chunk between spaces."""
        return list(map(self.__getitem__, filter(None, text.split(" "))))

    def tokens(self, ids: list[int]) -> str:
        """What the library's decode gives for a tokenizer without a decoder: the tokens joined by spaces."""
        for k in ids:
            if k not in self.names:
                self.names[k] = self.tokenizer.id_to_token(k) or ""
        return " ".join([self.names[k] for k in ids])


def _chunks(path: str) -> Chunks:
    return worker_cache(("chunks", path), lambda: Chunks(path))


def _spans(path: str, text: str, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and (start, end) places in the whole text, of a part that begins at `start`."""
    ids, spans, cache = [], [], _chunks(path).spans
    at = start
    for chunk in space_chunks(text):
        found, places = cache[chunk]
        ids += found
        spans += [(a + at, b + at) for a, b in places]
        at += len(chunk)
    return np.array(ids, np.int64), np.array(spans, np.int64).reshape(-1, 2)


def cut_points(n: int, leaf: int) -> list[int]:
    """The ends of the parts of a text of n characters when it is halved until no part is longer than `leaf`."""
    parts = 1
    while -(-n // parts) > leaf:
        parts *= 2
    return [n * (k + 1) // parts for k in range(parts)]


def _shared(ids_a: np.ndarray, spans_a: np.ndarray, ids_b: np.ndarray, spans_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the tokens that both have with equal spans; tokens that share a span with a neighbour don't count."""

    def alone(s: np.ndarray) -> np.ndarray:
        same = np.zeros(len(s), bool)
        if len(s) > 1:
            again = (s[1:] == s[:-1]).all(1)
            same[1:] |= again
            same[:-1] |= again
        return ~same & (s[:, 1] > s[:, 0])

    places = {tuple(x): k for k, x in enumerate(np.column_stack([spans_b, ids_b]).tolist())}
    keep_a, keep_b = alone(spans_a), alone(spans_b)
    found = [(k, places[tuple(x)]) for k, x in enumerate(np.column_stack([spans_a, ids_a]).tolist()) if keep_a[k] and tuple(x) in places]
    found = [(k, j) for k, j in found if keep_b[j]]
    return np.array([k for k, _ in found], np.int64), np.array([j for _, j in found], np.int64)


def join_encodings(path: str, text: str, start: int, cut: int, end: int, left: tuple, right: tuple, window: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The encoding of text[start:end] from those of text[start:cut] and text[cut:end]."""
    reach = window
    while True:
        a, b = max(start, cut - reach), min(end, cut + reach)
        ids, spans = _spans(path, text[a:b], a)
        if (a, b) == (start, end):
            return ids, spans
        # tokens near a false edge may differ from those of the whole text
        inner_l = (spans[:, 0] >= (a + MARGIN if a > start else a)) & (spans[:, 1] <= cut - MARGIN)
        inner_r = (spans[:, 1] <= (b - MARGIN if b < end else b)) & (spans[:, 0] >= cut + MARGIN)
        near_l = np.flatnonzero(left[1][:, 0] >= a)
        near_r = np.flatnonzero(right[1][:, 1] <= b)
        k_l, w_l = _shared(left[0][near_l], left[1][near_l], ids, spans)
        k_r, w_r = _shared(right[0][near_r], right[1][near_r], ids, spans)
        ok_l, ok_r = inner_l[w_l] if len(w_l) else [], inner_r[w_r] if len(w_r) else []
        l_pairs, r_pairs = [(k, w) for k, w, ok in zip(k_l, w_l, ok_l) if ok], [(k, w) for k, w, ok in zip(k_r, w_r, ok_r) if ok]
        # whole sides: nothing of the left (right) part is outside of the window
        if a == start:
            l_pairs = l_pairs or [(-1, -1)]
        if b == end:
            r_pairs = r_pairs or [(len(near_r), len(ids))]
        if l_pairs and r_pairs:
            (k1, w1), (k2, w2) = l_pairs[0], r_pairs[-1]
            first = near_l[k1] if k1 >= 0 else 0
            last = near_r[k2] if k2 < len(near_r) else len(right[0])
            w1 = max(w1, 0)
            return np.concatenate([left[0][:first], ids[w1:w2], right[0][last:]]), np.concatenate([left[1][:first], spans[w1:w2], right[1][last:]])
        reach *= 2


def packed_spans(ids: np.ndarray, spans: np.ndarray) -> bytes:
    """Ids, distances of starts and lengths of a long chunk at a part's edge, compressed."""
    flat = np.concatenate([ids, np.diff(spans[:, 0], prepend=0), spans[:, 1] - spans[:, 0]])
    small = not len(flat) or flat.max() < 1 << 16
    return bytes([int(small)]) + zlib.compress(flat.astype("<u2" if small else "<u4").tobytes(), 1)


def unpacked_spans(packed: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    ids, steps, lengths = np.frombuffer(zlib.decompress(packed[1:]), "<u2" if packed[0] else "<u4").astype(np.int64).reshape(3, -1)
    begins = np.cumsum(steps) + start
    return ids, np.column_stack([begins, begins + lengths])


def _inner_join(cache: Chunks, text: str, a: int, cut: int, b: int, left: tuple, right: tuple) -> tuple:
    """The item of the chunk text[a:b] from those of text[a:cut] and text[cut:b], joined token by token."""
    sides = (x[3:] if len(x) > 3 else _spans(cache.path, text[s:e], s) for x, s, e in ((left, a, cut), (right, cut, b)))
    ids, spans = join_encodings(cache.path, text, a, cut, b, *sides)
    return " ".join(map(str, ids.tolist())), cache.tokens(ids.tolist()), len(ids), ids, spans


def join_items(cache: Chunks, text: str, start: int, cut: int, end: int, left: list[tuple], right: list[tuple]) -> list[tuple]:
    """The items (one for each chunk between spaces) of text[start:end] from those of text[start:cut] and text[cut:end]."""
    a, b = text.rfind(" ", start, cut) + 1 or start, text.find(" ", cut, end)
    b = end if b < 0 else b
    if b - a > LONG and a < cut < b:
        return [*left[:-1], _inner_join(cache, text, a, cut, b, left[-1], right[0]), *right[1:]]
    reach = WINDOW
    while True:
        a = text.rfind(" ", start, cut - reach) + 1 or start if cut - reach > start else start
        b = text.find(" ", cut + reach, end) if cut + reach < end else end
        b = end if b < 0 else b
        window = cache.items(text[a:b])
        n_left, n_right = (sum(map(bool, text[x:y].split(" "))) for x, y in ((a, cut), (cut, b)))
        # the first chunk of the window in the left part, the last one in the right part; neither may be one that the cut parts
        whole_left, whole_right = n_left > 1 or text[cut - 1] == " ", n_right > 1 or text[cut] == " "
        agree_left = a == start or not n_left or (whole_left and left[-n_left][0] == window[0][0])
        agree_right = b == end or not n_right or (whole_right and right[n_right - 1][0] == window[-1][0])
        if agree_left and agree_right:
            return left[: len(left) - n_left] + window + right[n_right:]
        reach *= 2


def joined_level(cache: Chunks, text: str, level: list[tuple[int, int, list[tuple]]]) -> list[tuple]:
    """The items of the whole text from those of its parts (start, end, items), whose number is a power of two, joined level by level."""
    while len(level) > 1:
        level = [(s, e, join_items(cache, text, s, m, e, x, y)) for (s, m, x), (_, e, y) in zip(level[::2], level[1::2])]
    return level[0][2]


def encode_items(cache: Chunks, text: str, leaf: int = LEAF) -> list[tuple]:
    """The items of a whole text, by its tree."""
    text = text.replace("\n", " ")  # white space is in no token
    ends = cut_points(len(text), leaf)
    return joined_level(cache, text, [(a, b, cache.items(text[a:b])) for a, b in zip([0, *ends[:-1]], ends)])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_PART = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])
_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(ids: str, tokens: str) -> tuple[str, str]:
    return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


def encode_decode(documents: DataFrame, path: str | None = None, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document's encoding and its decoding.

    Every text of more than `leaf` characters is encoded as a tree. Up to `part` characters the tree stays in the task that reads the
    text, without a shuffle. Longer texts are exploded into their parts, which are dealt out evenly and encoded in parallel; the
    parts of a text meet in one task for the upper joins, which holds one document at a time. Chunks of plain words are encoded once
    while a worker's bounded cache holds them.

    Null or empty text: no tokens, digests of the empty string. Null ids and repeated rows keep their row: long texts are told
    apart by a key of their own. An empty table gives no rows; other columns are ignored.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > part

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _chunks(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = [x for x in encode_items(cache, text, leaf) if x[2]]
                    out.append((doc_id, sum([x[2] for x in found]), *_digest(" ".join([x[0] for x in found]), " ".join([x[1] for x in found]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                ends = cut_points(len(text), part)
                for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((doc_id, pa.int64()), (key, pa.int64()), (k, pa.int32()), (a, pa.int64()), (text[a:b], pa.string()))], names=["doc_id", "key", "part", "start", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _chunks(path)
        for batch in batches:
            for *same, start, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "part", "start", "text")), strict=True):
                items = encode_items(cache, text, leaf)
                # the ids of every chunk, and the spans of a long chunk at either edge, which goes on in the next part
                ids = zlib.compress("\n".join(["", *(x[0] for x in items)]).encode(), 1)
                first, last = (packed_spans(*x[3:]) if len(x) > 3 else None for x in (items[0], items[-1])) if items else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*same, start, text, ids, first, last), _PART)], schema=_PART)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, now, doc, own = _chunks(path), None, None, []

        def items_of(start: int, ids: bytes, first: bytes | None, last: bytes | None) -> list[tuple]:
            items: list[tuple] = [(x, "", 0) for x in zlib.decompress(ids).decode().split("\n")[1:]]
            for at, packed in ((0, first), (-1, last)):
                if packed:
                    items[at] = (items[at][0], "", 0, *unpacked_spans(packed, start))
            return items

        def close() -> pa.RecordBatch:
            text = "".join(x[1] for x in own).replace("\n", " ")
            level = [(x[0], x[0] + len(x[1]), items_of(x[0], *x[2:])) for x in own]
            found = [x[0] for x in joined_level(cache, text, level) if x[0]]
            ids = list(map(int, " ".join(found).split()))
            row = (doc, len(ids), *_digest(" ".join(found), cache.tokens(ids)))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for doc_id, key, *part_row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "start", "text", "ids", "first", "last")), strict=True):
                if key != now and own:
                    yield close()
                    own.clear()
                now, doc = key, doc_id
                own.append(part_row)
        if own:
            yield close()

    # written before its keys are used: a rerun can't give a row another key
    whole = stored(rows.where(long).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    cut = whole.mapInArrow(parts, "doc_id long, key long, part int, start long, text string")
    coded = cut.repartition(F.xxhash64("key", "part")).mapInArrow(encode, "doc_id long, key long, part int, start long, text string, ids binary, first binary, last binary")
    joined = coded.repartition("key").sortWithinPartitions("key", "part").mapInArrow(join, _DDL)
    return rows.where(~long).mapInArrow(short, _DDL).unionByName(joined)


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
