"""Alignment of the tokens of two vocabularies on the same bytes, by products of sparse incidence matrices.

A text of n bytes gives each vocabulary a matrix of tokens by bytes in compressed rows. Row by row, A times the transpose of B gives
the pairs of tokens that overlap, with the bytes they share. Where tokens of both end the bytes are cut into groups; tokens by groups
is the second kind of matrix, and its product gives the pairs that share a group.

Of pairs that end together one token's bytes are a suffix of the other's. So there are at most as many such pairs of ids as both
vocabularies have bytes together, whatever the corpus: their counts are a table of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, SLICE_ROWS, stored, table, worker_cache
from .vocab import hf_tokenizer, piece_model, rank_encoding, space_chunks, tokenizer_path

#: Nonzeros that a step of a product expands, and bytes of units that are aligned in one product.
BLOCK = 1 << 20
#: Characters up to which a unit's alignment is kept in a worker's cache.
KEPT_CHARS = 64
#: Units that are encoded as one text.
JOINED = 1024
KINDS = ("overlap", "group", "end")


class Csr(NamedTuple):
    """A matrix of ones in compressed rows."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int


def byte_incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes: a token has the bytes from the end of the one before it to its own end."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(n, dtype=np.int64), n)


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Tokens by groups, which end at the cuts."""
    return Csr(np.arange(len(ends) + 1, dtype=np.int64), np.searchsorted(cuts, ends).astype(np.int64), len(cuts))


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    return Csr(np.concatenate([[0], np.bincount(m.indices, minlength=m.columns).cumsum()]).astype(np.int64), rows[order], len(m.indptr) - 1)


def _expanded(m: Csr, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the rows `at` one after another, and their number in each."""
    first, sizes = m.indptr[at], m.indptr[at + 1] - m.indptr[at]
    n = int(sizes.sum())
    return m.indices[np.repeat(first - sizes.cumsum() + sizes, sizes) + np.arange(n)], sizes


def row_products(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of a times b, for blocks of rows of a (Gustavson): each nonzero of a row of `a` adds a row of b.

    A block has rows whose products expand to about `block` terms, or one row.
    """
    terms = np.concatenate([[0], (b.indptr[a.indices + 1] - b.indptr[a.indices]).cumsum()])[a.indptr]
    first, n = 0, len(a.indptr) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(terms, terms[first] + block, side="right")) - 1)
        at = a.indices[a.indptr[first] : a.indptr[last]]
        columns, sizes = _expanded(b, at)
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(a.indptr[first : last + 1])), sizes)
        keys, values = np.unique(rows * b.columns + columns, return_counts=True)
        yield keys // max(1, b.columns), keys % max(1, b.columns), values
        first = last


def product_terms(a: Csr, b: Csr) -> np.ndarray:
    """Terms of each row of the product, without making them; they are its nonzeros where no column comes up twice in a row."""
    return np.diff(np.concatenate([[0], (b.indptr[a.indices + 1] - b.indptr[a.indices]).cumsum()])[a.indptr])


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], Csr, Csr]:
    """Cuts (bytes at which tokens of both end), overlap links (a, b, shared bytes), and the tokens of each group by vocabulary."""
    overlaps = list(row_products(byte_incidence(a_ends), transposed(byte_incidence(b_ends))))
    links = tuple(np.concatenate(x) for x in zip(*overlaps)) if overlaps else (np.empty(0, np.int64),) * 3
    a, b, _ = links
    cuts = a_ends[a[a_ends[a] == b_ends[b]]]
    return cuts, links, transposed(group_incidence(a_ends, cuts)), transposed(group_incidence(b_ends, cuts))


class Vocabularies:
    """Both tokenizers and the bytes of their tokens. A: byte-level, of a table of ranks and an equal file; B: pieces with byte fallback."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str):
        self.full, self.fast, self.pieces = hf_tokenizer(a_path, plain=True), rank_encoding(a_ranks), piece_model(b_path)
        alphabet = {c: bytes([b]) for b, c in _byte_alphabet().items()}
        by_id = sorted(self.full.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [b"".join(alphabet.get(c, c.encode()) for c in token) for token, _ in by_id]
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def encode_a(self, unit: str) -> list[int]:
        """Plain units (characters below U+0250) go through the equal table of ranks, all others through the library of the file."""
        if unit.isascii() or max(unit) < "ɐ":
            return self.fast.encode_ordinary(unit)
        return self.full.encode(unit, add_special_tokens=False).ids

    def encode(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids of a unit, which begins with the space that B adds on its own."""
        return self.encode_a(unit), self.pieces.encode(unit[1:])

    def same_bytes(self, unit: str, a: list[int], b: list[int]) -> bool:
        raw = unit.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))


def _byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in out)}


def _spelled(sizes: np.ndarray, within: str, last: str) -> tuple[np.ndarray, ...]:
    """The decimal ids of a vocabulary as strings, followed by the sign within a group and by that at its end."""
    ids = range(len(sizes))
    return tuple(np.array([f"{k}{sign}" for k in ids], object) for sign in (within, last))


class Units(dict):
    """Cache: unit -> its number in tables of alignments; a unit is a part of a text at whose ends tokens of both vocabularies end."""

    def __init__(self, vocabularies: Vocabularies, pair_type: str):
        self.v, self.pair_type = vocabularies, pair_type
        self.half = 4 * np.dtype(pair_type).itemsize
        self.a_text, self.b_text = _spelled(vocabularies.a_sizes, ",", "|"), _spelled(vocabularies.b_sizes, ",", ";")
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.new: list[str] = []
        #: a row for each unit: 1 if both vocabularies give its bytes; tokens of A and B, groups, overlap links, links within groups
        self.counts = np.zeros((1024, 6), np.int64)
        #: ids that end together, packed; the groups, each followed by a semicolon
        self.pairs: list[bytes] = []
        self.groups: list[str] = []

    def limit(self) -> None:
        """Call between slices: a slice's units keep their numbers."""
        if len(self.pairs) > CACHE_ENTRIES:
            self.empty()

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self.pairs) + len(self.new)
        self.new.append(unit)
        return at

    def settle(self) -> None:
        """Aligns the units that were new since the last call, those of about BLOCK bytes in one product; forgets the text of long ones."""
        new, self.new = self.new, []
        # units that may stand side by side in one text, since they can be cut apart again
        plain = [u[-1:].strip() != "" and u[1:2].strip() != "" for u in new]
        first, size = 0, 0
        for k, unit in enumerate(new):
            size += len(unit)
            if len(unit) > KEPT_CHARS:
                del self[unit]
            if size >= BLOCK or k + 1 == len(new):
                self._align(new[first : k + 1], plain[first : k + 1])
                first, size = k + 1, 0

    def _encoded(self, units: list[str], plain: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of the units in order, and which units both vocabularies give back byte by byte; of others there are none."""
        texts: list[list[str]] = []
        for unit, joins in zip(units, plain):
            if joins and texts and texts[-1] and len(texts[-1]) < JOINED and after:
                texts[-1].append(unit)
            else:
                texts.append([unit])
            after = joins
        ids: tuple[list[int], list[int]] = ([], [])
        fits: list[bool] = []
        for parts in texts:
            joined = "".join(parts)
            found = self.v.encode(joined)
            whole = self.v.same_bytes(joined, *found)
            if not whole and len(parts) > 1:
                for part in parts:
                    found = self.v.encode(part)
                    fits.append(self.v.same_bytes(part, *found))
                    for out, x in zip(ids, found):
                        out += x if fits[-1] else []
                continue
            fits += [whole] * len(parts)
            for out, x in zip(ids, found):
                out += x if whole else []
        return np.array(ids[0], np.int64), np.array(ids[1], np.int64), np.array(fits, bool)

    def _align(self, units: list[str], plain: list[bool]) -> None:
        a_ids, b_ids, fits = self._encoded(units, plain)
        a_ends, b_ends = self.v.a_sizes[a_ids].cumsum(), self.v.b_sizes[b_ids].cumsum()
        cuts, (a, b, _), a_groups, b_groups = align(a_ends, b_ends)
        together = a_ends[a] == b_ends[b]
        packed = (a_ids[a[together]] << self.half | b_ids[b[together]]).astype(self.pair_type)
        # units end at cuts, for both vocabularies give back all of their bytes
        sizes = np.array([len(u.encode("utf-8", "surrogatepass")) for u in units]) * fits
        ends = np.concatenate([[0], sizes.cumsum()])
        a_of, b_of, group_of = (np.searchsorted(x, ends, side="right") for x in (a_ends, b_ends, cuts))
        shared = np.concatenate([[0], product_terms(transposed(a_groups), b_groups).cumsum()])
        overlaps = np.searchsorted(a, a_of)
        rows = np.stack([fits, *(np.diff(x) for x in (a_of, b_of, group_of, overlaps, shared[a_of]))], axis=1)
        n = len(self.pairs)
        if n + len(units) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros((n + len(units), 6), np.int64)])
        self.counts[n : n + len(units)] = rows
        # all groups as one row of strings: the tokens of A of a group, then those of B
        flat = np.empty(len(a_ids) + len(b_ids), object)
        a_in, b_in = np.diff(a_groups.indptr), np.diff(b_groups.indptr)
        flat[np.arange(len(a_ids)) + np.repeat(b_groups.indptr[:-1], a_in)] = np.where(np.isin(a_ends, cuts), self.a_text[1][a_ids], self.a_text[0][a_ids])
        flat[np.arange(len(b_ids)) + np.repeat(a_groups.indptr[1:], b_in)] = np.where(np.isin(b_ends, cuts), self.b_text[1][b_ids], self.b_text[0][b_ids])
        flat, packed, width = flat.tolist(), packed.tobytes(), packed.itemsize
        at, links = (a_of + b_of).tolist(), (group_of * width).tolist()
        self.groups += ["".join(flat[x:y]) for x, y in zip(at, at[1:])]
        self.pairs += [packed[x:y] for x, y in zip(links, links[1:])]


def text_units(text: str) -> list[str]:
    """space + text, cut where no token of either vocabulary reaches over: space_chunks with a quicker way for single spaces and line ends."""
    if len(text.split()) == text.count(" ") + text.count("\n") + 1:
        return [" " + p for p in text.split(" ")]
    units = space_chunks(text)
    units[0] = " " + units[0]
    return units


def _vocabularies(paths: tuple[str, str, str]) -> Vocabularies:
    return worker_cache(("alignment", *paths), lambda: Vocabularies(*paths))


def pair_type(v: Vocabularies) -> str:
    return "<u4" if max(len(v.a_bytes), len(v.b_bytes)) <= 1 << 16 else "<u8"


def pair_bound(v: Vocabularies) -> int:
    """The most pairs of ids that can end together: for each token the suffixes that tokens of the other vocabulary may be."""
    return int(v.a_sizes.sum() + v.b_sizes.sum())


def alignments(documents: DataFrame, kind: str = "end", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends, links: both encodings, the bytes at which their tokens end, and the links of one kind.

    A link is a struct of token positions a and b and the bytes that they share. Kinds: tokens that "overlap", that share a "group",
    or that "end" together. Texts without tokens (see aligned_counts) have empty lists.
    """
    if kind not in KINDS:
        raise ValueError(f"a kind of link is one of {KINDS}")
    paths = paths or default_paths()
    token_list = pa.list_(pa.int64())
    link_list = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), *((c, token_list) for c in ("a_ids", "b_ids", "a_ends", "b_ends")), ("links", link_list)])

    def one(v: Vocabularies, text: str | None) -> tuple:
        a, b = v.encode(" " + text) if text else ([], [])
        if not text or not v.same_bytes(" " + text, a, b):
            return [], [], [], [], []
        a_ends, b_ends = v.a_sizes[a].cumsum(), v.b_sizes[b].cumsum()
        cuts, (x, y, shared), *_ = align(a_ends, b_ends)
        if kind == "group":
            parts = list(row_products(group_incidence(a_ends, cuts), transposed(group_incidence(b_ends, cuts))))
            bytes_of = dict(zip(zip(x.tolist(), y.tolist()), shared.tolist()))
            links = [{"a": i, "b": j, "shared": bytes_of.get((i, j), 0)} for p in parts for i, j in zip(p[0].tolist(), p[1].tolist())]
        else:
            kept = a_ends[x] == b_ends[y] if kind == "end" else np.ones(len(x), bool)
            links = [{"a": i, "b": j, "shared": n} for i, j, n in zip(x[kept].tolist(), y[kept].tolist(), shared[kept].tolist())]
        return a, b, a_ends.tolist(), b_ends.tolist(), links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabularies(paths)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                columns = zip(*(one(v, t) for t in batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_ids array<long>, b_ids array<long>, a_ends array<long>, b_ends array<long>, links array<struct<a:long,b:long,shared:long>>")


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_shared long, groups_sha256 string, pairs binary"


def _aligned(documents: DataFrame, paths: tuple[str, str, str], packed: str) -> DataFrame:
    """Per document the counts of tokens, groups and links, the digest of the groups and the ids of tokens that end together."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_overlaps", "n_shared")), ("groups_sha256", pa.string()), ("pairs", pa.binary())])

    nothing = (0, 0, 0, 0, 0, "", b"")

    def one(units: Units, text: str | None, at: list[int]) -> tuple:
        if not text:
            return nothing
        counts = units.counts[at]
        if not counts[:, 0].all():
            # units that don't give their bytes might make up for each other: the text as one unit decides
            at = [units[" " + text]]
            units.settle()
            counts = units.counts[at]
            if not counts[0, 0]:
                return nothing
        groups = "".join(map(units.groups.__getitem__, at))
        return *counts[:, 1:].sum(0, dtype=np.int64).tolist(), hashlib.sha256(groups[:-1].encode()).hexdigest(), b"".join(map(units.pairs.__getitem__, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_cache(("alignment units", *paths), lambda: Units(Vocabularies(*paths), packed))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                units.limit()
                batch = whole.slice(at, SLICE_ROWS)
                texts = batch.column(1).to_pylist()
                numbers = [list(map(units.__getitem__, text_units(t))) if t else [] for t in texts]
                units.settle()
                columns = zip(*(one(units, t, at) for t, at in zip(texts, numbers)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, packed: str) -> DataFrame:
    """pair, n: links of each pair of ids over all documents. A task adds up its own first, in a table that the vocabularies bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.empty(0, packed), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for pairs in batch.column(0).to_pylist():
                waiting.append(np.frombuffer(pairs, packed))
                size += len(waiting[-1])
                if size > 4 * BLOCK:
                    (keys, counts), waiting, size = merged(), [], 0
        if waiting:
            keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def default_paths() -> tuple[str, str, str]:
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")


def aligned_counts(documents: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_shared of every document.

    paths: file and ranks of A (byte-level), model of B (pieces with byte fallback). space + text is encoded by A and text by B, which
    adds the space; special strings are plain text. Links are pairs of tokens that end together; the count of a pair of ids is that
    of its links in all documents. count_sum adds the counts of a document's links, n_best are its links whose count is the highest
    of their B id. n_overlaps and n_shared count the pairs of tokens that overlap and that share a group.

    Texts are encoded once, by units that repeat, and leave the ids that end together; counts are added up from these in tasks and by
    a shuffle of at most pair_bound rows a task, and come back to the documents by a broadcast of at most pair_bound rows.

    Null and empty texts, and those that either vocabulary doesn't give back byte by byte, have no tokens: zeros and ''. Null ids and
    repeated rows keep their row and count each. An empty table gives no rows. Other columns are ignored.
    """
    paths, spark = paths or default_paths(), documents.sparkSession
    v = Vocabularies(*paths)
    packed = pair_type(v)
    aligned = stored(_aligned(documents, paths, packed), "alignments")
    bound = pair_bound(v)
    found = pair_counts(aligned, packed).limit(bound + 1).toArrow()
    if found.num_rows > bound:
        raise ValueError("more pairs of ids than tokens that end together can make")
    keys, counts = (found.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(keys)
    keys, counts = keys[order].astype(packed), counts[order].astype(np.int64)
    b_ids = keys.astype(np.uint64) & np.uint64((1 << 4 * np.dtype(packed).itemsize) - 1)
    highest = np.zeros(len(v.b_bytes), np.int64)
    np.maximum.at(highest, b_ids.astype(np.int64), counts)
    table_of = spark.sparkContext.broadcast((keys, counts, counts == highest[b_ids.astype(np.int64)]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table_of.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                rows = []
                for pairs in batch.column("pairs").to_pylist():
                    k = np.searchsorted(keys, np.frombuffer(pairs, packed))
                    rows.append((len(k), int(best[k].sum()), int(counts[k].sum())))
                made = [pa.array(c, pa.int64()) for c in zip(*rows)]
                named = {name: batch.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_overlaps", "n_shared")}
                named |= dict(zip(("n_links", "n_best", "count_sum"), made))
                yield pa.RecordBatch.from_arrays([named[c] for c in RESULT], names=list(RESULT))

    return aligned.mapInArrow(add, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULT))


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(table(spark, sf_dir, "documents"))
