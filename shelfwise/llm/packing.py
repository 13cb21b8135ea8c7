"""Packing of documents into token sequences: Martello-Toth dominance reduction, then best fit.

Bins of one capacity only differ by the lengths they hold, so the instance is the count of pieces of each length: a table of at
most `capacity` numbers, whatever the corpus. The reduction and the best fit work on these counts and yield a few thousand bin
patterns with multiplicities (`plan_bins`); each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, stored, table
from .vocab import byte_bpe, space_chunks, tokenizer_path


class _Lengths:
    """A multiset of lengths with the look-ups that the rules need."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()

    def largest(self, most: int) -> int:
        """The largest length present that is no longer than most; 0 if none."""
        found = np.flatnonzero(self.n[1 : most + 1]) if most > 0 else ()
        return int(found[-1]) + 1 if len(found) else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest pieces (fewer if there are not so many)."""
        out: list[int] = []
        for w in np.flatnonzero(self.n):
            out += [int(w)] * int(min(self.n[w], k - len(out)))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two pieces with the largest sum that fits; (0, 0) if none."""
        best = (0, 0)
        for a in np.flatnonzero(self.n[: room // 2 + 1]):
            a = int(a)
            if a == 0:
                continue
            self.n[a] -= 1
            b = self.largest(room - a)
            self.n[a] += 1
            if b and a + b > sum(best):
                best = (a, b)
                if a + b == room:
                    break
        return best


def reduce_dominant(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Bins that some best packing has, as (lengths, times), and the counts that remain.

    For the longest piece j, a set F with j dominates if the partners that any other feasible set gives j can change places with
    parts of F: then a best packing with F as a bin exists. With r = capacity - j and k the largest piece that fits into r:
    nothing fits: F = {j}; k = r, or no two others fit together: F = {j, k}; no three fit and k is as long as the best pair:
    F = {j, k}. Going on from the longest length, a length that no rule settles is left, with all of its pieces.
    """
    left, fixed = _Lengths(counts), []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(left.n)[::-1].tolist():
            while left.n[j]:
                left.n[j] -= 1
                room = capacity - j
                k = left.largest(room)
                small = left.smallest(3)
                if k == 0:
                    others: tuple[int, ...] | None = ()
                elif k == room or sum(small[:2]) > room or len(small) < 2:
                    others = (k,)
                elif (sum(small) > room or len(small) < 3) and k >= sum(left.best_pair(room)):
                    others = (k,)
                else:
                    others = None
                left.n[j] += 1
                if others is None:
                    break
                if not others:
                    times = int(left.n[j])
                elif others[0] == j:
                    times = int(left.n[j]) // 2
                else:
                    times = int(min(left.n[j], left.n[others[0]]))
                if len(small) <= 3 and others and k != room:
                    times = 1  # so few pieces are left that the rule's ground may go with one bin
                if times == 0:
                    break
                for w in (j, *others):
                    left.n[w] -= times
                fixed.append(((j, *others), times))
                changed = True
    return fixed, left.n


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins of best-fit decreasing as (lengths, times): each piece to the fullest bin that it fits into, longest first."""
    open_bins: dict[int, list[list]] = {}  # room left -> [lengths, times]
    for w in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[w])
        while todo:
            room = min((r for r in open_bins if r >= w), default=None)
            if room is None:
                each = capacity // w
                full, rest = divmod(todo, each)
                if full:
                    open_bins.setdefault(capacity - each * w, []).append([(w,) * each, full])
                if rest:
                    open_bins.setdefault(capacity - rest * w, []).append([(w,) * rest, 1])
                break
            group = open_bins[room]
            lengths, times = group.pop()
            if not group:
                del open_bins[room]
            each = room // w
            full = min(times, todo // each)
            if full:
                open_bins.setdefault(room - each * w, []).append([lengths + (w,) * each, full])
                todo -= full * each
                times -= full
            if times and 0 < todo < each:
                open_bins.setdefault(room - todo * w, []).append([lengths + (w,) * todo, 1])
                times -= 1
                todo = 0
            if times:
                open_bins.setdefault(room, []).append([lengths, times])
    return [(lengths, times) for group in open_bins.values() for lengths, times in group]


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first_rank, each, bins, first_sequence, first_offset).

    The pieces of a length with ranks from first_rank on fill `bins` sequences from first_sequence on, `each` to a sequence, side
    by side from first_offset on.
    """
    fixed, rest = reduce_dominant(counts, capacity)
    rank = np.zeros(capacity + 1, np.int64)
    sequence, out = 0, []
    for lengths, times in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for w in sorted(set(lengths), reverse=True):
            each = lengths.count(w)
            out.append((w, int(rank[w]), each, times, sequence, offset))
            rank[w] += each * times
            offset += each * w
        sequence += times
    return out


def token_pieces(documents: DataFrame, capacity: int, json_path: str, ranks_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut into pieces of `capacity`.

    Only documents that are longer are cut; then the first piece takes what the full ones leave over.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = byte_bpe(json_path, ranks_path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = b"".join(map(cache.__getitem__, space_chunks(text))) + end if text else end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        for col, value in zip(cols, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                            col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, capacity: int = 2048, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all pieces in as few sequences as the method finds.

    The pieces are stored, sorted by (length, doc_id, piece) and ranked within their length from counts by partition; only ids and
    numbers are shuffled. What the driver gets is a count for each partition and the lengths in it, at most partitions + capacity
    rows, and what is broadcast is the plan, whose size the capacity bounds.

    Null or empty text: the end id alone. Null ids sort first; repeated rows are packed each. An empty table gives no rows. Other
    columns are ignored.
    """
    json_path, ranks_path = json_path or tokenizer_path("byte_bpe_50k.json"), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken")
    spark = documents.sparkSession
    pieces = stored(token_pieces(documents, capacity, json_path, ranks_path), "pieces")
    order = ["length", "doc_id", "piece", "ids_crc32"]
    at = F.monotonically_increasing_id()
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "pieces-sorted")
    found = sorted(
        tuple(r)
        for r in ordered.groupBy("length", "_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).select("length", "_part", "first", "n").collect()
    )
    counts, ranks = np.zeros(capacity + 1, np.int64), []
    for length, part, first, n in found:
        ranks.append((length, part, int(counts[length]) - first))
        counts[length] += n
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for segment in plan_bins(counts, capacity):
        by_length.setdefault(segment[0], []).append(segment[1:])
    plan = {w: np.array(v, np.int64).T for w, v in by_length.items()}
    shift = {(length, part): by for length, part, by in ranks}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_part", "_at"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            cuts = np.flatnonzero((np.diff(length) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(length)]):
                if a == b:
                    continue
                w = int(length[a])
                rank = at[a:b] + shift[w, int(part[a])]
                first, each, _, seq, off = (x for x in plan[w])
                k = np.searchsorted(first, rank, side="right") - 1
                inside = rank - first[k]
                sequence[a:b] = seq[k] + inside // each[k]
                offset[a:b] = off[k] + inside % each[k] * w
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ordered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
