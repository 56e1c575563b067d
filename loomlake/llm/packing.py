"""Best-fit-decreasing packing of token sequences, exact over the whole table.

Lengths are integers up to the capacity, so best-fit decreasing depends only on how many pieces have each length. That
histogram (at most ``capacity`` rows, whatever the input) is packed once: bins with equal remaining capacity are
handled as one group, a segment tree over remaining capacities finds the tightest open group in logarithmic time, and
filling a group places as many pieces as its bins take, as the piece-by-piece procedure would. The plan says which
ranks of which length go to which bins; the pieces then find their places by their rank among pieces of equal length,
which is counted in a distributed way: rank inside a small (length, salt) cell plus the cells before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import mapped, written
from .bpe import coder_of

CAPACITY, END = 1024, 2
#: Pieces of a cell about; cells of a length at least.
CELL, SALTS = 20_000, 256


class Tightest:
    """Segment tree over remaining capacities 0..capacity: which have open bins, and the least of them at or above r."""

    def __init__(self, capacity: int):
        self.n = 1 << (capacity + 1).bit_length()
        self.held = bytearray(2 * self.n)

    def set(self, r: int, value: bool) -> None:
        i = self.n + r
        self.held[i] = value
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def find(self, r: int) -> int | None:
        i = self.n + r
        if self.held[i]:
            return r
        while i > 1:
            if not i & 1 and self.held[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.held[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces: rows (length, first rank, first bin, pieces a bin, offset).

    Pieces of that length from that rank on fill bins one after another, so many to each, until the next row's rank.
    The bins' groups are intervals of bin numbers. At most a few groups arise for each length, and lengths in one bin
    are distinct from row to row, so the plan's size has a bound that depends on the capacity alone."""
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> [first bin, number of bins)
    tree, bins, rows = Tightest(capacity), 0, []

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            groups.setdefault(r, []).append((first, n))
            tree.set(r, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.find(length)
            if r is None:
                r, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = groups[r].pop()
                if not groups[r]:
                    tree.set(r, False)
                each = r // length
            full, rest = divmod(min(left, n * each), each)
            rows.append((length, rank, first, each, capacity - r))
            put(r - each * length, first, full)
            put(r - rest * length, first + full, 1 if rest else 0)
            put(r, first + full + (1 if rest else 0), n - full - (1 if rest else 0))
            rank += full * each + rest
            left -= full * each + rest
    return rows


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    first = length % capacity or capacity if length > capacity else length
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]] if length else []


def pieces(documents: DataFrame, path, pattern: str, text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut where longer than capacity."""

    def run(batches):
        coder, last = coder_of(path() if callable(path) else path, pattern), np.array([end], "<u4").tobytes()
        for b in batches:
            take, out = [], []
            for i, x in enumerate(b.column("text").to_pylist()):
                ids = coder.encode(x or "").astype("<u4").tobytes() + last
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    take.append(i)
                    out.append((k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            k, start, n, crc = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(take, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kept = documents.select("doc_id", F.col(text).alias("text"))
    return mapped(kept, run, f"doc_id {dict(kept.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces with sequence_id and offset. It is read twice: pass a written table."""
    each = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(each, capacity)
    salts = max(SALTS, 1 << (sum(each.values()) // CELL).bit_length())
    columns = cut_pieces.columns
    # Rows alike in all columns are interchangeable, so ties do no harm.
    cells = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = cells.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cells.withColumn("nth", nth - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    def place(batches):
        key = table[:, 0] << 42 | table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length << 42 | rank, side="right") - 1
            _, first_rank, first_bin, each, offset = table[i].T
            bins, nth = np.divmod(rank - first_rank, np.maximum(each, 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(first_bin + bins), pa.array(offset + nth * length)], [*columns, "sequence_id", "offset"])

    kinds = dict(cut_pieces.dtypes)
    return mapped(ranked.select(*columns, "rank"), place, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, path, pattern: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is the end id alone. Repeated rows are packed each; an empty table packs to nothing."""
    return pack(written(pieces(documents, path, pattern, text, capacity), "pieces"), capacity)
