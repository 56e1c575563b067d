"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after learned rotations (iterative quantisation, fitted on a bounded sample). A code is
split into 8-bit substrings, and each substring has its own index. By the pigeonhole principle, a code within radius
s * (number of substrings) + (number of substrings) - 1 of the query has a substring within s of the query's, so probing
all substrings within s retrieves every code of that radius. The radius grows until it holds enough codes; all codes
within it are then reranked by the cosine of the original vectors, in double precision.

Rows are dealt to blocks of bounded size, queries to blocks of their own; each pair of blocks is searched by one task,
and the best of all blocks are merged. Every row is indexed. The stated query set meets all rows, in blocks, as a search must.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import mapped, ship, written

#: Rows of the sample that the rotations are fitted on, bits of a code, rows of an index block, of a query block.
SAMPLE, BITS, BLOCK, QUERIES = 4096, 128, 16_384, 4_096
#: The radius grows until it holds this share of a block's codes (and this many at least), and by so many bits more.
SHARE, LEAST, MORE = 0.08, 64, 4


def fit_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, d x bits): orthogonal rotations of the centred unit vectors that bring them close to their signs."""
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    centred, random, out = sample - mean, np.random.default_rng(0), []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(random.normal(size=(d, d)))[0]
        for _ in range(rounds if len(sample) > d else 0):
            z = centred @ r
            u, _, vt = np.linalg.svd(centred.T @ np.where(z > 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return mean, np.concatenate(out, 1)[:, :bits]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_NEAR = [[v for n in range(s + 1) for c in combinations(range(8), n) for v in [sum(1 << b for b in c)]] for s in range(9)]


class MultiIndex:
    """Inverted lists of 8-bit substrings of codes (n x bytes)."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.words = codes, np.ascontiguousarray(codes).view(np.uint64)
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.start = [np.searchsorted(np.sort(c), np.arange(257)) for c in codes.T]

    def within(self, query: np.ndarray, least: int, more: int = MORE) -> np.ndarray:
        """All codes within the smallest radius that holds ``least`` of them, and ``more`` bits."""
        n, m = self.codes.shape
        own = query.view(np.uint64)
        for s in range(9):
            seen = np.zeros(n, bool)
            for j in range(m):
                for v in _NEAR[s]:
                    v ^= int(query[j])
                    seen[self.order[j][self.start[j][v] : self.start[j][v + 1]]] = True
            found = np.flatnonzero(seen)
            distance = np.bitwise_count(self.words[found] ^ own).sum(1, dtype=np.int64)
            sure = m * (s + 1) - 1  # every code within this radius has been retrieved
            radius = int(np.partition(distance, least - 1)[least - 1]) + more if len(found) >= least else 1 << 30
            if s == 8 or radius <= sure:
                return found[distance <= radius]
        return found


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose key is divisible by ``every``.

    Nearness is the cosine in double precision on the original vectors; ties go to the smaller key. A row is no
    candidate for itself; a repeated row is one for its copy. Rows with a null key, and vectors that are null, empty,
    zero, of another length than most, or hold null or non-finite components take no part. No such rows, no result."""
    ship(vectors.sparkSession)
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = written(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & fine).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    n, d = (sizes[0]["count"], sizes[0]["d"]) if sizes else (0, 0)
    rows = rows.filter(F.size("v") == d)
    # about SAMPLE rows, by a threshold on a hash: no task sends more than its share
    drawn = F.shiftrightunsigned(F.xxhash64("row", F.lit(3)), 2) < int(2**62 * min(1.0, SAMPLE / max(n, 1)))
    sample = np.array([r.v for r in sorted(rows.filter(drawn).select("row", "v").collect(), key=lambda r: r.row)], dtype=float).reshape(-1, max(d, 1))
    mean, rotation = fit_rotations(_unit(sample)) if len(sample) else (np.zeros(1), np.zeros((1, BITS)))
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-n // every // QUERIES))

    def read(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def coded(batches):
        for b in batches:
            x = read(pa.Table.from_batches([b]))
            codes = np.packbits((_unit(x) - mean) @ rotation > 0, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "code"])

    held = mapped(rows, coded, "id long, v array<double>, row long, code binary")
    deal = lambda c, n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).alias(c)
    index = held.select("*", deal("block", blocks, 1)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    queries = held.filter(F.col("id") % every == 0).select("*", deal("part", parts, 2)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            codes = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            x, q, machine = read(own), read(asked), MultiIndex(codes(own))
            ids, at = own.column("id").to_numpy(), own.column("row").to_numpy()
            norms = np.sqrt((x * x).sum(1))
            least = min(len(x), max(LEAST, int(share * len(x)), 4 * k))
            for y, code, name, row in zip(q, codes(asked), asked.column("id").to_pylist(), asked.column("row").to_pylist()):
                near = machine.within(code, least)
                near = near[at[near] != row]
                score = (x[near] * y).sum(1) / (norms[near] * np.sqrt((y * y).sum()))
                best = np.lexsort((ids[near], -score))[:k]
                out += [(row, name, int(ids[near[i]]), float(score[i])) for i in best]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({"row": pa.array(columns[0], pa.int64()), "query_id": pa.array(columns[1], pa.int64()), "vec_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})

    found = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(search, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
