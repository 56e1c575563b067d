"""Sharding by sampled splitters, on DataFrame functions only.

A size-weighted sample of keys is drawn (each row enters as often as its share of the bytes asks for, decided by a hash
of its key, so a lost executor redraws the same sample). Quantiles of the sample are the splitters of many fine ranges.
Exact bytes of every range are counted, and ranges that hold more than twice their share are sampled again, more
densely, and subdivided. Rows are then range-partitioned: running bytes inside a range plus the bytes of all ranges
before it give a row's exact place in key order, and the shards are equal slices of that order.

A key that a third of all rows share is no problem as long as the key columns end in an identifier: the splitters fall
between its rows. Only bounded data reach the driver: the sample (at most about ``ranges * draws`` rows), the
ranges' totals and one row a shard.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import let, written

#: Fine ranges for each shard, draws for each range, rounds of subdividing.
RANGES_PER_SHARD, DRAWS, ROUNDS = 32, 12, 3


def _in_range(key: Column, bounds: list[tuple], kind: str) -> Column:
    """How many bounds are at most key: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    names = [f"k{i}" for i in range(len(bounds[0]))]
    held = F.from_json(F.lit(json.dumps([dict(zip(names, b)) for b in bounds])), kind, {"mode": "FAILFAST"})
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    step = lambda at, s: F.when((at + s <= n) & (F.get(held, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def range_shards(df: DataFrame, keys: list[str], size: str, shards: int, ranges_per_shard: int = RANGES_PER_SHARD, draws: int = DRAWS) -> DataFrame:
    """df with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) by the order of ``keys``.

    Shards' sums of ``size`` differ by about one row's size at most. Null keys come first. Rows equal in all keys are
    interchangeable and get adjacent places. An empty df gives an empty result. Columns of df named shard or slot are
    replaced. df is read several times: pass a written table that holds only what is needed.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    names = [f"k{i}" for i in range(len(keys))]
    types = dict(df.dtypes)
    kind = f"array<struct<{','.join(f'{n}:{types[k]}' for n, k in zip(names, keys))}>>"
    rows = df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.struct(*[F.col(k).alias(n) for n, k in zip(names, keys)]).alias("key"), F.col(size).cast("long").alias("size"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return df.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total = max(total, 1)
    uniform = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    target = total / (shards * ranges_per_shard)

    def splitters(some: DataFrame, each: float) -> list[tuple]:
        """Quantile boundaries, one for each ``each`` bytes, of a sample with ``draws`` draws for as much."""
        drawn = some.select("key", F.floor(F.col("size") * F.lit(draws / each) + uniform).alias("n")).filter("n > 0")
        at, out = 0, []
        for key, n in sorted(((tuple(r.key), r.n) for r in drawn.collect()), key=lambda x: tuple((v is not None, v) for v in x[0])):
            if at // draws < (at + n) // draws:
                out.append(key)
            at += n
        return out

    bounds: list[tuple] = []
    order = lambda found: sorted(set(found), key=lambda b: tuple((v is not None, v) for v in b))
    bounds = order(splitters(rows, target))
    for again in range(ROUNDS + 1):
        placed = rows.withColumn("range", _in_range(F.col("key"), bounds, kind))
        held = {r["range"]: (r.b, r.n) for r in placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        over = [k for k, (b, n) in held.items() if b > 2 * target and n > 1]
        if not over or again == ROUNDS:
            break
        finer = order(bounds + splitters(placed.filter(F.col("range").isin(over)), target / 4 ** (again + 1)))
        if finer == bounds:
            break
        bounds = finer

    bytes_before, rows_before, b, n = [], [], 0, 0
    for k in range(len(bounds) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + held.get(k, (0, 0))[0], n + held.get(k, (0, 0))[1]
    constant = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")
    inside = Window.partitionBy("range").orderBy("key")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    place = placed.withColumns({"run": F.sum("size").over(upto), "nth": F.row_number().over(inside)})
    middle = (F.get(constant(bytes_before), F.col("range")) + F.col("run")) * 2 - F.col("size")
    place = place.select("row", F.least(F.lit(shards - 1).cast("long"), F.call_function("div", middle * shards, F.lit(2 * total))).cast("int").alias("shard"), (F.get(constant(rows_before), F.col("range")) + F.col("nth") - 1).alias("pos"))
    starts = dict(place.groupBy("shard").agg(F.min("pos")).collect())
    return place.select("row.*", "shard", (F.col("pos") - F.get(constant([starts.get(k, 0) for k in range(shards)]), F.col("shard"))).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents.

    Law ``bytes``: the shards' sums of sizes are near equal. A null text has size 1 and the check sum of no bytes, an
    empty one too; equal texts lie side by side, and one group of equal texts is cut only where a shard is full.
    A text larger than a shard's share has a shard nearly to itself. Repeated rows each get a slot; other columns are not read.
    """
    text = F.col("text").cast("binary")
    sized = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(b""))).alias("text_hash"),
    )
    placed = range_shards(written(sized, "shard-sizes"), ["text_hash", "text_crc32", "doc_id"], "size", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
