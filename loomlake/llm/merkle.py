"""A Merkle manifest of a dataset: a tree for each language, a tree over their roots, a proof for every row, verified.

The digest of every row is made by Spark's functions; rows are placed in order by range partitions. Then aligned blocks of
``fanout ** HEIGHT`` nodes, which have one node above them, are hashed each in one contiguous numpy matrix of 64-byte hex
digests: reshaped by the fanout, hashed row by row, level by level. The blocks' nodes are the leaves of the next stage,
until one node is left of every tree. On the way down each block is told what its own node needs above it, and finds every
sibling inside it by index arithmetic. A block is a group of bounded size, whatever the size of a language.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded, placed, ship, written

#: Children of a node, and levels of nodes in a block.
FANOUT, HEIGHT = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Hex sha256 of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def levels(leaves: np.ndarray, fanout: int, height: int | None) -> list[np.ndarray]:
    """All levels of nodes, leaves first: as many as height says above them, or until one node is left."""
    out = [leaves]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        top = out[-1]
        whole = len(top) // fanout
        found = [sha256(row).hexdigest() for row in top[: whole * fanout].reshape(whole, fanout * 64)]
        if whole * fanout < len(top):
            found.append(sha256(top[whole * fanout :].tobytes()).hexdigest())
        out.append(matrix(found))
    return out


def siblings(level: np.ndarray, fanout: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after each node in its run of children."""
    held, out = level.tobytes(), []
    for i in range(len(level)):
        first = i // fanout * fanout
        last = min(first + fanout, len(level))
        out.append((held[64 * first : 64 * i], held[64 * (i + 1) : 64 * last]))
    return out


def fold(digest: str, path: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and the siblings on its way up give."""
    for before, after in path:
        digest = sha256(before + digest.encode() + after).hexdigest()
    return digest


def _height(n: int, fanout: int, height: int) -> int | None:
    """How far a block of a tree of n nodes goes up: all the way if it is the only one."""
    return None if n <= fanout**height else height


def _paths(table: pa.Table, fanout: int, height: int) -> tuple[np.ndarray, list[list[tuple[bytes, bytes]]]]:
    """The order of a block's rows and, row by row of that order, the siblings inside the block, level by level."""
    order = np.argsort(table.column("i").to_numpy(), kind="stable")
    digests = table.column("digest").to_pylist()
    tower = levels(matrix([digests[k] for k in order]), fanout, _height(table.column("n")[0].as_py(), fanout, height))
    beside = [siblings(level, fanout) for level in tower[:-1]]
    return order, [[level[i // fanout**j] for j, level in enumerate(beside)] for i in range(len(order))]


def _up(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """nodes (tree, i, digest, n: nodes of that tree) -> the blocks' nodes, in the same shape."""
    size = fanout**height

    def run(key, table):
        tree, block = (k.as_py() for k in key)
        n = table.column("n")[0].as_py()
        order = np.argsort(table.column("i").to_numpy(), kind="stable")
        digests = table.column("digest").to_pylist()
        top = levels(matrix([digests[k] for k in order]), fanout, _height(n, fanout, height))[-1]
        return pa.table({"tree": pa.array([tree], pa.int64()), "i": pa.array([block], pa.int64()), "digest": [top.tobytes().decode()], "n": pa.array([-(-n // size)], pa.int64())})

    blocks = nodes.select("tree", F.floor(F.col("i") / size).alias("block"), "i", "digest", "n")
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree long, i long, digest string, n long")


def _stages(leaves: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """The written leaves and, written each, the nodes of every stage above them; the last has one node a tree."""
    out = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        out.append(written(_up(out[-1], fanout, height), "merkle-nodes"))
        most = -(-most // fanout**height)
    return out


def _down(nodes: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """nodes, and above (tree, i of a block, lefts, rights: what is beside its path) -> tree, i, lefts, rights of every node."""
    size = fanout**height

    def run(key, table, tail):
        order, paths = _paths(table, fanout, height)
        lefts, rights = tail.column("lefts")[0].as_py(), tail.column("rights")[0].as_py()
        side = lambda k, more: pa.array([[p[k].decode() for p in path] + more for path in paths], pa.list_(pa.string()))
        return pa.table({"tree": table.column("tree").take(pa.array(order)), "i": table.column("i").take(pa.array(order)), "lefts": side(0, lefts), "rights": side(1, rights)})

    blocks = nodes.select("tree", F.floor(F.col("i") / size).alias("block"), "i", "digest", "n")
    tails = above.select("tree", F.col("i").alias("block"), "lefts", "rights")
    return blocks.groupBy("tree", "block").cogroup(tails.groupBy("tree", "block")).applyInArrow(run, "tree long, i long, lefts array<string>, rights array<string>")


def _proofs(leaves: DataFrame, above: DataFrame, root: str, fanout: int, height: int) -> DataFrame:
    """The lowest stage of the way down: proofs of all rows, and what each row (tampered with, if it is) folds to."""
    size = fanout**height

    def run(key, table, tail):
        order, paths = _paths(table, fanout, height)
        lefts, rights = tail.column("lefts")[0].as_py(), tail.column("rights")[0].as_py()
        upper = [(a.encode(), b.encode()) for a, b in zip(lefts, rights)]
        rows = table.take(pa.array(order))
        claimed = [c or d for c, d in zip(rows.column("changed").to_pylist(), rows.column("digest").to_pylist())]
        text = b"".join(x for pair in upper for x in pair)
        proof, folded = [], []
        for leaf, path in zip(claimed, paths):
            proof.append(sha256(b"".join(x for pair in path for x in pair) + text).hexdigest())
            folded.append(fold(leaf, path + upper))
        n = len(rows)
        return pa.table({"doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": [tail.column("subroot")[0].as_py()] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded})

    blocks = leaves.select("tree", F.floor(F.col("i") / size).alias("block"), "i", "digest", "n", "doc_id", "changed")
    tails = above.select("tree", F.col("i").alias("block"), "lefts", "rights", "subroot")
    schema = f"doc_id {dict(leaves.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return blocks.groupBy("tree", "block").cogroup(tails.groupBy("tree", "block")).applyInArrow(run, schema)


def manifest(documents: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", tampered: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """doc_id (the key), leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    A tree for each value of ``group`` (null first, then by bytes) over its rows by key, null keys first, and a tree over
    their roots. tampered: the digest that a row claims instead of its own, null where it is honest; folded_root is what
    the claimed digest and the true siblings give. Rows that share a key stand by their digests, and equal rows have
    places side by side. Texts of any length are hashed whole; an empty table has no row; other columns are not read."""
    ship(documents.sparkSession)
    digest = leaf_digest([F.col(c) for c in fields])
    rows = documents.select(F.col(group).alias("group"), F.col(key).alias("doc_id"), digest.alias("digest"), (F.lit(None).cast("string") if tampered is None else tampered).alias("changed"))
    rows = placed(rows, [F.col(c).asc_nulls_first() for c in ("group", "doc_id", "digest")], "merkle-leaves")
    trees = written(rows.groupBy("group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    trees = placed(trees, [F.col("first").asc()], "merkle-trees").withColumnRenamed("place", "tree")
    t = bounded(trees.select(F.col("group").alias("_group"), "first", "n", "tree"))
    leaves = rows.join(t, F.col("group").eqNullSafe(F.col("_group"))).select("tree", (F.col("place") - F.col("first")).alias("i"), "digest", "n", "doc_id", "changed")
    leaves = written(leaves, "merkle-leaves")
    stages = _stages(leaves, fanout, height)
    tops = stages[-1].select(F.col("tree").alias("i"), "digest")
    count = tops.count()
    upper = _stages(tops.select(F.lit(0).cast("long").alias("tree"), "i", "digest", F.lit(count).cast("long").alias("n")), fanout, height)
    root = upper[-1].first()
    none = F.array().cast("array<string>")
    above = upper[-1].select("tree", "i", none.alias("lefts"), none.alias("rights"))
    for nodes in reversed(upper[:-1]):
        above = _down(nodes, above, fanout, height)
    # what stands above the root of every group's tree; the root of its tree is the only block of the stage below
    above = written(above.select(F.col("i").alias("tree"), F.lit(0).cast("long").alias("i"), "lefts", "rights"), "merkle-paths") if count else above
    for nodes in reversed(stages[1:-1]):
        above = written(_down(nodes, above, fanout, height), "merkle-paths")
    above = above.join(stages[-1].select("tree", F.col("digest").alias("subroot")), "tree")
    found = _proofs(leaves, above, root.digest if root else "", fanout, height)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_digest(fields: tuple[str, ...] = FIELDS, key: str = "doc_id", number: str = "n_chars", every: int = 7) -> Column:
    """The digest of a row with one added to ``number``, where ``every`` divides the check sum of its key; else null.

    A null number stays as it is, and a null key is never tampered with."""
    more = (F.col(number).cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = leaf_digest([more if c == number else F.col(c) for c in fields])
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, changed)


def audit_documents(documents: DataFrame) -> DataFrame:
    """The manifest of documents by language, with every row tampered with whose check sum 7 divides."""
    return manifest(documents, tampered=tampered_digest())
