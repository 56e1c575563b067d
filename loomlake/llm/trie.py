"""A prefix trie of conversations: which beginnings they share, what caching them would save.

Every turn gets a digest; one sorted pass over each family of conversations chains the digests, so that the cryptographic
digest of a prefix stands for all its turns. Prefixes are exploded, one row for each conversation and depth, and grouped by
(depth, digest): the groups are the nodes.

A node is named by its smallest member and its depth. Below the node where a conversation becomes the smallest member it
stays so along its own path: its nodes form one chain. So sums over subtrees need no row for each node and ancestor: every
chain is summed first, each chain is exploded to all chains that its path has run through (with the depth where it left
them), and running sums along each chain finish the job. There are no more such rows than turns.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import mapped, word_count, written

#: Conversations of a family share the beginning of its first one: so many turns less than HEADS, by check sum.
FAMILY, HEADS = 20, 4
#: Nodes with more than one in so many prefixes are hot: there are at most that many of them.
HOT = 1_000
#: Identifiers in one piece of the text that is hashed, rows in one batch that a task hands on.
PIECE, BATCH = 4_096, 10_000
ROOT = b"\0" * 32


def _chained(batches):
    """Rows sorted by (family, own first, conv_id, turn, digest) -> a row for each prefix of each rebuilt conversation.

    State: the first turns of the family's own conversation, and the chain of the conversation at hand."""
    out: list[tuple] = []
    family, head = None, []
    conv, chain, depth, last_words, place, skip = None, ROOT, 0, 0, 0, 0

    def put(ends: bool) -> None:
        out.append((conv, depth, chain, last_words, ends))

    def batch():
        conv, depth, chain, words, ends = zip(*out)
        out.clear()
        arrays = [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(chain, pa.binary()), pa.array(words, pa.int64()), pa.array(ends, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "depth", "digest", "words", "ends"])

    for b in batches:
        for f, c, digest, words, skipped in zip(*(b.column(x).to_pylist() for x in ("family", "conv_id", "digest", "words", "skip"))):
            if f != family:
                family, head = f, []
            if c != conv:
                if conv is not None:
                    put(True)
                conv, chain, depth, last_words, place, skip = c, ROOT, 0, 0, 0, skipped
                if c != family:
                    for turn, n in head[:skip]:
                        put(False)
                        chain, depth, last_words = sha256(chain + turn).digest(), depth + 1, n
            if c == family:
                if place < HEADS:
                    head.append((digest, words))
            if c == family or place >= skip:
                put(False)
                chain, depth, last_words = sha256(chain + digest).digest(), depth + 1, words
            place += 1
            if len(out) >= BATCH:
                yield batch()
    if conv is not None:
        put(True)
    if out:
        yield batch()


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, digest, words (of the prefix's last text), ends (the prefix is the whole conversation)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    conv = F.col("conv_id").cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        (conv - conv % FAMILY).alias("family"),
        conv.alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(turn).alias("digest"),
        word_count(text).alias("words"),
        (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int").alias("skip"),
    )
    order = [F.col("family"), F.col("conv_id") != F.col("family"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    rows = rows.repartition("family").sortWithinPartitions(*order)
    return mapped(rows, _chained, "conv_id long, depth long, digest binary, words long, ends boolean")


def _owned(found: DataFrame) -> DataFrame:
    """Every prefix with its node's smallest member (owner) and number of members. Hot nodes, of which there are at most
    HOT, are broadcast; the others are met by a shuffle."""
    key = ["depth", "digest"]
    nodes = written(found.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    total = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    hot = nodes.filter(F.col("n_convs") * HOT > total)
    met = found.join(F.broadcast(hot), key)
    rest = found.join(F.broadcast(hot.select(*key)), key, "left_anti").join(nodes.filter(F.col("n_convs") * HOT <= total), key)
    return met.unionByName(rest).select("conv_id", "depth", "owner", "n_convs", "words", "ends")


def _pieces(batches):
    """Sorted (owner, depth, conv_id) -> owner, depth, first, text: identifiers, comma-joined, of a run of rows."""
    at, held, out = None, [], []

    def put() -> None:
        out.append((*at, held[0], ",".join(map(str, held))))
        held.clear()

    def batch():
        owner, depth, first, text = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(first, pa.int64()), pa.array(text)], ["owner", "depth", "first", "text"])

    for b in batches:
        for o, d, c in zip(*(b.column(x).to_pylist() for x in ("owner", "depth", "conv_id"))):
            if held and ((o, d) != at or len(held) == PIECE):
                put()
            at = (o, d)
            held.append(c)
        if len(out) >= BATCH:
            yield batch()
    if held:
        put()
    if out:
        yield batch()


def _hashed(batches):
    """Sorted (owner, depth, first, text) -> owner, depth, ends_sha256; a node's pieces are hashed one after another."""
    at, state, out = None, None, []

    def batch():
        owner, depth, found = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(found)], ["owner", "depth", "ends_sha256"])

    for b in batches:
        for o, d, text in zip(*(b.column(x).to_pylist() for x in ("owner", "depth", "text"))):
            if (o, d) == at:
                state.update(b"," + text.encode())
                continue
            if at:
                out.append((*at, state.hexdigest()))
            at, state = (o, d), sha256(text.encode())
        if len(out) >= BATCH:
            yield batch()
    if at:
        out.append((*at, state.hexdigest()))
    if out:
        yield batch()


def end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: of the conversations (owner, depth, conv_id) that end at a node, by rising identifier.

    Range partitions join identifiers to pieces, so that a node where very many end is cut over tasks; the hash itself
    takes a node's pieces in order, one at a time."""
    order = ["owner", "depth", "conv_id"]
    cut = mapped(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), _pieces, "owner long, depth long, first long, text string")
    return mapped(cut.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first"), _hashed, "owner long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, those with one turn by their digests; a null role or text is empty. A null
    conv_id takes no part. Repeated rows are turns of their own. Conversations are rebuilt first: the first h turns of
    the family's own conversation stand for the own first h (h by the identifier's check sum). A conversation that keeps
    no turn is a member of the root. An empty table has no node; other columns are not read."""
    rows = written(_owned(written(prefixes(conversations), "trie-prefixes")), "trie-rows")
    own = F.col("conv_id") == F.col("owner")
    # a path runs through chains: of each, the depths from first to last
    runs = rows.groupBy("conv_id", "owner").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum(F.when(own, (F.col("n_convs") - 1) * F.col("words"))).alias("saved"))
    runs = runs.withColumn("top", F.max(F.when(own, F.col("first"))).over(Window.partitionBy("conv_id"))).filter("top IS NOT NULL")
    runs = written(runs, "trie-runs")
    chains = runs.filter(own).select("conv_id", "top", F.col("last").alias("bottom"), "saved")
    through = runs.filter(~own).select("conv_id", "owner", F.col("last").alias("depth"), (F.col("last") == F.col("top") - 1).alias("parent"))
    branches = through.filter("parent").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("branches"))
    ended = chains.join(branches.withColumnRenamed("depth", "bottom"), ["conv_id", "bottom"], "left")
    chains = written(ended.select("conv_id", "top", "bottom", "saved", F.col("branches").isNull().cast("long").alias("leaf")), "trie-chains")
    hung = through.join(chains.select("conv_id", "saved", "leaf"), "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(
        F.sum("saved").alias("hung_saved"), F.sum("leaf").alias("hung_leaves"), F.count_if("parent").alias("branches")
    )
    parents = through.filter("parent").select("conv_id", F.col("owner").alias("above"))
    chains = chains.join(parents, "conv_id", "left")
    nodes = rows.filter(own).select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").fillna(0, ["hung_saved", "hung_leaves", "branches"]).join(chains.select("conv_id", "top", "bottom", "leaf", "above"), "conv_id")
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        (F.col("branches") + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
        (F.sum("hung_leaves").over(below) + F.col("leaf")).alias("n_leaves"),
        F.sum(F.col("own") + F.col("hung_saved")).over(below).alias("saved_tokens"),
    )
    ends = end_digests(rows.filter("ends")).withColumnRenamed("owner", "conv_id")
    return nodes.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
