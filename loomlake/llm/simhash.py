"""Near-duplicates by SimHash with meet-in-the-middle ball hashing.

A fingerprint emits all its variants within half the radius; two fingerprints within the radius share a variant. A
variant table would be thousands of times the fingerprints, so variants are shuffled by a prefix of theirs, unmade: a
fingerprint is sent once to each prefix that its variants can have, and the task of that prefix makes the variants that
have it, in numpy, part by part where they are many. The prefix bits are the most evenly split ones, so that clusters
of close fingerprints part. Fingerprints that share a variant are linked to one hub of them and each to the next, not all to
all (any two are within the radius of each other, so components lose nothing); each link is verified. Components follow from
the links, in Spark.

Wide fingerprints (several blocks) find candidates in any block; a bound on all bits clears chance collisions out, and
what is left is linked if the Jaccard similarity of the shingle sets themselves is 0.8 or more. Owners of one block's
variant need not be near on all bits, so links to hubs alone would lose pairs there. So the blocks are taken in rounds.
The first two link to hubs: links within a loose bound make up families, those that pass the exact test make up groups.
The third takes all blocks again and compares each owner of a variant with every other that is not of its family: one by
one, or, where the pairs of a variant are too many for one task, in blocks of owners dealt over tasks. Within a family,
every two nodes of different groups are compared on all bits, in such blocks too, and only those within the bound come
out, so a large family whose members are no near-duplicates of each other makes no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, ship, written
from .components import components

#: Variants made at once in a task; fewest prefix bits and most.
AT_ONCE, LEAST_BITS, MOST_BITS = 4_000_000, 8, 26
#: Pairs of a variant that one task lists at most; nodes in a block of a larger variant or of a family.
LISTED, SALTED = 1_000_000, 1_024
#: The wide form has 2048 bits, of which the blocks take the first 1024. A similarity (Jaccard, of sets of 5-word shingles)
#: of 0.8 is an expected 310 differing bits, with a deviation of 16.3; WIDE_DISTANCE is 3.5 deviations more. For fewer than
#: FEW_SHINGLES the expectation is higher (384 and 18 for sets of four and five, the worst case), and LOOSE is 8 deviations
#: more; it also bounds a family's links. Unrelated sets differ in 1024, with a deviation of 23.
WIDE_BITS, WIDE_DISTANCE, LOOSE, FEW_SHINGLES = 2_048, 367, 530, 32
#: Blocks of a wide fingerprint, by the number of nodes: (nodes at most, bits of a block, radius, blocks). Pairs at a
#: similarity of 0.8 collide in one with a probability of 0.98 or more. Wider blocks, which overlap, keep chance collisions
#: few where nodes are many.
SHAPES = [(1 << 27, 32, 2, 32), (1 << 62, 48, 4, 41)]
#: Bits of the map of the texts whose shingle sets are wanted: of one size at every size of the input.
MAP_BITS = 1 << 23
#: Blocks of the first round that links to hubs; the second takes the others.
FIRST = 4

_ODD = (np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words joined by spaces; of all words if they are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last)]), ">u8").astype(np.uint64)


def _majority(n_bits: int, rows: np.ndarray) -> np.ndarray:
    """Which bits are set in over half the rows; rows: bytes of little-endian words."""
    total = np.zeros(n_bits, np.int64)
    for at in range(0, len(rows), 255):
        total += np.unpackbits(rows[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(rows), bitorder="little")


def fingerprint(text: bytes | None, size: int) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes, repeats counted."""
    hashes = shingle_hashes(text, size)
    return int(_majority(64, hashes.view(np.uint8).reshape(-1, 8)).view("<u8")[0]) if len(hashes) else 0


def wide_fingerprint(text: bytes | None, size: int) -> bytes:
    """WIDE_BITS bits over the set of shingles: each hash is mixed into as many words as that takes."""
    return wide_value(np.unique(shingle_hashes(text, size)))


def wide_value(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(WIDE_BITS // 8)
    total = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def block_words(values: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """values (nodes x bytes) -> nodes x blocks words of ``bits``: evenly spread runs of the first 1024 bits, whole
    bytes, which lie side by side if they fit and overlap if not."""
    step, size = 128 // blocks if bits * blocks <= 1024 else (128 - bits // 8) // (blocks - 1), bits // 8
    out = np.zeros((len(values), blocks, 8), np.uint8)
    for j in range(blocks):
        out[:, j, :size] = values[:, j * step : j * step + size]
    return out.view("<u8")[:, :, 0].astype(np.uint64)


def _masks(positions: list[int], flips: int) -> np.ndarray:
    """All words with at most so many bits set, all at the given positions."""
    out = [0]
    for n in range(1, flips + 1):
        out += [sum(1 << p for p in c) for c in combinations(positions, n)]
    return np.array(out, np.uint64)


def _compact(values: np.ndarray, positions: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i, p in enumerate(positions):
        out |= ((values >> np.uint64(p)) & np.uint64(1)).astype(np.int64) << i
    return out


def _hubs(i: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The owners (who) of each variant (i) in order, each one's hub, and how many others the hub meets.

    The hub of a variant's owners is the one that meets most others over all its variants: in a cluster of copies, the
    text they were made from."""
    met = np.bincount(i)
    reach = np.bincount(who, weights=met[i], minlength=int(who.max()) + 1)
    order = np.lexsort((who, -reach[who], i))
    i, who = i[order], who[order]
    first = np.concatenate(([True], i[1:] != i[:-1]))
    hub = who[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
    return who, hub, reach[hub], first


def _to_hub(i: np.ndarray, who: np.ndarray) -> list[np.ndarray]:
    """Pairs of hub and owner, for each variant that the owner has, and of each owner and the next one."""
    who, hub, _, first = _hubs(i, who)
    beside = who[:-1][~first[1:]], who[1:][~first[1:]]
    pairs = np.concatenate((np.stack((hub[~first], who[~first]), 1), np.stack(beside, 1)))
    return [np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)]


def _to_best_hub(i: np.ndarray, who: np.ndarray) -> list[np.ndarray]:
    """One pair for each owner, with the hub that meets most others among those of its variants."""
    who, hub, reach, _ = _hubs(i, who)
    order = np.lexsort((hub, -reach, who))
    who, hub = who[order], hub[order]
    first = np.concatenate(([True], who[1:] != who[:-1])) & (who != hub)
    return [np.unique(np.sort(np.stack((hub[first], who[first]), 1), axis=1), axis=0)]


class _Across:
    """All pairs of the owners of each variant whose roots differ; ``large``: sets of owners that have too many pairs."""

    def __init__(self, root: np.ndarray):
        self.root, self.large, self.seen = np.unique(root, return_inverse=True)[1], {}, set()

    def __call__(self, i: np.ndarray, who: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((who, self.root[who], i))
        i, who = i[order], who[order]
        root, begin = self.root[who], np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        end = np.append(begin[1:], len(i))
        mixed = root[begin] != root[end - 1]
        small = mixed & (end - begin <= 16)
        out = []
        for a, b in zip(begin[mixed & ~small].tolist(), end[mixed & ~small].tolist()):
            name = xxhash.xxh3_128_digest(np.sort(who[a:b]).tobytes())
            if name in self.seen:  # neighbouring variants have the same owners
                continue
            self.seen.add(name)
            cut = np.append(np.flatnonzero(np.diff(root[a:b], prepend=-1)), b - a)  # where the roots of the set begin
            if ((b - a) ** 2 - int((np.diff(cut) ** 2).sum())) // 2 > LISTED:
                self.large[name] = who[a:b]
                continue
            rest = (b - a) - np.repeat(cut[1:], np.diff(cut))  # owners after those of one's root
            left = np.repeat(np.arange(a, b), rest)
            right = np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest) + np.repeat(b - rest, rest)
            out = self._add(out, who[left], who[right])
        held = np.repeat(small, end - begin)
        i, who = i[held], who[held]
        for step in range(1, 16):
            at = np.flatnonzero(i[step:] == i[:-step]) if len(i) > step else []
            if not len(at):
                break
            apart = at[self.root[who[at]] != self.root[who[at + step]]]
            out = self._add(out, who[apart], who[apart + step])
        return out

    def _add(self, out: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        out = [*out, np.stack((np.minimum(a, b), np.maximum(a, b)), 1)]
        return [np.unique(np.concatenate(out), axis=0)] if sum(map(len, out)) > 2 * max(LISTED, len(out[0])) else out


def _collide(values: np.ndarray, spent: np.ndarray, owner: np.ndarray, free: list[int], flips: int, paired=_to_hub) -> list[np.ndarray]:
    """Pairs, as ``paired`` makes them, of the owners that share a variant.

    values: with the prefix already turned; spent: flips used for that; free: positions that may still turn."""
    work = sum(int((spent == s).sum()) * len(_masks(free, flips - s)) for s in range(flips + 1)) if len(values) * len(free) ** flips > AT_ONCE else 0
    if work > AT_ONCE and free:
        cut, rest, out = free[:2], free[2:], []
        for turn in range(1 << len(cut)):  # the variants with each setting of two more bits, by themselves
            off = _compact(values, cut) ^ turn
            cost = spent + np.bitwise_count(off.astype(np.uint64)).astype(spent.dtype)
            able = cost <= flips
            if able.sum() > 1:
                clear = values[able] & ~np.uint64(sum(1 << p for p in cut))
                out += _collide(clear, cost[able], owner[able], rest, flips, paired)
        return out
    made, who = [], []
    for s in range(flips + 1):
        here = np.flatnonzero(spent == s)
        if len(here):
            m = _masks(free, flips - s)
            made.append((values[here][:, None] ^ m).ravel())
            who.append(np.repeat(here, len(m)))
    if not made:
        return []
    made, who = np.concatenate(made), np.concatenate(who)
    ordered = np.sort(made)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return []
    i = np.minimum(np.searchsorted(shared, made), len(shared) - 1)
    hit = shared[i] == made
    return paired(i[hit], owner[who[hit]])


def ball_links(nodes: DataFrame, bits: int, radius: int, blocks: int = 1, verify: bool = True, part: range | None = None, hubs: bool = True, n: int | None = None) -> DataFrame:
    """nodes (node long, value binary, all distinct) -> links (a, b). n: how many nodes there are, where that is known.

    With one block, values are words of ``bits``, and any two nodes within ``radius`` differing bits are joined by links of
    that kind. With several, values are wide fingerprints, and two nodes within ``radius`` in any block (any of ``part``, if
    given) are joined by links, as candidates. Where nodes has a column root, nodes of one root are known to be connected
    and get no link. nodes is read twice: pass a written table.

    Unless ``hubs``, every two nodes that are within ``radius`` in a block and not known to be connected get a link
    themselves. Rows of variants with too many pairs have a set of nodes (its name, by twos) and a place in it instead:
    (a, null, set, other, place, size); see salted()."""
    ship(nodes.sparkSession)
    part, carried = part or range(blocks), ["node", "root"] if "root" in nodes.columns else ["node"]
    flips = radius // 2
    n = max(1, nodes.count() if n is None else n)
    a_node = len(_masks(list(range(bits)), flips))
    k = min(MOST_BITS, max(LEAST_BITS if blocks == 1 else 3, (n * a_node // AT_ONCE).bit_length()))

    def split(batch) -> np.ndarray:
        v = np.frombuffer(b"".join(batch.column("value").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return block_words(v, bits, blocks) if blocks > 1 else v.view(f"<u{bits // 8}").astype(np.uint64)

    def sums(batches):
        for b in batches:
            each = np.unpackbits(split(b).view(np.uint8).reshape(b.num_rows, blocks, 8), axis=2, bitorder="little")[:, :, :bits]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * blocks)), pa.array(each.sum(0, dtype=np.int64).ravel())], ["bit", "ones"])

    # A row a bit, not a column a bit: a plan of a thousand aggregates takes longer to compile than to run.
    ones = dict(mapped(nodes.select("value"), sums, "bit long, ones long").groupBy("bit").agg(F.sum("ones")).collect())
    even = [sorted(range(bits), key=lambda p: (abs(ones.get(j * bits + p, 0) / n - 0.5), p)) for j in range(blocks)]
    prefix, free = [x[:k] for x in even], [x[k:] for x in even]
    turns = [_masks(list(range(k)), flips).astype(np.int64) for _ in range(1)][0]

    def route(batches):
        for b in batches:
            v = split(b)
            held = [np.repeat(b.column(c).to_numpy(), len(turns)) for c in carried]
            for j in part:
                to = (_compact(v[:, j], prefix[j])[:, None] ^ turns).ravel() + (j << k)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.repeat(np.ascontiguousarray(v[:, j]).view(np.int64), len(turns))), *map(pa.array, held)], ["at", "v", *carried])

    kind = "a long, b long" if hubs else "a long, b long, set long, other long, place long, size long"

    def meet(key, held):
        j, bucket = key[0].as_py() >> k, key[0].as_py() & ((1 << k) - 1)
        held = held.sort_by("node")  # hubs go by this order, so the links do not hang on how rows arrive
        v, node = held.column("v").to_numpy().view(np.uint64), held.column("node").to_numpy()
        root = held.column(carried[-1]).to_numpy()
        if (root == root[0]).all():
            return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in kind.split(", ")})
        paired = _Across(root) if not hubs else _to_hub if blocks == 1 else _to_best_hub
        off = np.bitwise_count((_compact(v, prefix[j]) ^ bucket).astype(np.uint64)).astype(np.int8)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *_collide(v & ~np.uint64(sum(1 << p for p in prefix[j])), off, np.arange(len(v)), free[j], flips, paired)])
        if len(pairs):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
            if verify:
                pairs = pairs[np.bitwise_count(v[pairs[:, 0]] ^ v[pairs[:, 1]]) <= radius]
        if hubs:
            return pa.table({"a": pa.array(node[pairs[:, 0]], pa.int64()), "b": pa.array(node[pairs[:, 1]], pa.int64())})
        rows = [(node[pairs[:, 0]], node[pairs[:, 1]], *[np.zeros(len(pairs), np.int64)] * 4)]
        for who in paired.large.values():
            own = np.sort(node[who])
            name = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
            rows.append((own, np.zeros(len(own), np.int64), np.full(len(own), name[0]), np.full(len(own), name[1]), np.arange(len(own)), np.full(len(own), len(own))))
        cols = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)]
        cols[1] = pc.if_else(pc.equal(cols[5], 0), cols[1], pa.scalar(None, pa.int64()))
        return pa.table(dict(zip(["a", "b", "set", "other", "place", "size"], cols)))

    return mapped(nodes.select(*carried, "value"), route, "at long, v long, " + ", ".join(f"{c} long" for c in carried)).groupBy("at").applyInArrow(meet, kind)


def within(x: np.ndarray, y: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which rows of the wide values x and y (as words) are within the bound; few: where a set has few shingles."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= np.where(few, LOOSE, WIDE_DISTANCE)


def salted(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, k, l) of the nodes of each set that are within the bound on all bits, of like sizes, and not of one root.

    sets (a, set, other, place, size); nodes (node, key, value, n, root). A set is cut into blocks of its nodes, and each two
    blocks meet in a task of their own."""
    block, blocks = F.floor(F.col("place") / SALTED), F.floor((F.col("size") - 1) / SALTED) + 1
    cells = sets.select(F.col("a").alias("node"), "set", "other", block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("with"))
    cells = cells.join(nodes.select("node", "key", "value", "n", "root"), "node").select("node", "key", "value", "n", "root", "set", "other", "own", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"))

    def meet(key, held):
        held = held.sort_by("node")
        own, first = held.column("own").to_numpy(), key[2].as_py()
        value = np.frombuffer(b"".join(held.column("value").to_pylist()), np.uint64).reshape(len(own), -1)
        node, key_of, root, n = (held.column(c).to_numpy() for c in ("node", "key", "root", "n"))
        same = key[2] == key[3]
        left, right = np.flatnonzero(own == first), np.arange(len(own)) if same else np.flatnonzero(own != first)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left:
            other = right[right > x] if same else right
            other = other[(root[other] != root[x]) & (5 * np.minimum(n[other], n[x]) >= 4 * np.maximum(n[other], n[x]))]
            near = other[within(value[other], value[x], np.minimum(n[other], n[x]) < FEW_SHINGLES)]
            a.append(np.full(len(near), x))
            b.append(near)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip("abkl", (node[a], node[b], key_of[a], key_of[b]))})

    return cells.groupBy("set", "other", "one", "two").applyInArrow(meet, "a long, b long, k long, l long")


def mixed_families(nodes: DataFrame, family: DataFrame) -> DataFrame:
    """The families (node, root: the family's name) that hold several roots of nodes, as salted() takes sets.

    Nodes are dealt to a set's blocks by a hash, so no task holds a set."""
    held = family.select("node", F.col("root").alias("set")).join(nodes.select("node", "root"), "node")
    sizes = held.groupBy("set").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    block = F.pmod(F.xxhash64("node"), F.floor((F.col("size") - 1) / SALTED) + 1)
    held = held.join(sizes.filter("low < high"), "set")
    return held.select(F.col("node").alias("a"), "set", F.lit(0).cast("long").alias("other"), (block * SALTED).alias("place"), "size")


def fingerprints(documents: DataFrame, size: int, wide: bool = False, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id), ``value``, the fingerprint's bytes (words little-endian), and ``node``, 64 bits that
    stand for it (the fingerprint itself) or, in the wide form, for the set of shingles, of every row; in the wide form
    also ``n``, the size of the set."""
    carry = carry or ["doc_id"]

    def run(batches):
        for b in batches:
            texts = b.column("__text").to_pylist()
            if wide:
                sets = [np.unique(shingle_hashes(x, size)) for x in texts]
                value, names = [wide_value(x) for x in sets], [xxhash.xxh64_digest(x.tobytes()) for x in sets]
            else:
                value = names = [fingerprint(x, size).to_bytes(8, "little") for x in texts]
            node = np.frombuffer(b"".join(names), "<i8")
            sizes = [pa.array([len(x) for x in sets], pa.int32())] if wide else []
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(value, pa.binary()), pa.array(node), *sizes], [*carry, "value", "node", *["n"] * wide])

    kept = documents.select(*carry, F.col(text).cast("binary").alias("__text"))
    kinds = dict(kept.dtypes)
    return mapped(kept, run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", value binary, node long" + ", n int" * wide)


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) for all nodes."""
    found = components(links)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def simhash_components(documents: DataFrame, size: int = 4, radius: int = 4, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most ``radius`` bits. A text with
    fewer words than ``size`` is one shingle; null, empty and blank texts have fingerprint zero, linked like any other.
    A null doc_id is no candidate for component_id (null only where a component has no other). Repeated rows are all returned."""
    docs = written(fingerprints(documents, size, text=text), "fingerprints")
    nodes = written(docs.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("value").alias("value")), "nodes")
    roots = _roots(nodes, ball_links(nodes, 64, radius)).join(nodes, "node")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.select("node", "root").join(least, "root").select("node", "component_id")
    return docs.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(held: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(key, set array<long>, the distinct hashes of the shingles) of the rows of held (key, t) whose key is in keys.

    A bit map of the keys, of a fixed size, keeps most other texts from being read; the join drops the rest."""
    at = F.pmod("key", F.lit(MAP_BITS))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 32, np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)

    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            where = key % MAP_BITS
            b = b.filter(pa.array((bits[where >> 5] >> (where & 31).astype(np.uint32) & 1).astype(bool)))
            texts = b.column("t")
            for start in range(0, b.num_rows, 256):
                sets = [np.unique(shingle_hashes(x, size)).view(np.int64) for x in texts.slice(start, 256).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(start, 256), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["key", "set"])

    found = mapped(held.select("key", F.col("t").cast("binary").alias("t")), run, "key long, set array<long>")
    return found.join(keys.select("key").distinct().hint("merge"), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set"))


def keep_first(documents: DataFrame, size: int = 5, text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the least doc_id.

    Wide fingerprints find the rows to compare, and the sets of their shingles are compared. Columns are those of documents.
    A text with fewer words than a shingle is one shingle of all its words. Of rows alike in doc_id and text one stays; rows
    with null doc_id come after others; null, empty and blank texts are one group. An empty table stays empty."""
    spark, key = documents.sparkSession, F.xxhash64(F.lit(1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    held = documents.select(F.struct(*documents.columns).alias("row"), key.alias("key"), F.col("doc_id"), F.col(text).alias("t"))
    docs = written(fingerprints(held, size, wide=True, text="t", carry=["doc_id", "key"]), "wide")
    nodes = written(docs.groupBy("node").agg(F.first("value").alias("value"), F.min("key").alias("key"), F.first("n").alias("n")), "nodes")
    one, other = (nodes.select(F.col("node").alias(i), F.col("value").alias(v), F.col("key").alias(k), F.col("n").alias(n)) for i, v, k, n in ("axkp", "bylq"))
    count = nodes.count()
    _, bits, radius, blocks = next(shape for shape in SHAPES if count <= shape[0])

    def compared(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in "xy")
            p, q = (b.column(c).to_numpy().astype(np.int64) for c in "pq")
            d = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            near = (d <= np.where(np.minimum(p, q) < FEW_SHINGLES, LOOSE, WIDE_DISTANCE)) & (5 * np.minimum(p, q) >= 4 * np.maximum(p, q))
            columns = [*map(b.column, "abkl"), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, [*"abkl", "near"]).filter(pa.array(d <= LOOSE))

    def measured(pairs: DataFrame) -> DataFrame:
        """The pairs within the loose bound, with their keys, and whether they are within the narrower one."""
        joined = pairs.join(one, "a").join(other, "b").select(*"abklxypq")
        return written(mapped(joined, compared, "a long, b long, k long, l long, near boolean"), "pairs")

    def alike(pairs: DataFrame) -> DataFrame:
        sets = written(shingle_sets(held, pairs.select(F.col("k").alias("key")).union(pairs.select("l")), size), "sets")
        both = pairs.join(sets.select(F.col("key").alias("k"), F.col("set").alias("x")).hint("merge"), "k").join(sets.select(F.col("key").alias("l"), F.col("set").alias("y")).hint("merge"), "l")
        # In whole numbers, shared / (x + y - shared) >= 4 / 5.
        return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")

    def grouped(links: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is not None:
            links = links.union(roots.filter("node <> root").select("node", "root"))
        return written(_roots(nodes, links), "roots")

    roots, loose = None, []
    for part in (range(FIRST), range(FIRST, blocks)):
        at = nodes if roots is None else written(nodes.join(roots, "node"), "rooted")
        loose.append(measured(ball_links(at, bits, radius, blocks, verify=False, part=part, n=count).distinct()))
        roots = grouped(alike(loose[-1].filter("near").drop("near")), roots)
    rooted = written(nodes.join(roots, "node"), "rooted")
    known = loose[0].select("a", "b").union(loose[1].select("a", "b")).union(roots.filter("node <> root").select("node", "root"))
    family = written(_roots(nodes, known), "families")
    apart = written(nodes.join(family, "node"), "apart")
    found = written(ball_links(apart, bits, radius, blocks, verify=False, hubs=False, n=count).distinct(), "candidates")
    pairs = measured(found.filter("b IS NOT NULL").select("a", "b")).filter("near").drop("near")
    pairs = pairs.union(salted(mixed_families(rooted, family), rooted))
    crowded = found.filter("b IS NULL").drop("b")
    if not crowded.isEmpty():
        pairs = pairs.union(salted(crowded, rooted).distinct())
    roots = grouped(alike(written(pairs, "last-pairs")), roots)
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    # Copies share one fingerprint, so the first pass leaves one row a fingerprint, with the number of rows like it.
    same = docs.groupBy("node", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct(rank.alias("rank"), F.col("n"))).alias("first"))
    winners = written(same.join(roots, "node").groupBy("root").agg(F.min("first").alias("first")).select("first.rank.key", "first.n"), "winners")
    # The winners grow with the input, so they are never broadcast: a merge join at every size.
    kept = held.join(winners.hint("merge"), "key", "left_semi").select("row", "key")
    again = winners.filter("n > 1").select("key")
    if not again.isEmpty():
        single = kept.join(again, "key", "left_anti")
        kept = single.unionByName(kept.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row", "key"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
