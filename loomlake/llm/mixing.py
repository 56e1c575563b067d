"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions only.

Targets: the sources' weights share the size of the whole, no target exceeds ``cap`` times its source, and what is over goes
to the others by weight. Copies: every document has an expected number of copies, in proportion to its merit (the share of
its words that are distinct, so a text that repeats itself is repeated less) and at most ``cap``, so that the expected
sizes of a source sum to its target. Whole copies are certain. What is left of the expectation is the probability of one
copy more, and these are drawn by Pareto order: documents are ranked by random odds over inclusion odds, and are taken in
that order as long as they fit into what the target still lacks. So the sample's size is fixed, in words, and
probabilities differ from document to document.

A source may hold most rows: ranks are never sorted whole. Sizes are summed in fine buckets of the rank, the bucket where a
source is full is sorted, and a cut is all that is kept. Documents that did not fit are passed over by the next round, which
goes on with the smaller room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import bounded, placed, word_count, written

#: Weights of the sources in order, repeating; copies of a document and size of a source at most; steps of merit; rounds of
#: filling at most, and the share of a source (one in so much) that may stay open without another one.
WEIGHTS, CAP, MERITS, ROUNDS, SLACK = (5, 2, 1), 3, 16, 6, 500
#: Hexadecimal digits of a random number; rows of a table that is broadcast at most.
DIGITS, SMALL = 13, 100_000


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on key alone: the first 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def items(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (words), merit (1 to MERITS) and u (its random number) of every document."""
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    held = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words).cast("long").alias("size"), F.size(F.array_distinct(words)).cast("long").alias("n"), uniform(key).alias("u"))
    return held.select("doc_id", "source", "size", F.when(F.col("size") > 0, F.expr(f"({MERITS} * n + size - 1) div size")).otherwise(1).cast("int").alias("merit"), "u")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target. Weights go by the place of a source, nulls last.

    The share of a unit of weight grows until no target is above its cap; each round is one aggregate."""
    order = placed(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    order = order.select("source", "source_size", weight.alias("weight"))
    top = F.col("source_size") * cap
    total, unit, full = order.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        over = F.col("weight") * F.lit(unit) > top
        capped, held, rest = order.agg(F.count_if(over), F.sum(F.when(over, top)), F.sum(F.when(~over, F.col("weight")))).first()
        if capped == full or not rest:
            break
        full, unit = capped, (total - (held or 0)) / rest
    return order.select("source", "source_size", F.least(top.cast("double"), F.col("weight") * F.lit(unit)).alias("target"))


def expected(levels: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """source, merit, whole, odds, room, slack: certain copies of a document, its probability of one more, the words that a
    source's certain copies leave open, and how many may stay so. levels: source, merit, words, a row for each step of merit."""
    arrays = levels.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("merit", "words")), asc=False).alias("levels"))  # MERITS entries at most
    held = arrays.join(bounded(goals), F.col("source").eqNullSafe(F.col("_source"))).select("source", "levels", "target", "source_size")
    mass = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["merit"] * x["words"])
    start = F.struct(F.lit(0).cast("long").alias("capped"), mass.alias("mass"), (F.col("target") / F.nullif(mass, F.lit(0).cast("long"))).alias("k"))

    def step(a: Column, x: Column) -> Column:
        """The richest merit is capped as long as it would get more than cap; k is for those below."""
        capped, left = a["capped"] + x["words"], a["mass"] - x["merit"] * x["words"]
        after = F.struct(capped.alias("capped"), left.alias("mass"), ((F.col("target") - cap * capped) / F.nullif(left, F.lit(0).cast("long"))).alias("k"))
        return F.when(a["k"] * x["merit"] > cap, after).otherwise(a)

    k = F.coalesce(F.aggregate("levels", start, step)["k"], F.lit(float("inf")))
    each = held.select("source", "target", "source_size", "levels", k.alias("k")).select("source", "target", "source_size", F.transform("levels", lambda x: F.struct(x["merit"].alias("merit"), x["words"].alias("words"), F.least(F.lit(float(cap)), F.col("k") * x["merit"]).alias("e"))).alias("levels"))
    certain = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.floor(x["e"]) * x["words"])
    room = F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") + 0.5) - certain)
    each = each.select("source", room.alias("room"), F.expr(f"source_size div {SLACK}").alias("slack"), F.explode("levels").alias("x"))
    return each.select("source", "room", "slack", "x.merit", F.floor("x.e").cast("int").alias("whole"), (F.col("x.e") - F.floor("x.e")).alias("odds"))


def _chosen(cuts: str) -> Column:
    """Whether an earlier round took the item: it had room for it, and its rank is below the cut."""
    return F.exists(cuts, lambda c: (F.col("size") <= c["room"]) & (F.col("rank") < c["cut"]))


def fill(pool: DataFrame, rooms: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """source, cuts: what Pareto order takes of pool (source, size, rank in 0 to 2) to fill rooms (source, room, slack).

    cuts has a (room, cut) for each round: an item of that room at most and a rank below the cut is taken. A round takes
    items in order up to the first that is too large; the next one passes over all too large for what is left, until no source has more room than its slack."""
    buckets = max(1 << 10, min(1 << 20, 1 << (pool.count().bit_length() // 2 + 2)))
    state = written(rooms.select("source", "room", "slack", F.array().cast("array<struct<room:long,cut:double>>").alias("cuts")), "mix-cuts")
    small = F.broadcast if state.limit(SMALL + 1).count() <= SMALL else lambda df: df  # tables with a row a source
    items_of = lambda s: pool.join(small(s.select(F.col("source").alias("_s"), "room", "cuts")), F.col("source").eqNullSafe(F.col("_s"))).filter((F.col("size") <= F.col("room")) & ~_chosen("cuts")).withColumn("bucket", F.floor(F.col("rank") * (buckets / 2)))
    upto = lambda order: Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(rounds):
        open_items = items_of(state)
        sums = open_items.groupBy("source", "room", "bucket").agg(F.sum("size").alias("words")).withColumn("sum", F.sum("words").over(upto("bucket")))
        edges = sums.groupBy("source", "room").agg(F.min(F.when(F.col("sum") > F.col("room"), F.struct("bucket", (F.col("sum") - F.col("words")).alias("before")))).alias("edge"), F.max(F.when(F.col("sum") <= F.col("room"), F.col("sum"))).alias("taken"))
        edges = written(edges, "mix-edges")
        full = small(edges.filter("edge IS NOT NULL").select(F.col("source").alias("_e"), F.col("edge.bucket").alias("_b"), F.col("edge.before").alias("before")))
        last = open_items.join(full, F.col("source").eqNullSafe(F.col("_e")) & (F.col("bucket") == F.col("_b")))
        last = last.groupBy("source", "room", "before", "rank").agg(F.sum("size").alias("words")).withColumn("sum", F.col("before") + F.sum("words").over(upto("rank")))
        ends = last.groupBy("source").agg(F.min(F.when(F.col("sum") > F.col("room"), F.col("rank"))).alias("cut"), F.max(F.when(F.col("sum") <= F.col("room"), F.col("sum"))).alias("reached"))
        found = edges.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        found = found.select(F.col("source").alias("_s"), F.coalesce("cut", F.lit(3.0)).alias("cut"), F.coalesce("reached", "taken", F.lit(0)).alias("got"))
        more = F.concat("cuts", F.when(F.col("cut").isNotNull(), F.array(F.struct("room", "cut"))).otherwise(F.array().cast("array<struct<room:long,cut:double>>")))
        after = state.drop("got").join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
        state = written(after.select("source", "slack", (F.col("room") - F.coalesce("got", F.lit(0))).alias("room"), more.alias("cuts"), F.coalesce("got", F.lit(0)).alias("got")), "mix-cuts")
        if not all(state.agg(F.max("got"), F.count_if(F.col("room") > F.col("slack"))).first()):
            break
    return state.select("source", "cuts")


def mix_documents(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every row of documents.

    A null text has no words and is never drawn, though certain copies of it count. A null source is a source of its own,
    the last. A source without words has target 0. Rows alike in source, doc_id and text share a random number: they are drawn
    together or not at all. One document that is larger than the room left is passed over, so a source of few large
    documents may stay below its target. An empty table has no row; other columns are not read. Reruns agree, however the
    rows are partitioned."""
    held = written(items(documents, text), "mix-items")
    sources = held.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sources, weights, cap).withColumnRenamed("source", "_source"), "mix-targets")
    plan = written(expected(held.groupBy("source", "merit").agg(F.sum("size").alias("words")), goals, cap), "mix-plan")
    p = bounded(plan.select(F.col("source").alias("_p"), F.col("merit").alias("_m"), "whole", "odds"))
    u, o = F.col("u"), F.col("odds")
    rank = F.when(o > 0, u * (1 - o) / (u * (1 - o) + o * (1 - u))).otherwise(1 + u)  # odds / (1 + odds): the same order
    drawn = held.join(p, F.col("source").eqNullSafe(F.col("_p")) & (F.col("merit") == F.col("_m"))).select("doc_id", "source", "size", "whole", rank.alias("rank"))
    drawn = written(drawn, "mix-ranks")
    cuts = fill(drawn.filter((F.col("size") > 0) & (F.col("whole") < cap)).select("source", "size", "rank"), plan.select("source", "room", "slack").distinct())
    more = drawn.join(bounded(cuts.withColumnRenamed("source", "_c")), F.col("source").eqNullSafe(F.col("_c"))).join(bounded(goals), F.col("source").eqNullSafe(F.col("_source")))
    extra = ((F.col("size") > 0) & (F.col("whole") < cap) & _chosen("cuts")).cast("int")
    return more.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra)).alias("taken"), (F.col("whole") + extra).alias("copies"), "source")


def repeated(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: rows of documents, each as often as mixed (doc_id unique) says."""
    often = mixed.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.sequence(F.lit(1), F.col("copies")).alias("_copies"))
    return documents.join(often, F.col("doc_id") == F.col("_id")).select(*documents.columns, F.explode("_copies").alias("_copy")).drop("_copy")
