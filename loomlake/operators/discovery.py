"""Which columns join with which: distances between profiles, a score, and its ranking. Profiles have one row a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import quoted

# The rule by which two columns differ in each metric of a profile.
RULES = {
    "cardinality": ("subtraction", ["num_rows", "cardinality", "entropy", "uniqueness", "incompleteness"]),
    "distribution": (
        "subtraction",
        ["frequency_avg", "frequency_min", "frequency_max", "frequency_sd", "frequency_iqr", "frequency_skewness", "frequency_kurtosis"]
        + [f"frequency_{k}qo" for k in range(1, 8)]
        + ["val_pct_min", "val_pct_max", "val_pct_sd", "val_pct_avg"],
    ),
    "common values": ("containment", ["freq_word_containment", "freq_word_soundex_containment"]),
    "lengths": ("subtraction", ["len_max_word", "len_min_word", "len_avg_word", "len_max_full", "len_min_full", "len_avg_full"]),
    "word counts": ("subtraction", ["number_words", "words_cnt_max", "words_cnt_min", "words_cnt_avg", "words_cnt_sd"]),
    "boundary": ("edit", ["first_word", "last_word"]),
    "flags": ("subtraction", ["is_empty", "is_binary"]),
    "coverage": ("subtraction", ["top_1_coverage", "top_5_coverage", "top_10_coverage"]),
    "numerical": (
        "subtraction",
        ["values_count", "percentage_negative", "number_zero", "outliers_below_iqr", "outliers_above_iqr", "total_outliers", "percentage_outliers"],
    ),
}
#: Metric -> rule.
REGISTRY = {m: rule for rule, metrics in RULES.values() for m in metrics}

#: Weights of the score: values shared, sounds shared, closeness of cardinality and uniqueness, likeness of names.
WEIGHTS = {"containment": 0.45, "soundex": 0.15, "cardinality": 0.15, "uniqueness": 0.10, "name": 0.15}


def subtraction(a: Column, b: Column) -> Column:
    return F.coalesce(a - b, F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct entries that b has; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def edit(a: Column, b: Column) -> Column:
    """Levenshtein distance; the other's length if one is null, infinite if both are."""
    return F.coalesce(F.levenshtein(a, b).cast("double"), F.length(a).cast("double"), F.length(b).cast("double"), F.lit(float("inf")))


#: Columns of a block: on wide lakes each two blocks meet in a cell of at most about BLOCK by BLOCK pairs.
BLOCK = 1_024
#: Lists of which columns that share an entry are found by an index.
LISTS = ["freq_word_containment", "freq_word_soundex_containment"]


def _sides(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(profiles.select(*[F.col(c).alias(f"{side}_{c}") for c in profiles.columns]) for side in "ab")


def pairs(profiles: DataFrame, blocks: int = 1, bases: DataFrame | None = None) -> DataFrame:
    """Every column with every column of another dataset and the same main type. profiles: dataset, column, main_type,
    cardinality, uniqueness, freq_word_containment, freq_word_soundex_containment, first_word, last_word. bases: the
    profiles of the columns to find candidates for, where not all are.

    As a main type is one key, its pairs are one task's unless columns are dealt to several blocks (by a hash of their
    names): then each column goes to every block of the other side, and each two blocks meet in a cell of their own."""
    a, b = _sides(profiles if bases is None else bases)[0], _sides(profiles)[1]
    match = (F.col("a_main_type") == F.col("b_main_type")) & (F.col("a_dataset") != F.col("b_dataset"))
    if blocks == 1:
        return a.join(b, match)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = lambda side: F.pmod(F.xxhash64(f"{side}_dataset", f"{side}_column"), F.lit(blocks)).cast("int")
    a = a.withColumn("row", own("a")).withColumn("at", every).repartition(blocks * blocks, "row", "at", "a_main_type")
    b = b.withColumn("at", own("b")).withColumn("row", every).repartition(blocks * blocks, "row", "at", "b_main_type")
    return a.join(b.withColumnsRenamed({"row": "b_row", "at": "b_at"}), (F.col("row") == F.col("b_row")) & (F.col("at") == F.col("b_at")) & match).drop("row", "at", "b_row", "b_at")


def related_pairs(profiles: DataFrame, hot: int = BLOCK) -> DataFrame:
    """The rows of pairs() whose columns share a common value or a sound, found by an index from entries to columns, so
    that columns with nothing in common never meet.

    Entries of one dataset alone go first. An entry of more than ``hot`` columns is dealt in parts: each of its columns is
    in one part as a base and in every part as a candidate, so no task holds all pairs of an entry. Null entries do not count."""
    held = [profiles.select("dataset", "column", "main_type", F.lit(n).alias("list"), F.explode(F.array_distinct(n)).alias("entry")) for n in LISTS]
    each = held[0].unionByName(held[1])
    key = ["main_type", "list", "entry"]
    size = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("dataset").alias("least"), F.max("dataset").alias("most"))
    size = size.filter("least < most").select(*key, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    each = each.join(size, key)
    part = F.pmod(F.xxhash64("dataset", "column"), F.col("parts")).cast("int")
    a = each.select(*key, part.alias("part"), F.col("dataset").alias("a_dataset"), F.col("column").alias("a_column"))
    b = each.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("dataset").alias("b_dataset"), F.col("column").alias("b_column"))
    met = a.join(b, [*key, "part"]).filter("a_dataset <> b_dataset").select("a_dataset", "a_column", "b_dataset", "b_column").distinct()
    left, right = _sides(profiles)
    return met.join(left, ["a_dataset", "a_column"]).join(right, ["b_dataset", "b_column"]).select(*left.columns, *right.columns)


def distances(pairs: DataFrame) -> DataFrame:
    c = F.col
    return pairs.select(c("a_dataset").alias("base_dataset"), c("a_column").alias("base_column"), c("b_dataset").alias("candidate_dataset"), c("b_column").alias("candidate_column"), subtraction(c("a_cardinality"), c("b_cardinality")).alias("cardinality"), subtraction(c("a_uniqueness"), c("b_uniqueness")).alias("uniqueness"), (F.least("a_cardinality", "b_cardinality") / F.greatest("a_cardinality", "b_cardinality", F.lit(1))).alias("cardinality_ratio"), containment(c("a_freq_word_containment"), c("b_freq_word_containment")).alias("containment"), containment(c("a_freq_word_soundex_containment"), c("b_freq_word_soundex_containment")).alias("soundex"), edit(c("a_first_word"), c("b_first_word")).alias("first_word"), edit(c("a_last_word"), c("b_last_word")).alias("last_word"), edit(c("a_column"), c("b_column")).alias("name_dist"), F.greatest(F.length("a_column"), F.length("b_column")).alias("name_len"), c("b_uniqueness").alias("candidate_uniqueness"))


def scored(distances: DataFrame) -> DataFrame:
    """The closed-form score, in 0..1."""
    w, c = WEIGHTS, F.col
    score = w["containment"] * c("containment") + w["soundex"] * c("soundex") + w["cardinality"] * c("cardinality_ratio") + w["uniqueness"] * (1 - F.abs("uniqueness")) + w["name"] * (1 - c("name_dist") / c("name_len"))
    return distances.withColumn("score", F.round(score, 6))


def score_bounds() -> tuple[float, float]:
    return 0.0, sum(WEIGHTS.values())


def registered(profiles: DataFrame) -> list[str]:
    """The metrics of the registry that profiles hold, in its order."""
    return [m for m in REGISTRY if m in profiles.columns]


def all_distances(pairs: DataFrame, *more: Column) -> DataFrame:
    """The keys of each pair of columns, ``d_`` and the metric for every registered metric of their profiles, d_name, and more.

    Differences are signed, the base's value less the candidate's, and 0 where either has none."""
    apply = {"subtraction": subtraction, "containment": containment, "edit": edit}
    held = [m for m in REGISTRY if f"a_{m}" in pairs.columns]
    keys = {"base_dataset": "a_dataset", "base_column": "a_column", "candidate_dataset": "b_dataset", "candidate_column": "b_column", "candidate_uniqueness": "b_uniqueness"}
    found = [apply[REGISTRY[m]](F.col(f"a_{m}"), F.col(f"b_{m}")).cast("double").alias(f"d_{m}") for m in held]
    return pairs.select(*[F.col(v).alias(k) for k, v in keys.items()], *found, edit(F.col("a_column"), F.col("b_column")).alias("d_name"), *more)


#: Parts of a column that are taken for a column each when pairs are labelled by themselves: the hash of a row modulo PARTS,
#: and whether each value counts once, as in a table that it is the key of.
PARTS = 8
VARIANTS = {"first": ([0, 1, 2, 3], False), "second": ([4, 5, 6, 7], False), "few": ([7], False), "keys": (list(range(PARTS)), True)}


def split_counts(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Value counts of each column of df in each variant; the column is named ``name``, column and variant, parted by \\x01.

    Rows are dealt by a hash of all their values, so a rerun parts them alike."""
    part = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(PARTS))
    held = F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("value")) for c in columns])
    each = df.select(part.alias("part"), F.explode(held).alias("x")).groupBy("part", "x.c", "x.value").agg(F.count(F.lit(1)).alias("freq"))
    ways = F.array(*[F.struct(F.lit(v).alias("v"), F.array(*map(F.lit, parts)).alias("parts"), F.lit(once).alias("once")) for v, (parts, once) in VARIANTS.items()])
    dealt = each.select("*", F.explode(ways).alias("w")).filter(F.array_contains("w.parts", F.col("part").cast("int")))
    column = F.concat_ws("\x01", F.lit(name), "c", "w.v").alias("column")
    return dealt.groupBy(column, "value", "w.once").agg(F.sum("freq").alias("freq")).select("column", "value", F.when(F.col("once"), 1).otherwise(F.col("freq")).cast("long").alias("freq"))


def labelled_pairs(metrics: DataFrame) -> DataFrame:
    """all_distances of every two variants with label 1 where they are of one column, else 0. metrics: profiles of
    split_counts, one row a variant. A column's own name tells nothing here, so names are not compared."""
    parts = F.split("column", "\x01")
    held = metrics.select(*[c for c in metrics.columns if c != "column"], F.concat_ws("\x01", parts[0], parts[1]).alias("of"), parts[2].alias("dataset"), parts[1].alias("column"), F.lit("").alias("main_type"))
    label = (F.col("a_of") == F.col("b_of")).cast("double").alias("label")
    return all_distances(pairs(held), label).drop("d_name")


def fit_scorer(features: DataFrame, label: str = "label", trees: int = 100):
    """A gradient-boosted tree ensemble over distances (all columns ``d_*``; missing and infinite ones count as given by
    finite()), fitted to 0 and 1. features have a row a pair of columns; they are put in one order, so a rerun agrees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = [c for c in features.columns if c.startswith("d_")]
    boosted = GBTRegressor(labelCol=label, maxIter=trees, stepSize=0.05, maxDepth=3, subsamplingRate=0.8, minInstancesPerNode=10, seed=1, predictionCol="score")
    ordered = finite(features).orderBy(label, *names)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), boosted]).fit(ordered)


def finite(features: DataFrame) -> DataFrame:
    """Distances as the trees take them: none counts as 0, infinity (no value on either side) as -1."""
    held = {c: F.when(F.col(c) == float("inf"), -1.0).otherwise(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))) for c in features.columns if c.startswith("d_")}
    return features.withColumns(held)


def learned(model, distances: DataFrame) -> DataFrame:
    """distances (of all_distances) with the fitted scorer's score; distances that it was not fitted on are not read."""
    return model.transform(finite(distances)).drop("features").withColumn("score", F.round("score", 6))


def model_bounds(model) -> tuple[float, float]:
    """The least and the greatest score that the ensemble can give: the sum over its trees of their extreme leaves."""
    boosted = model.stages[-1]

    def leaves(node):
        todo = [node]
        while todo:
            n = todo.pop()
            if n.getClass().getSimpleName() == "LeafNode":
                yield n.prediction()
            else:
                todo += [n.leftChild(), n.rightChild()]

    low = high = 0.0
    for tree, weight in zip(boosted.trees, boosted.treeWeights):
        held = [weight * x for x in leaves(tree._call_java("rootNode"))]
        low, high = low + min(held), high + max(held)
    return low, high


def ranked(scores: DataFrame) -> DataFrame:
    """rank of each candidate of a base column, best first, ties by name."""
    w = Window.partitionBy("base_dataset", "base_column").orderBy(F.desc("score"), "candidate_dataset", "candidate_column")
    return scores.withColumn("rank", F.row_number().over(w))


def best_per_dataset(scores: DataFrame, threshold: float = 0.001, uniqueness: float = 0.0, top: int | None = 4) -> DataFrame:
    """The best column pair of each base and candidate dataset above the threshold, and of those the best ``top`` of a base."""
    held = scores.filter((F.col("score") >= threshold) & (F.col("candidate_uniqueness") >= uniqueness))
    rest = [c for c in held.columns if c not in ("base_dataset", "candidate_dataset", "candidate_column", "base_column")]
    order = F.struct((-F.col("score")).alias("less"), "candidate_column", "base_column", F.struct(*rest).alias("rest"))
    best = held.groupBy("base_dataset", "candidate_dataset").agg(F.min(order).alias("x"))  # pairs meet their best where they are made
    held = best.select("base_dataset", "x.base_column", "candidate_dataset", "x.candidate_column", "x.rest.*").select(*held.columns)
    order = Window.partitionBy("base_dataset").orderBy(F.desc("score"), "candidate_dataset")
    held = held.withColumn("rank", F.row_number().over(order))
    return held.filter(F.col("rank") <= top) if top else held


def unique_bases(edges: DataFrame, row_counts: DataFrame) -> DataFrame:
    """base_dataset, members, row_count, duplicate_of: bases with one set of datasets and one row count are made once."""
    held = edges.groupBy("base_dataset").agg(F.collect_set("candidate_dataset").alias("c")).join(row_counts, "base_dataset")
    held = held.select("base_dataset", "row_count", F.array_join(F.array_sort(F.array_union("c", F.array("base_dataset"))), "+").alias("members"))
    first = F.min("base_dataset").over(Window.partitionBy("members", "row_count"))
    return held.withColumn("duplicate_of", F.when(first != F.col("base_dataset"), first))
