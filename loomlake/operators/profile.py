"""Column profiles. Everything that depends on values' frequencies comes from one table of value counts: one scan of
the input, one shuffle with map-side combining, whatever the number of columns and metrics."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import BOOLEANS, is_date, is_prose, looks_like_list, quoted, word_count
from .quality import column_flags, dataset_flags

# Sizes of the profile.
TOP, CATEGORIES, SAMPLES = 10, 20, 3
#: Steps of an octave by which values are ordered before they are counted one by one.
STEPS = 4_096
#: Hashes of repeated rows that are sent to all tasks, at most.
FEW_HASHES = 1_000_000
#: What parts dataset, column and storage type in the names of columns of a whole lake.
MARK = "\x01"


def _counted_as(kind: T.DataType) -> str | None:
    """The type in which a column's values are counted, before the distinct ones become text; None: as text already."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    plain = (T.StringType, T.DecimalType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return kind.simpleString() if isinstance(kind, plain) else None


def value_counts(df: DataFrame, columns: list[str] | None = None, first: bool = False, label=str, weight: str | None = None) -> DataFrame:
    """(column, value as text, freq), nulls included as a null value; with ``first`` also first_row, where it occurs first.
    label: what a column is called in the result. weight: a column that says how many rows each row stands for.

    Columns of one type are unfolded and counted together, by their place and their value as it is stored; only what is
    counted becomes text and gets a name."""
    columns = columns or [c for c in df.columns if c != weight]
    row = ([F.monotonically_increasing_id().alias("first_row")] if first else []) + ([quoted(weight).alias("weight")] if weight else [])
    named = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], *row)
    alike: dict[str | None, list[int]] = {}
    for i, f in enumerate(named.schema[: len(columns)]):
        alike.setdefault(_counted_as(f.dataType), []).append(i)
    sums = [(F.sum("weight") if weight else F.count(F.lit(1))).alias("freq")] + ([F.min("first_row").alias("first_row")] if first else [])
    more = ["first_row"] if first else []
    parts = []
    for kind, places in alike.items():
        held = named.select(*named.columns[len(columns) :], F.array(*[F.col(f"c{i}").cast(kind or "string") for i in places]).alias("held"))
        found = held.select(*held.columns[:-1], F.posexplode("held").alias("at", "value")).groupBy("at", "value").agg(*sums)
        names = F.array(*[F.lit(label(columns[i])) for i in places])
        parts.append(found.select(F.get(names, F.col("at")).alias("column"), F.col("value").cast("string").alias("value"), "freq", *more))
    return reduce(DataFrame.unionAll, parts)


def cardinality(counts: DataFrame) -> DataFrame:
    """num_rows, cardinality, entropy (bits), uniqueness, incompleteness, is_empty, is_binary of each column."""
    some = F.col("value").isNotNull()
    f = F.when(some, F.col("freq"))
    held = counts.groupBy("column").agg(F.sum("freq").alias("num_rows"), F.count("value").alias("cardinality"), F.coalesce(F.sum(f), F.lit(0)).alias("n"), F.coalesce(F.sum(f * F.log2(f)), F.lit(0.0)).alias("flogf"))
    entropy = F.when(F.col("n") > 0, F.log2(F.col("n")) - F.col("flogf") / F.col("n")).otherwise(0.0)
    return held.select("column", "num_rows", "cardinality", F.round(F.abs(entropy), 6).alias("entropy"), (F.col("cardinality") / F.col("num_rows")).alias("uniqueness"), ((F.col("num_rows") - F.col("n")) / F.col("num_rows")).alias("incompleteness"), (F.col("cardinality") == 0).cast("int").alias("is_empty"), (F.col("cardinality") == 2).cast("int").alias("is_binary"))


def frequency(counts: DataFrame) -> DataFrame:
    """Moments and octiles of the frequencies of each column's values; zeros for a column without values."""
    f = F.when(F.col("value").isNotNull(), F.col("freq"))
    held = counts.groupBy("column").agg(
        F.sum("freq").alias("rows"), F.count(f).alias("m"), F.avg(f).alias("frequency_avg"), F.min(f).alias("frequency_min"), F.max(f).alias("frequency_max"),
        F.stddev_pop(f).alias("sd"), F.skewness(f).alias("g1"), F.kurtosis(f).alias("g2"),
        *[F.expr(f"percentile_disc({k / 8}) WITHIN GROUP (ORDER BY CASE WHEN value IS NOT NULL THEN freq END)").alias(f"o{k}") for k in range(1, 8)],
    )
    m = F.col("m").cast("double")
    # the bias-corrected forms; none where too few values or no spread define them
    # (merged moments of equal frequencies may be off by a rounding, so the ends tell whether there is any)
    some = F.col("frequency_min") < F.col("frequency_max")
    skew = F.when((m >= 3) & some, F.col("g1") * F.sqrt(m * (m - 1)) / (m - 2))
    kurt = F.when((m >= 4) & some, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * F.col("g2") + 6))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda c: zero(F.col(c) / F.col("rows"))
    return held.select("column", zero(F.col("frequency_avg")).alias("frequency_avg"), F.coalesce("frequency_min", F.lit(0)).alias("frequency_min"), F.coalesce("frequency_max", F.lit(0)).alias("frequency_max"), F.round(zero(F.col("sd")), 6).alias("frequency_sd"), zero((F.col("o6") - F.col("o2")) / F.col("rows")).alias("frequency_iqr"), F.round(zero(skew), 6).alias("frequency_skewness"), F.round(zero(kurt), 6).alias("frequency_kurtosis"), *[share(f"o{k}").alias(f"frequency_{k}qo") for k in range(1, 8)], share("frequency_min").alias("val_pct_min"), share("frequency_max").alias("val_pct_max"), F.round(share("sd"), 6).alias("val_pct_sd"), zero(F.col("frequency_avg") / F.col("rows")).alias("val_pct_avg"))


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(column, value, freq, rank): the k most frequent values of each column, ties by value. Tasks keep k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("freq"), "value"))
    return counts.filter("value IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= k)


def common_values(counts: DataFrame) -> DataFrame:
    """The commonest values of each column in order, and their soundex codes."""
    held = top_values(counts).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("t"))
    return held.select("column", F.col("t.value").alias("freq_word_containment"), F.transform(F.col("t.value"), F.soundex).alias("freq_word_soundex_containment"))


def coverage(counts: DataFrame) -> DataFrame:
    """Shares of the non-null rows that the 1, 5 and 10 most frequent values cover."""
    total = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("freq"))), F.lit(0)).alias("n"))
    top = top_values(counts).groupBy("column").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("freq"))).alias(f"t{k}") for k in (1, 5, 10)])
    return total.join(top, "column", "left").select("column", *[F.coalesce(F.col(f"t{k}") / F.col("n"), F.lit(0.0)).alias(f"top_{k}_coverage") for k in (1, 5, 10)])


def lengths(counts: DataFrame) -> DataFrame:
    """Lengths of values and of their words (parted at single spaces), and word counts, weighted by frequency."""
    held = counts.filter("value IS NOT NULL").withColumn("w", F.transform(F.split("value", " ", -1), F.length)).withColumns({"len": F.length("value"), "words": word_count(F.col("value"))})
    total = F.sum("freq")
    mean = lambda c: F.sum(c * F.col("freq")) / total
    avg_word = F.aggregate("w", F.lit(0), lambda a, x: a + x) / F.size("w")
    spread = F.sqrt(F.greatest(F.lit(0.0), mean(F.col("words") * F.col("words")) - mean(F.col("words")) * mean(F.col("words"))))
    return held.groupBy("column").agg(F.max(F.array_max("w")).alias("len_max_word"), F.min(F.array_min("w")).alias("len_min_word"), F.round(mean(avg_word), 6).alias("len_avg_word"), F.max("len").alias("len_max_full"), F.min("len").alias("len_min_full"), mean(F.col("len")).alias("len_avg_full"), F.sum(F.col("words") * F.col("freq")).alias("number_words"), F.max("words").alias("words_cnt_max"), F.min("words").alias("words_cnt_min"), mean(F.col("words")).alias("words_cnt_avg"), F.round(spread, 6).alias("words_cnt_sd"))


def boundary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """first_word and last_word: least and greatest value in the column's own order, as text."""
    columns = columns or df.columns
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(quoted(c)).cast("string").alias("first_word"), F.max(quoted(c)).cast("string").alias("last_word")).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("x")).select("x.*")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v double) of numeric columns; NaN is no value."""
    value = F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(quoted(c).cast("double"), F.lit(float("nan"))).alias("v")) for c in columns])
    return df.select(F.explode(value).alias("x")).select("x.*")


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """column, q (array of the exact quantiles, interpolated between the two nearest values), n."""
    return ranked(_long(df, columns).filter("v IS NOT NULL").withColumn("n", F.lit(1)), probabilities)


def ranked(values: DataFrame, probabilities: list[float]) -> DataFrame:
    """quantiles() of values (column, v, n: how often).

    Rows are counted by steps of the value's logarithm, which order them and are at most some 10^5 a column; running sums
    tell in which steps the places lie, and only the values in these are counted one by one. Two scans, no sketch, and no
    task that holds a column's values."""
    size = F.floor(F.log2(F.abs("v")) * STEPS)
    step = F.when(F.col("v") == 0, 0).when(F.col("v") > 0, F.lit(1 << 30) + size).otherwise(F.lit(-(1 << 30)) - size)
    held = values.withColumn("step", step)
    upto = Window.partitionBy("column").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = held.groupBy("column", "step").agg(F.sum("n").alias("m"))
    steps = steps.withColumns({"before": F.sum("m").over(upto) - F.col("m"), "rows": F.sum("m").over(Window.partitionBy("column"))})
    place = lambda p: F.lit(p) * (F.col("rows") - 1)
    places = [f(place(p)) for p in probabilities for f in (F.floor, F.ceil)]
    met = steps.filter(reduce(or_, [(k >= F.col("before")) & (k < F.col("before") + F.col("m")) for k in places])).drop("m")
    # a row a column and place, at most
    inside = held.join(F.broadcast(met), ["column", "step"]).groupBy("column", "step", "before", "rows", "v").agg(F.sum("n").alias("n"))
    inner = Window.partitionBy("column", "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(inner))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    ends = [e.alias(f"{x}{i}") for i, p in enumerate(probabilities) for x, e in (("x", at(F.floor(place(p)))), ("y", at(F.ceil(place(p)))))]
    found = inside.groupBy("column", "rows").agg(*ends)
    value = lambda i, p: F.col(f"x{i}") + (F.col(f"y{i}") - F.col(f"x{i}")) * (place(p) - F.floor(place(p)))
    return found.select("column", F.array(*[value(i, p) for i, p in enumerate(probabilities)]).alias("q"), F.col("rows").alias("n"))


def numerical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signs, zeros, quartiles and outliers beyond 1.5 interquartile ranges, of numeric columns.

    total_outliers is the number of rows, and percentage_outliers its share outside the bounds."""
    return _numerical(_long(df, columns).withColumn("n", F.lit(1).cast("long")))


def numerical_of(counts: DataFrame) -> DataFrame:
    """numerical() of value counts of numeric columns."""
    return _numerical(counts.select("column", F.nullif(F.col("value").cast("double"), F.lit(float("nan"))).alias("v"), F.col("freq").alias("n")))


def _numerical(values: DataFrame) -> DataFrame:
    bounds = ranked(values.filter("v IS NOT NULL"), [0.25, 0.75]).select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    held = values.join(F.broadcast(bounds), "column", "left")  # one row a column
    rows, v = F.sum("n"), F.col("v")
    below, above = v < F.col("q1") - 1.5 * iqr, v > F.col("q3") + 1.5 * iqr
    some = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return held.groupBy("column", "q1", "q3").agg(
        rows.alias("values_count"),
        (some(v < 0) / rows).alias("percentage_negative"),
        (some(v == 0) / rows).alias("number_zero"),
        some(below).alias("outliers_below_iqr"),
        some(above).alias("outliers_above_iqr"),
        rows.alias("total_outliers"),
        (some(below | above) / rows).alias("percentage_outliers"),
    )


def _storage(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def labels(dataset: str, df: DataFrame) -> dict[str, str]:
    """What the columns of a table are called in labelled_counts()."""
    return {MARK.join((dataset, f.name, _storage(f.dataType))): f.name for f in df.schema}


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """The value counts of all columns of several tables, each named by dataset, column and storage type."""
    parts = []
    for n, df in tables.items():
        kinds = {f.name: _storage(f.dataType) for f in df.schema}
        parts.append(value_counts(df, first=True, label=lambda c, n=n, kinds=kinds: MARK.join((n, c, kinds[c]))))
    return reduce(DataFrame.unionAll, parts)


def _stored_as(*kinds: str):
    """Whether a labelled column has one of these storage types."""
    return reduce(lambda a, b: a | b, [F.endswith("column", F.lit(MARK + k)) for k in kinds])


def _typed(counts: DataFrame, *more) -> DataFrame:
    """dataset, column, dtype, row_count, null_count, unique_count, top_freq, main_type, secondary_type, and more sums, from
    labelled counts: two sums, of all columns and of texts, whatever the number of tables and columns."""
    some, blank = F.col("value").isNotNull(), F.col("value").isNull() | (F.col("value") == "")
    v = F.col("value")
    word = F.lower(F.trim(v))
    odd = lambda test: F.count_if(some & ~test)
    sums = [
        F.sum("freq").alias("row_count"),
        F.coalesce(F.sum(F.when(blank, F.col("freq"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.max(F.when(some, F.col("freq"))).alias("top_freq"),
        F.coalesce(F.sum(F.when(some, F.col("freq"))), F.lit(0)).alias("held"),
        F.count_if(some & ~F.col("value").isin("0", "1")).alias("no_bit"),
    ]
    tests = [
        *[odd((word == "") | word.isin(b)).alias(f"bool{i}") for i, b in enumerate(BOOLEANS)],
        F.count_if(word != "").alias("words"),
        odd(is_date(v)).alias("no_date"),
        odd(looks_like_list(v)).alias("no_list"),
        F.count_if(F.contains(v, F.lit("base64"))).alias("base64"),
        F.coalesce(F.sum(F.when(is_prose(v), F.col("freq"))), F.lit(0)).alias("prose"),
    ]
    # only texts are tested for what they read as
    tested = counts.filter(_stored_as("text") & some).groupBy("column").agg(*tests)
    name = F.split("column", MARK)
    held = counts.groupBy("column").agg(*sums, *more).join(tested, "column", "left").fillna(0, ["bool0", "bool1", "words", "no_date", "no_list", "base64", "prose"]).withColumns({"dataset": name[0], "dtype": name[2], "column": name[1]})
    c, few = F.col, F.col("unique_count") <= CATEGORIES
    whole = (c("dtype") == "integer") & (c("held") == c("row_count"))  # an integer column with a null counts as float
    kind = (
        F.when(c("unique_count") == 0, "other")
        .when(c("dtype") == "bool", "boolean")
        .when(whole & (c("unique_count") == 2) & (c("no_bit") == 0), "binary")
        .when(whole & few, "categorical_with_numbers")
        .when(whole, "integer")
        .when(c("dtype").isin("integer", "float"), "float")
        .when(c("dtype") == "date", "date")
        .when(c("dtype") != "text", "other")
        .when((c("words") > 0) & ((c("bool0") == 0) | (c("bool1") == 0)), "boolean")
        .when(c("no_date") == 0, "date")
        .when(c("no_list") == 0, "array")
        .when(few, "categorical")
        .when(c("base64") > 0, "other")
        .when(c("prose") / c("held") > 0.5, "textual")
        .otherwise("string")
    )
    main = F.when(kind.isin("binary", "categorical_with_numbers", "integer", "float"), "numeric").otherwise("string")
    return held.withColumns({"secondary_type": kind, "main_type": main}).drop("held", "bool0", "bool1", "words", "no_date", "no_list", "base64", "prose", "no_bit")


def classify(df: DataFrame) -> dict[str, tuple[str, str]]:
    """column -> (main, secondary) semantic type, from all values; one row a column reaches the driver."""
    found = _typed(labelled_counts({"": df})).select("column", "main_type", "secondary_type").collect()
    return {r["column"]: (r.main_type, r.secondary_type) for r in found}


def first_values(counts: DataFrame, most: int = SAMPLES) -> DataFrame:
    """column, sample_values: the first distinct values of each column in row order, by counts with first_row.

    Each round takes the least row beyond the last one's, so nothing is sorted and a round hands on a row a column."""
    held, found = counts.filter("value IS NOT NULL").select("column", "value", "first_row"), None
    for i in range(most):
        later = held if found is None else held.join(F.broadcast(found), "column").filter(F.col("first_row") > F.col(f"r{i - 1}"))  # one row a column
        least = later.groupBy("column").agg(F.min("first_row").alias(f"r{i}"))
        found = least if found is None else found.join(F.broadcast(least), "column", "left")
    places = F.array(*[f"r{i}" for i in range(most)])
    met = held.join(F.broadcast(found), "column").filter(F.array_contains(places, F.col("first_row")))
    of = F.transform(F.array_sort(F.collect_list(F.struct("first_row", "value"))), lambda x: x["value"])
    return met.groupBy("column").agg(of.alias("sample_values"))


def lake_profile(tables: dict[str, DataFrame], keep=None) -> DataFrame:
    """dataset, column, dtype, types, counts, null_pct, the first three distinct values in row order, outliers and flags of
    every column of several tables.

    Each table is scanned once, for its value counts; all else comes from these. keep(df, name) writes them."""
    counts = labelled_counts(tables)
    counts = keep(counts, "value-counts") if keep else counts
    held = _typed(counts).withColumn("null_pct", F.round(100 * F.col("null_count") / F.col("row_count"), 1))
    first = first_values(counts)
    name = F.split("column", MARK)
    first = first.select(name[0].alias("dataset"), name[1].alias("column"), "sample_values")
    held = held.join(first, ["dataset", "column"], "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    number = F.nullif(F.when(_stored_as("integer", "float"), F.col("value").cast("double")), F.lit(float("nan")))
    numbers = counts.select("column", number.alias("v"), F.col("freq").alias("n")).filter("v IS NOT NULL")
    bounds = ranked(numbers, [0.25, 0.75]).select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    beyond = (F.col("v") < F.col("q1") - 1.5 * iqr) | (F.col("v") > F.col("q3") + 1.5 * iqr)
    beyond = numbers.join(F.broadcast(bounds), "column").groupBy("column").agg(F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outliers"))  # one row a column
    beyond = beyond.select(name[0].alias("dataset"), name[1].alias("column"), "outliers")
    flagged = column_flags(held.join(beyond, ["dataset", "column"], "left").withColumn("outliers", F.coalesce("outliers", F.lit(0))))
    order = ["dataset", "column", "dtype", "main_type", "secondary_type", "row_count", "null_count", "null_pct", "unique_count", "top_freq", "sample_values", "outliers", "flags"]
    return flagged.select(*order)


def column_profile(df: DataFrame, dataset: str) -> DataFrame:
    """lake_profile() of one table."""
    return lake_profile({dataset: df})


def dataset_profiles(tables: dict[str, DataFrame], columns: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row a table: dataset, row_count, column_count, size_bytes, duplicate_row_count, flags, from the flagged column
    profiles. A table with a column whose values are all distinct repeats no row; only the others are looked at."""
    columns = columns.filter(F.col("dataset").isin(*tables))
    single = {r.dataset for r in columns.filter("unique_count = row_count").select("dataset").distinct().collect()}
    twice = [duplicate_rows(df).select(F.lit(n).alias("dataset"), "duplicate_row_count") for n, df in tables.items() if n not in single]
    held, spark = dataset_flags(columns), columns.sparkSession
    rows = [(n, sizes.get(n)) for n in tables]
    held = held.join(spark.createDataFrame(rows, "dataset string, size_bytes long"), "dataset")
    if twice:
        held = held.join(reduce(DataFrame.unionAll, twice), "dataset", "left")
    else:
        held = held.withColumn("duplicate_row_count", F.lit(None).cast("long"))
    none = F.lit(0).cast("long")
    return held.select("dataset", "row_count", "column_count", "size_bytes", F.coalesce("duplicate_row_count", none).alias("duplicate_row_count"), "flags")


def schema_profile(df: DataFrame) -> DataFrame:
    """column, row_count, null_count, null_pct, unique_count, top_freq: what types and flags are decided from."""
    counts = value_counts(df)
    some = F.when(F.col("value").isNotNull(), F.col("freq"))
    return counts.groupBy("column").agg(F.sum("freq").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull() | (F.col("value") == ""), F.col("freq"))), F.lit(0)).alias("null_count"), F.count("value").alias("unique_count"), F.max(some).alias("top_freq")).withColumn("null_pct", F.round(100 * F.col("null_count") / F.col("row_count"), 1))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows and rows beyond the first of each set of equal ones (nulls equal).

    Rows are counted by a hash first, which shuffles some bytes a row; only those whose hash is met again, if any, are
    compared whole."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    of = lambda held: held.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n"))
    if not named.columns or any(_counted_as(f.dataType) is None for f in named.schema):
        return of(named).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))
    marked = named.withColumn("h", F.xxhash64(*named.columns))
    hashes = marked.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows, again = hashes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    if not again:
        return df.sparkSession.createDataFrame([(rows, 0)], "row_count long, duplicate_row_count long")
    if again <= FEW_HASHES:
        marked = marked.join(F.broadcast(hashes.filter("n > 1").select("h")), "h", "left_semi")
    return of(marked).agg(F.lit(rows).cast("long").alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))


def metrics_of(counts: DataFrame) -> DataFrame:
    """All metrics that value counts hold, one row a column: everything but the numerical ones. Boundaries are those of the
    values as text, which is a text column's own order."""
    some = F.col("value").isNotNull()
    ends = counts.groupBy("column").agg(F.min(F.when(some, F.col("value"))).alias("first_word"), F.max("value").alias("last_word"))
    out = cardinality(counts)
    for part in (frequency(counts), common_values(counts), coverage(counts), lengths(counts), ends):
        out = out.join(part, "column", "left")
    return out


def deep_profile(df: DataFrame, dataset: str) -> DataFrame:
    """All metrics of every column, one row a column."""
    labelled = labelled_counts({dataset: df})
    counts = labelled.withColumn("column", F.split("column", MARK)[1])
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    out = cardinality(counts)
    for part in (_typed(labelled).select("column", "main_type", "secondary_type"), frequency(counts), common_values(counts), coverage(counts), lengths(counts), boundary(df)):
        out = out.join(part, "column", "left")
    if numbers:
        out = out.join(numerical(df, numbers), "column", "left")
    return out.withColumn("dataset", F.lit(dataset))
