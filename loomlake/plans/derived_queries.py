"""Queries over tables that Spark derives from the given ones, and over what is fitted, stored or viewed: flags that the given
tables never get, the distances of all metric groups, recipes, chains and views of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, compose, discovery, profile
from ..sources import lake as source
from . import recipe
from .flow import Lake
from .lake_queries import _METRICS, _PROFILE, LAKE, lake, profile_sql, soundex_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# -- every flag and type -----------------------------------------------------------------------------------------------

#: Columns made from orders so that each flag and each type that is told from values occurs: name -> (Spark and DuckDB expression, storage).
ODD = {
    "o_orderkey": ("o_orderkey", "i"),
    "nothing": ("CAST(NULL AS VARCHAR(9))", "t"),
    "rare": ("CASE WHEN o_orderkey % 50 = 0 THEN o_orderpriority END", "t"),
    "same": ("CASE WHEN o_orderkey % 100 = 1 THEN 'b' ELSE 'a' END", "t"),
    "wild": ("CASE WHEN o_orderkey % 6 = 0 THEN -1000000 WHEN o_orderkey % 6 = 1 THEN 1000000 ELSE o_orderkey % 10 END", "i"),
    "prose": ("concat('this is the text of the order ', CAST(o_orderkey AS VARCHAR(20)), ' and it is all that we have of it here')", "t"),
    "list": ("concat('[', CAST(o_orderkey AS VARCHAR(20)), ', 2]')", "t"),
    "truth": ("CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END", "t"),
    "day": ("concat('2024-01-', CAST(10 + o_orderkey % 20 AS VARCHAR(20)))", "t"),
    "picture": ("concat('data:image/png;base64,', CAST(o_orderkey AS VARCHAR(20)))", "t"),
    "bit": ("o_orderkey % 2", "i"),
    "plain": ("o_orderpriority", "t"),
}
_TINY = {"k": ("o_orderkey", "i")}
_MADE = f"odd AS MATERIALIZED (SELECT {', '.join(f'{e} AS {c}' for c, (e, _) in ODD.items())} FROM orders), tiny AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3000 = 1),"
_ODD_PROFILE = profile_sql({"odd": {c: k for c, (_, k) in ODD.items()}, "tiny": {"k": "i"}}, _MADE)


def _odd_lake(spark, sf_dir) -> Lake:
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    odd = orders.select(*[F.expr(e).cast("string" if k == "t" else "long").alias(c) for c, (e, k) in ODD.items()])
    tiny = orders.filter("o_orderkey % 3000 = 1").selectExpr("o_orderkey AS k")
    return Lake(spark, {"odd": odd, "tiny": tiny})


@query(_ODD_PROFILE + """ SELECT d AS dataset, c AS "column", main AS main_type, kind AS secondary_type, o AS outliers, array_to_string(fl, ',') AS flags FROM p""")
def flags_of_odd_columns(spark, sf_dir):
    """Every flag of a column, and the types of texts, on columns that have them."""
    return _odd_lake(spark, sf_dir).columns().select("dataset", "column", "main_type", "secondary_type", "outliers", F.array_join("flags.type", ",").alias("flags"))


@query(_ODD_PROFILE + """ SELECT d AS dataset, r AS row_count, cols AS column_count, array_to_string(fl, ',') AS flags FROM ds""")
def flags_of_odd_datasets(spark, sf_dir):
    return _odd_lake(spark, sf_dir).datasets().select("dataset", "row_count", "column_count", F.array_join("flags.type", ",").alias("flags"))


# -- distances of all metric groups ------------------------------------------------------------------------------------

_EIGHTHS = ", ".join(f"CAST(quantile_disc(f, {k / 8}) AS DOUBLE) / rows AS frequency_{k}qo" for k in range(1, 8))
_WORDS = "list_transform(str_split(v, ' '), lambda x: length(x))"
_COUNTED = "length(v) - length(replace(v, ' ', '')) + 1"
#: mx: a row a column of own (d, c, v, f, rows), with all metrics that value counts hold.
_MX = f"""
  m0 AS (SELECT d, c, CAST(sum(f) AS DOUBLE) AS num_rows, CAST(count(v) AS DOUBLE) AS cardinality, CAST(sum(CASE WHEN v IS NULL THEN f ELSE 0 END) AS DOUBLE) / CAST(sum(f) AS DOUBLE) AS incompleteness,
    CAST(count(v) AS DOUBLE) / CAST(sum(f) AS DOUBLE) AS uniqueness, CAST(count(v) = 0 AS DOUBLE) AS is_empty, CAST(count(v) = 2 AS DOUBLE) AS is_binary FROM own GROUP BY d, c),
  m1 AS (SELECT d, c, round(abs(log2(sum(f)) - sum(f * log2(f)) / sum(f)), 6) AS entropy, avg(f) AS frequency_avg, min(f) AS frequency_min, max(f) AS frequency_max, round(stddev_pop(f), 6) AS frequency_sd,
    CAST(quantile_disc(f, 0.75) - quantile_disc(f, 0.25) AS DOUBLE) / rows AS frequency_iqr, round(CASE WHEN stddev_pop(f) > 0 THEN coalesce(skewness(f), 0) ELSE 0 END, 6) AS frequency_skewness,
    round(CASE WHEN stddev_pop(f) > 0 THEN coalesce(kurtosis(f), 0) ELSE 0 END, 6) AS frequency_kurtosis, {_EIGHTHS}, CAST(min(f) AS DOUBLE) / rows AS val_pct_min, CAST(max(f) AS DOUBLE) / rows AS val_pct_max,
    round(stddev_pop(f) / rows, 6) AS val_pct_sd, avg(f) / rows AS val_pct_avg, min(v) AS first_word, max(v) AS last_word FROM own WHERE v IS NOT NULL GROUP BY d, c, rows),
  m2 AS (SELECT d, c, list(v) AS freq_word_containment, list({soundex_sql("v")}) AS freq_word_soundex_containment, CAST(sum(CASE WHEN rn <= 1 THEN f END) AS DOUBLE) / any_value(n) AS top_1_coverage,
    CAST(sum(CASE WHEN rn <= 5 THEN f END) AS DOUBLE) / any_value(n) AS top_5_coverage, CAST(sum(f) AS DOUBLE) / any_value(n) AS top_10_coverage
    FROM (SELECT *, row_number() OVER (PARTITION BY d, c ORDER BY f DESC, v) AS rn, sum(f) OVER (PARTITION BY d, c) AS n FROM own WHERE v IS NOT NULL) WHERE rn <= 10 GROUP BY d, c),
  m3 AS (SELECT d, c, max(list_max({_WORDS})) AS len_max_word, min(list_min({_WORDS})) AS len_min_word, round(sum(f * (CAST(list_sum({_WORDS}) AS DOUBLE) / len({_WORDS}))) / sum(f), 6) AS len_avg_word, max(length(v)) AS len_max_full, min(length(v)) AS len_min_full,
    CAST(sum(f * length(v)) AS DOUBLE) / CAST(sum(f) AS DOUBLE) AS len_avg_full, sum(f * ({_COUNTED})) AS number_words, max({_COUNTED}) AS words_cnt_max, min({_COUNTED}) AS words_cnt_min, CAST(sum(f * ({_COUNTED})) AS DOUBLE) / CAST(sum(f) AS DOUBLE) AS words_cnt_avg,
    round(sqrt(greatest(0, CAST(sum(f * ({_COUNTED}) * ({_COUNTED})) AS DOUBLE) / CAST(sum(f) AS DOUBLE) - power(CAST(sum(f * ({_COUNTED})) AS DOUBLE) / CAST(sum(f) AS DOUBLE), 2))), 6) AS words_cnt_sd FROM own WHERE v IS NOT NULL GROUP BY d, c),
  mx AS MATERIALIZED (SELECT * FROM m0 JOIN m1 USING (d, c) JOIN m2 USING (d, c) JOIN m3 USING (d, c))"""
_ALL_METRICS = _PROFILE + ", own AS (SELECT vc.d, vc.c, v, f, CAST(r AS DOUBLE) AS rows FROM vc JOIN usable USING (d, c) WHERE main = 'string')," + _MX


def _distance_sql(metric: str) -> str:
    rule, a, b = discovery.REGISTRY[metric], f"a.{metric}", f"b.{metric}"
    if rule == "containment":
        return f"CAST(len(list_intersect(list_distinct({a}), {b})) AS DOUBLE) / len(list_distinct({a})) AS d_{metric}"
    if rule == "edit":
        return f"CAST(levenshtein({a}, {b}) AS DOUBLE) AS d_{metric}"
    return f"CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE) AS d_{metric}"


def _distances_sql(table: str, metrics: list[str]) -> str:
    return f" SELECT a.d AS base_dataset, a.c AS base_column, b.d AS candidate_dataset, b.c AS candidate_column, {', '.join(map(_distance_sql, metrics))}, CAST(levenshtein(a.c, b.c) AS DOUBLE) AS d_name FROM {table} a JOIN {table} b ON a.d <> b.d"


def _shown(distances, metrics: list[str]):
    return distances.select("base_dataset", "base_column", "candidate_dataset", "candidate_column", *[f"d_{m}" for m in metrics], "d_name")


_TEXT_METRICS = [m for m in discovery.REGISTRY if m not in discovery.RULES["numerical"][1]]


@query(_ALL_METRICS + _distances_sql("mx", _TEXT_METRICS))
def lake_distances(spark, sf_dir):
    """Every distance of the registry, of every usable text column and every one of another table."""
    return _shown(lake(spark, sf_dir).column_distances(), _TEXT_METRICS)


_NUMBER_METRICS = ["num_rows", "cardinality", "uniqueness", "is_binary", *discovery.RULES["numerical"][1]]


@query(_PROFILE + """, num AS (SELECT u.d, u.c, try_cast(v AS DOUBLE) AS x, f, u.u, CAST(u.r AS DOUBLE) AS rows, o FROM usable u JOIN vc ON u.d = vc.d AND u.c = vc.c WHERE main = 'numeric'),
  far AS (SELECT d, c, q1, q3 FROM (SELECT d, c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT d, c, x, unnest(range(f)) FROM num WHERE x IS NOT NULL) GROUP BY d, c)),
  nx AS MATERIALIZED (SELECT d, c, any_value(rows) AS num_rows, any_value(u) AS cardinality, any_value(u) / any_value(rows) AS uniqueness, CAST(any_value(u) = 2 AS INT) AS is_binary, any_value(rows) AS values_count,
    sum(CASE WHEN x < 0 THEN f ELSE 0 END) / any_value(rows) AS percentage_negative, sum(CASE WHEN x = 0 THEN f ELSE 0 END) / any_value(rows) AS number_zero,
    sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) THEN f ELSE 0 END) AS outliers_below_iqr, sum(CASE WHEN x > q3 + 1.5 * (q3 - q1) THEN f ELSE 0 END) AS outliers_above_iqr, any_value(rows) AS total_outliers,
    any_value(o) / any_value(rows) AS percentage_outliers FROM num JOIN far USING (d, c) GROUP BY d, c)""" + _distances_sql("nx", _NUMBER_METRICS))
def lake_distances_of_numbers(spark, sf_dir):
    """The numerical distances and some others, of every usable numeric column and every one of another table."""
    return _shown(lake(spark, sf_dir).column_distances("numeric"), _NUMBER_METRICS)


@query()
def lake_learned_scores(spark, sf_dir):
    """Scores of a tree ensemble fitted to the lake's own columns: parts of one column are true pairs, others false."""
    own = lake(spark, sf_dir)
    return own.join_scores(own.fit_scorer(trees=20)).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "score")


# -- profiles with all metrics -----------------------------------------------------------------------------------------

_CUSTOMER = LAKE["customer"]
_ENDS = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST(min({c}) AS VARCHAR) AS lo, CAST(max({c}) AS VARCHAR) AS hi FROM customer" for c in _CUSTOMER)
_NUMBERS = " UNION ALL ".join(
    f"""SELECT '{c}' AS c, q1, q3, count(*) AS values_count, CAST(count(*) FILTER (v < 0) AS DOUBLE) / count(*) AS percentage_negative, CAST(count(*) FILTER (v = 0) AS DOUBLE) / count(*) AS number_zero,
    count(*) FILTER (v < q1 - 1.5 * (q3 - q1)) AS outliers_below_iqr, count(*) FILTER (v > q3 + 1.5 * (q3 - q1)) AS outliers_above_iqr, count(*) AS total_outliers, CAST(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS DOUBLE) / count(*) AS percentage_outliers
    FROM (SELECT CAST({c} AS DOUBLE) AS v FROM customer), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM customer) GROUP BY q1, q3"""
    for c, k in _CUSTOMER.items()
    if k in "if"
)
_DEEP = f""", own AS (SELECT vc.d, vc.c, v, f, CAST(r AS DOUBLE) AS rows FROM vc JOIN p USING (d, c)), {_MX}, ends AS ({_ENDS}), numbers AS ({_NUMBERS})
  SELECT mx.d AS dataset, mx.c AS "column", main AS main_type, kind AS secondary_type, array_to_string(freq_word_containment, '|') AS freq_word_containment, array_to_string(freq_word_soundex_containment, '|') AS freq_word_soundex_containment, lo AS first_word, hi AS last_word,
    mx.* EXCLUDE (d, c, freq_word_containment, freq_word_soundex_containment, first_word, last_word) REPLACE (CAST(num_rows AS BIGINT) AS num_rows, CAST(cardinality AS BIGINT) AS cardinality, CAST(is_empty AS INT) AS is_empty, CAST(is_binary AS INT) AS is_binary, CAST(number_words AS BIGINT) AS number_words), numbers.* EXCLUDE c FROM mx JOIN p USING (d, c) JOIN ends ON ends.c = mx.c LEFT JOIN numbers ON numbers.c = mx.c"""


def _joined(df):
    """Lists as texts."""
    return df.withColumns({c: F.array_join(c, "|") for c in ("freq_word_containment", "freq_word_soundex_containment")})


@query(profile_sql({"customer": _CUSTOMER}) + _DEEP)
def profile_deep(spark, sf_dir):
    """Every metric of every column of a table."""
    return _joined(profile.deep_profile(lake(spark, sf_dir).tables["customer"], "customer"))


_PARTS = ["p_name", "p_brand", "p_type"]


@query(f"""SELECT c AS "column", string_agg(v, '|' ORDER BY rn) AS freq_word_containment, string_agg({soundex_sql("v")}, '|' ORDER BY rn) AS freq_word_soundex_containment
    FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY f DESC, v) AS rn FROM ({" UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, count(*) AS f FROM part GROUP BY {c}" for c in _PARTS)})) WHERE rn <= 10 GROUP BY c""")
def profile_common_sounds(spark, sf_dir):
    return _joined(profile.common_values(profile.value_counts(lake(spark, sf_dir).tables["part"], _PARTS)))


# -- recipes and chains ------------------------------------------------------------------------------------------------


@query("""SELECT n.*, s.* EXCLUDE s_nationkey FROM nation n LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey, min(s_name) AS s_name, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""")
def recipe_replayed(spark, sf_dir):
    """A composition whose recipe is stored, read back and followed."""
    own = lake(spark, sf_dir).tables
    use = {"s_suppkey": "min", "s_name": "most_common", "s_acctbal": "max"}
    made = compose.star(compose.base("nation", own["nation"]), [compose.Candidate("supplier", own["supplier"], "s_nationkey", "n_nationkey", use)])
    folder = source.shared_path(spark, "recipes")
    recipe.store(spark, folder, "made", {"nations": made.recipe})
    return recipe.build(recipe.load(spark, folder, "made")["nations"], own).df


@query(_PROFILE + """ SELECT c AS "column", d AS dataset, c AS original FROM usable WHERE (d = 'orders') OR (d = 'customer' AND c <> 'c_custkey') OR (d = 'nation' AND c <> 'n_nationkey')""")
def chain_searchable(spark, sf_dir):
    """The columns of a chain that may be joined on next, once one iteration was taken back and another was made."""
    own = lake(spark, sf_dir)
    step = lambda d, key, base_column, of: compose.Step(compose.Candidate(d, own.tables[d], key, base_column, unique=True), of)
    chain = compose.Chain.of("orders", own.tables["orders"]).then(step("customer", "c_custkey", "o_custkey", "orders"))
    wrong = chain.then(step("supplier", "s_nationkey", "c_nationkey", "customer"))
    found = wrong.at(1).then(step("nation", "n_nationkey", "c_nationkey", "customer")).searchable(own.usable_pairs())
    return spark.createDataFrame(found, "`column` string, dataset string, original string")


# -- views of the catalogue --------------------------------------------------------------------------------------------

_JOINABLE = _METRICS + """, g AS (SELECT 'column::' || base_dataset || '::' || base_column AS a, 'column::' || candidate_dataset || '::' || candidate_column AS b, score FROM s),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY score DESC, a) AS rn FROM g) WHERE rn = 1),
  cut AS (SELECT score AS least_score FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM one) WHERE rn = CAST(floor(0.7 * (n - 1)) AS BIGINT) + 1)"""


def _governed(spark, sf_dir):
    own = lake(spark, sf_dir)
    none = spark.createDataFrame([], "source string, target string, score double")
    gold = spark.createDataFrame([], "table_id string, `column` string, dataset string, original string")
    return own, catalog.governance(own.catalogue()[0], gold, own.join_scores(), none)


@query(_JOINABLE + """ SELECT 'dataset::' || d AS source, 'column::' || d || '::' || c AS target, 'has_column' AS relation, CAST(NULL AS DOUBLE) AS score FROM p UNION ALL SELECT a, b, 'joinable', score FROM one, cut WHERE score >= least_score""")
def view_joinability(spark, sf_dir):
    own, governed = _governed(spark, sf_dir)
    return catalog.joinability_view(own.catalogue()[1], governed)


@query(_PROFILE + """ SELECT 'dataset::' || d AS source, 'column::' || d || '::' || c AS target, 'has_column' AS relation FROM p UNION ALL SELECT 'dataset::' || d, 'flag::dataset::' || d || '::' || unnest(fl), 'has_flag' FROM ds
    UNION ALL SELECT 'column::' || d || '::' || c, 'flag::column::' || d || '::' || c || '::' || unnest(fl), 'has_flag' FROM p""")
def view_initial(spark, sf_dir):
    own, governed = _governed(spark, sf_dir)
    nodes, edges = own.catalogue()
    return catalog.initial_view(nodes, edges.unionByName(governed, allowMissingColumns=True))[1]
