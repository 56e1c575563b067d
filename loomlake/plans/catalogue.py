"""The named queries of the library's own operators, each with the same in SQL."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curate, discovery, profile, quality
from ..operators.compose import Candidate, Composed, Step, base, chain, match_rate, merge, star
from ..sources.lake import kept, page
from . import derived_queries, lake_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.selectExpr(*columns) if columns else df


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT) AS cents"


# -- composition ---------------------------------------------------------------------------------------------------


@query("""SELECT c.*, o.cents, o.n_orders FROM customer c LEFT JOIN (
    SELECT o_custkey, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(DISTINCT CAST(o_orderkey AS VARCHAR)) AS n_orders
    FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def compose_customer_orders_mean(spark, sf_dir):
    orders = t(spark, sf_dir, "orders", "o_custkey", CENTS, "CAST(o_orderkey AS STRING) AS n_orders")
    return star(base("customer", t(spark, sf_dir, "customer")), [Candidate("orders", orders, "o_custkey", "c_custkey", {"n_orders": "count_distinct"})]).df


@query("""SELECT c_custkey, o_orderpriority, o_orderstatus FROM customer LEFT JOIN (
    SELECT k AS o_custkey, max(CASE WHEN col = 'p' THEN v END) AS o_orderpriority, max(CASE WHEN col = 's' THEN v END) AS o_orderstatus FROM (
      SELECT k, col, v, row_number() OVER (PARTITION BY k, col ORDER BY n DESC, v) AS rn FROM (
        SELECT o_custkey AS k, 'p' AS col, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL
        UNION ALL SELECT o_custkey, 's', o_orderstatus, count(*) FROM orders GROUP BY ALL)) WHERE rn = 1 GROUP BY k) ON c_custkey = o_custkey""")
def compose_customer_orders_mode(spark, sf_dir):
    orders = t(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    return star(base("customer", t(spark, sf_dir, "customer", "c_custkey")), [Candidate("orders", orders, "o_custkey", "c_custkey")]).df


@query("""SELECT o_orderkey, a.* EXCLUDE k FROM orders LEFT JOIN (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q_sum,
    CAST(min(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q_min, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q_max, median(CAST(l_quantity AS BIGINT)) AS q_median,
    avg(CAST(l_quantity AS BIGINT)) AS q_mean, count(DISTINCT l_returnflag) AS flags, arg_min(l_linestatus, l_linenumber * 1000000 + l_partkey) AS status
    FROM lineitem GROUP BY l_orderkey) a ON o_orderkey = k""")
def compose_all_aggs(spark, sf_dir):
    q = "CAST(l_quantity AS BIGINT)"
    items = t(spark, sf_dir, "lineitem", "l_orderkey", *[f"{q} AS q_{f}" for f in ("sum", "min", "max", "median", "mean")], "l_returnflag AS flags", "l_linestatus AS status", "l_linenumber * 1000000 + l_partkey AS place")
    use = {f"q_{f}": f for f in ("sum", "min", "max", "median", "mean")} | {"flags": "count_distinct", "status": "first"}
    return star(base("orders", t(spark, sf_dir, "orders", "o_orderkey")), [Candidate("lineitem", items, "l_orderkey", "o_orderkey", use, order="place")]).df.drop("place")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, o_orderstatus, o_orderpriority, p_brand, p_size FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def compose_star_two_keys(spark, sf_dir):
    left = base("lineitem", t(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"))
    return star(left, [Candidate("orders", t(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", "l_orderkey", unique=True), Candidate("part", t(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), "p_partkey", "l_partkey", unique=True)]).df


@query("""SELECT o_orderkey, o_custkey, c_name, c_nationkey, n_name, n_regionkey, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def compose_chain_three_hops(spark, sf_dir):
    return chain(
        base("orders", t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")),
        [
            Step(Candidate("customer", t(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey"), "c_custkey", "o_custkey", unique=True), "orders"),
            Step(Candidate("nation", t(spark, sf_dir, "nation"), "n_nationkey", "c_nationkey", unique=True), "customer"),
            Step(Candidate("region", t(spark, sf_dir, "region"), "r_regionkey", "n_regionkey", unique=True), "nation"),
        ],
    ).df


@query("""SELECT s_suppkey AS id, s.s_name AS name, s.s_nationkey AS nation, n.n_name AS name__nations FROM supplier s LEFT JOIN nation n ON s_nationkey = n_nationkey""")
def compose_collision_rename(spark, sf_dir):
    left = base("suppliers", t(spark, sf_dir, "supplier", "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"))
    return star(left, [Candidate("nations", t(spark, sf_dir, "nation", "n_nationkey AS nation", "n_name AS name"), "nation", "nation", unique=True)]).df


@query("""SELECT c_custkey, c_nationkey, n_name, b.* FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (
    SELECT o_custkey, avg(o_orderkey) AS o_orderkey, avg(lines) AS lines FROM orders LEFT JOIN
      (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY o_custkey) b ON c_custkey = o_custkey""")
def compose_composite_merge(spark, sf_dir):
    a = star(base("customer", t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")), [Candidate("nation", t(spark, sf_dir, "nation", "n_nationkey", "n_name"), "n_nationkey", "c_nationkey", unique=True)])
    b = star(base("orders", t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")), [Candidate("lineitem", t(spark, sf_dir, "lineitem", "l_orderkey", "CAST(l_quantity AS BIGINT) AS lines"), "l_orderkey", "o_orderkey", {"lines": "sum"})])
    return merge(a, "c_custkey", b, "o_custkey").df


@query("""SELECT CAST(count(o_custkey) AS DOUBLE) / count(*) AS match_rate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey""")
def compose_match_rate(spark, sf_dir):
    large = t(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey", "o_orderstatus")
    made = star(base("customer", t(spark, sf_dir, "customer", "c_custkey")), [Candidate("orders", large, "o_custkey", "c_custkey")])
    return match_rate(made, ["o_orderstatus"])


# -- profiles ------------------------------------------------------------------------------------------------------


def counts_sql(table: str, columns: list[str]) -> str:
    one = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS freq FROM {table} GROUP BY {c}" for c in columns)
    return f"WITH vc AS ({one})"


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
ORDERS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(counts_sql("orders", ORDERS) + ' SELECT "column", value, freq FROM vc')
def profile_value_counts(spark, sf_dir):
    return profile.value_counts(t(spark, sf_dir, "orders"), ORDERS)


@query(counts_sql("customer", CUSTOMER) + """ SELECT "column", CAST(sum(freq) AS BIGINT) AS num_rows, count(value) AS cardinality, round(abs(log2(sum(freq)) - sum(freq * log2(freq)) / sum(freq)), 6) AS entropy,
    CAST(count(value) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS uniqueness, CAST(0 AS DOUBLE) AS incompleteness, CAST(count(value) = 0 AS INT) AS is_empty, CAST(count(value) = 2 AS INT) AS is_binary FROM vc GROUP BY "column" """)
def profile_cardinality(spark, sf_dir):
    return profile.cardinality(profile.value_counts(t(spark, sf_dir, "customer"), CUSTOMER))


_O = ", ".join(f"CAST(quantile_disc(freq, {k / 8}) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS frequency_{k}qo" for k in range(1, 8))


@query(counts_sql("orders", ORDERS) + f""" SELECT "column", avg(freq) AS frequency_avg, min(freq) AS frequency_min, max(freq) AS frequency_max, round(stddev_pop(freq), 6) AS frequency_sd,
    CAST(quantile_disc(freq, 0.75) - quantile_disc(freq, 0.25) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS frequency_iqr, round(coalesce(skewness(freq), 0), 6) AS frequency_skewness, round(coalesce(kurtosis(freq), 0), 6) AS frequency_kurtosis, {_O},
    CAST(min(freq) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS val_pct_min, CAST(max(freq) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS val_pct_max, round(stddev_pop(freq) / CAST(sum(freq) AS DOUBLE), 6) AS val_pct_sd, avg(freq) / CAST(sum(freq) AS DOUBLE) AS val_pct_avg FROM vc GROUP BY "column" """)
def profile_frequency(spark, sf_dir):
    return profile.frequency(profile.value_counts(t(spark, sf_dir, "orders"), ORDERS))


PART = ["p_name", "p_brand", "p_type"]


@query(counts_sql("part", PART) + """ SELECT "column", value, freq, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY freq DESC, value) AS rn FROM vc WHERE value IS NOT NULL) WHERE rn <= 10""")
def profile_common_values(spark, sf_dir):
    return profile.top_values(profile.value_counts(t(spark, sf_dir, "part"), PART))


LINES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query(counts_sql("lineitem", LINES) + """, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY freq DESC, value) AS rn FROM vc WHERE value IS NOT NULL)
    SELECT "column", CAST(sum(CASE WHEN rn <= 1 THEN freq END) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS top_1_coverage, CAST(sum(CASE WHEN rn <= 5 THEN freq END) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS top_5_coverage,
    CAST(sum(CASE WHEN rn <= 10 THEN freq END) AS DOUBLE) / CAST(sum(freq) AS DOUBLE) AS top_10_coverage FROM r GROUP BY "column" """)
def profile_coverage(spark, sf_dir):
    return profile.coverage(profile.value_counts(t(spark, sf_dir, "lineitem"), LINES))


@query("""WITH v AS (SELECT 'p_name' AS "column", p_name AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), w AS (SELECT *, list_transform(str_split(value, ' '), lambda x: length(x)) AS l, length(value) - length(replace(value, ' ', '')) + 1 AS words FROM v)
    SELECT "column", CAST(max(list_max(l)) AS INT) AS len_max_word, CAST(min(list_min(l)) AS INT) AS len_min_word, round(avg(CAST(list_sum(l) AS DOUBLE) / len(l)), 6) AS len_avg_word, CAST(max(length(value)) AS INT) AS len_max_full, CAST(min(length(value)) AS INT) AS len_min_full,
    avg(length(value)) AS len_avg_full, CAST(sum(words) AS BIGINT) AS number_words, CAST(max(words) AS INT) AS words_cnt_max, CAST(min(words) AS INT) AS words_cnt_min, avg(words) AS words_cnt_avg, round(stddev_pop(words), 6) AS words_cnt_sd FROM w GROUP BY "column" """)
def profile_length_words(spark, sf_dir):
    return profile.lengths(profile.value_counts(t(spark, sf_dir, "part"), ["p_name", "p_type"]))


@query("""SELECT 'n_name' AS "column", min(n_name) AS first_word, max(n_name) AS last_word FROM nation UNION ALL SELECT 'n_nationkey', CAST(min(n_nationkey) AS VARCHAR), CAST(max(n_nationkey) AS VARCHAR) FROM nation""")
def profile_boundary(spark, sf_dir):
    return profile.boundary(t(spark, sf_dir, "nation"), ["n_name", "n_nationkey"])


_NUM = """SELECT '{c}' AS "column", q1, q3, count(*) AS values_count, CAST(count(*) FILTER (v < 0) AS DOUBLE) / count(*) AS percentage_negative, CAST(count(*) FILTER (v = 0) AS DOUBLE) / count(*) AS number_zero,
    count(*) FILTER (v < q1 - 1.5 * (q3 - q1)) AS outliers_below_iqr, count(*) FILTER (v > q3 + 1.5 * (q3 - q1)) AS outliers_above_iqr, count(*) AS total_outliers, CAST(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS DOUBLE) / count(*) AS percentage_outliers
    FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {t}), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t}) GROUP BY q1, q3"""


@query(" UNION ALL ".join(_NUM.format(c=c, t="lineitem") for c in ("l_quantity", "l_discount", "l_extendedprice")))
def profile_numerical(spark, sf_dir):
    return profile.numerical(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


# -- quality and text ----------------------------------------------------------------------------------------------


@query(counts_sql("customer", CUSTOMER) + """ SELECT "column", CAST(sum(freq) AS BIGINT) AS row_count, CAST(sum(CASE WHEN value IS NULL OR value = '' THEN freq ELSE 0 END) AS BIGINT) AS null_count, count(value) AS unique_count, max(freq) AS top_freq,
    round(100.0 * sum(CASE WHEN value IS NULL OR value = '' THEN freq ELSE 0 END) / sum(freq), 1) AS null_pct FROM vc GROUP BY "column" """)
def schema_profile(spark, sf_dir):
    return profile.schema_profile(t(spark, sf_dir, "customer", *CUSTOMER))


@query("""SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_shipdate)""")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(t(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate"))


def _flag_profile(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem", "CASE WHEN l_linenumber > 6 AND l_quantity > 49 THEN l_returnflag END AS rare", "CASE WHEN l_quantity < 50 THEN 'x' ELSE l_linestatus END AS same", "l_returnflag AS plain")
    return profile.schema_profile(items).withColumns({"main_type": F.lit("string"), "secondary_type": F.lit("categorical"), "outliers": F.lit(0), "dataset": F.lit("lineitem")})


@query("""WITH v AS (SELECT 'rare' AS "column", CASE WHEN l_linenumber > 6 AND l_quantity > 49 THEN l_returnflag END AS x FROM lineitem UNION ALL SELECT 'same', CASE WHEN l_quantity < 50 THEN 'x' ELSE l_linestatus END FROM lineitem UNION ALL SELECT 'plain', l_returnflag FROM lineitem),
    c AS (SELECT "column", x, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT "column", sum(n) AS r, sum(CASE WHEN x IS NULL THEN n ELSE 0 END) AS k, max(CASE WHEN x IS NOT NULL THEN n END) AS m FROM c GROUP BY "column")
    SELECT "column", concat_ws(',', CASE WHEN r = k THEN 'all_null' END, CASE WHEN CAST(k AS DOUBLE) / r > 0.95 THEN 'high_incompleteness' END, CASE WHEN CAST(m AS DOUBLE) / (r - k) > 0.95 THEN 'high_top1_coverage' END) AS flags FROM p""")
def quality_flags(spark, sf_dir):
    return quality.column_flags(_flag_profile(spark, sf_dir)).select("column", F.array_join("flags.type", ",").alias("flags"))


@query("""SELECT 'lineitem' AS dataset, count(*) AS row_count, CAST(3 AS BIGINT) AS column_count, CASE WHEN count(*) < 20 THEN 'too_few_rows' ELSE '' END || CASE WHEN count(*) FILTER (l_quantity < 50) > 0.95 * count(*) THEN 'too_few_valid_columns' ELSE '' END AS flags FROM lineitem""")
def quality_dataset_flags(spark, sf_dir):
    return quality.dataset_flags(quality.column_flags(_flag_profile(spark, sf_dir))).select("dataset", "row_count", "column_count", F.array_join("flags.type", ",").alias("flags"))


@query("""SELECT event_id, CASE WHEN event_type IN ('nan', 'None', '') THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'v ' || event_id END AS padded FROM events""")
def text_clean(spark, sf_dir):
    events = t(spark, sf_dir, "events", "event_id", "event_type", "CASE WHEN event_id % 7 = 0 THEN ' nan ' ELSE '\t v ' || event_id || ' ' END AS padded")
    return events.select("event_id", X.clean_text(F.col("event_type")).alias("event_type"), X.clean_text(F.col("padded")).alias("padded"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) / 4 END AS number FROM events""")
def numeric_coerce(spark, sf_dir):
    events = t(spark, sf_dir, "events", "event_id", "CASE WHEN event_id % 5 = 0 THEN event_id || 'd' ELSE CAST(CAST(event_id AS DECIMAL(18, 2)) / 4 AS STRING) END AS s")
    return events.select("event_id", X.as_number(F.col("s")).alias("number"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_normalize(spark, sf_dir):
    orders = t(spark, sf_dir, "orders", "o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN 'soon' WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS s")
    return orders.select("o_orderkey", X.as_date(F.col("s")).alias("day"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 12 AND length(text) > 40 AS prose FROM documents""")
def prose_heuristic(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.is_prose(F.col("text")).alias("prose"))


@query(lake_queries._PROFILE + """ SELECT c AS "column", main AS main_type, kind AS secondary_type FROM p WHERE d = 'customer'""")
def classify_types(spark, sf_dir):
    kinds = profile.classify(t(spark, sf_dir, "customer"))
    return spark.createDataFrame([(c, *k) for c, k in kinds.items()], "column string, main_type string, secondary_type string")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, sf_dir):
    return page(t(spark, sf_dir, "orders"), ["o_orderkey"], 100, 50)


# -- catalogue and discovery ---------------------------------------------------------------------------------------

LAKE = {"nation": ["n_name", "n_regionkey"], "region": ["r_name", "r_regionkey"], "customer": ["c_name", "c_mktsegment", "c_nationkey"], "supplier": ["s_name", "s_nationkey"]}


def _profiles(spark, sf_dir) -> DataFrame:
    """Profiles of a few columns of several tables, all as text."""

    def one(name, columns):
        counts = profile.value_counts(t(spark, sf_dir, name), columns)
        held = profile.cardinality(counts).join(profile.common_values(counts), "column").join(counts.filter("value IS NOT NULL").groupBy("column").agg(F.min("value").alias("first_word"), F.max("value").alias("last_word")), "column")
        return held.select(F.lit(name).alias("dataset"), "column", F.lit("string").alias("main_type"), F.col("cardinality").cast("double").alias("cardinality"), "uniqueness", "num_rows", "freq_word_containment", "freq_word_soundex_containment", "first_word", "last_word")

    return reduce(DataFrame.unionByName, [one(n, c) for n, c in LAKE.items()])


_ALL = " UNION ALL ".join(f"SELECT '{n}' AS d, '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS f FROM {n} GROUP BY {c}" for n, cs in LAKE.items() for c in cs)
_PROFILE = f"""WITH vc AS ({_ALL}), top AS (SELECT d, c, list(v) AS w FROM (SELECT *, row_number() OVER (PARTITION BY d, c ORDER BY f DESC, v) AS rn FROM vc) WHERE rn <= 10 GROUP BY d, c),
    p AS (SELECT d, c, CAST(count(*) AS DOUBLE) AS card, CAST(count(*) AS DOUBLE) / CAST(sum(f) AS DOUBLE) AS uniq, min(v) AS lo, max(v) AS hi FROM vc GROUP BY d, c), q AS (SELECT * FROM p JOIN top USING (d, c))"""


@query(_PROFILE + " SELECT a.d AS base_dataset, a.c AS base_column, b.d AS candidate_dataset, b.c AS candidate_column, a.card - b.card AS cardinality, round(a.uniq - b.uniq, 6) AS uniqueness FROM q a JOIN q b ON a.d <> b.d")
def distance_subtraction(spark, sf_dir):
    d = discovery.distances(discovery.pairs(_profiles(spark, sf_dir)))
    return d.select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "cardinality", F.round("uniqueness", 6).alias("uniqueness"))


@query(_PROFILE + " SELECT a.d AS base_dataset, a.c AS base_column, b.d AS candidate_dataset, b.c AS candidate_column, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(a.w) AS containment FROM q a JOIN q b ON a.d <> b.d")
def distance_containment(spark, sf_dir):
    return discovery.distances(discovery.pairs(_profiles(spark, sf_dir))).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "containment")


@query(_PROFILE + " SELECT a.d AS base_dataset, a.c AS base_column, b.d AS candidate_dataset, b.c AS candidate_column, CAST(levenshtein(a.lo, b.lo) AS DOUBLE) AS first_word, CAST(levenshtein(a.hi, b.hi) AS DOUBLE) AS last_word, CAST(levenshtein(a.c, b.c) AS DOUBLE) AS name_dist FROM q a JOIN q b ON a.d <> b.d")
def distance_levenshtein(spark, sf_dir):
    return discovery.distances(discovery.pairs(_profiles(spark, sf_dir))).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "first_word", "last_word", "name_dist")


def _scores(spark, sf_dir) -> DataFrame:
    """Scores from value containment, cardinality, uniqueness and names alone, which SQL has too."""
    return discovery.scored(discovery.distances(discovery.pairs(_profiles(spark, sf_dir))).withColumn("soundex", F.lit(0.0)))


_SCORED = _PROFILE + """, s AS (SELECT a.d AS base_dataset, a.c AS base_column, b.d AS candidate_dataset, b.c AS candidate_column, b.uniq AS candidate_uniqueness, round(CAST(0.45 AS DOUBLE) * (CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(a.w)) + CAST(0.15 AS DOUBLE) * (least(a.card, b.card) / greatest(a.card, b.card))
    + CAST(0.1 AS DOUBLE) * (1 - abs(a.uniq - b.uniq)) + CAST(0.15 AS DOUBLE) * (1 - CAST(levenshtein(a.c, b.c) AS DOUBLE) / greatest(length(a.c), length(b.c))), 6) AS score FROM q a JOIN q b ON a.d <> b.d)"""


@query(_SCORED + " SELECT base_dataset, base_column, candidate_dataset, candidate_column, score, CAST(row_number() OVER (PARTITION BY base_dataset, base_column ORDER BY score DESC, candidate_dataset, candidate_column) AS INT) AS rank FROM s")
def discovery_rank(spark, sf_dir):
    return discovery.ranked(_scores(spark, sf_dir)).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "score", "rank")


_BEST = _SCORED + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_dataset, candidate_dataset ORDER BY score DESC, candidate_column, base_column) AS rn FROM s WHERE score >= 0.001) WHERE rn = 1), r AS (SELECT *, row_number() OVER (PARTITION BY base_dataset ORDER BY score DESC, candidate_dataset) AS k FROM b)"""


@query(_BEST + " SELECT base_dataset, base_column, candidate_dataset, candidate_column, score, CAST(k AS INT) AS rank FROM r WHERE k <= 2")
def discovery_best_per_dataset(spark, sf_dir):
    return discovery.best_per_dataset(_scores(spark, sf_dir), top=2).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "score", "rank")


@query(_SCORED + " SELECT least(base_dataset || '.' || base_column, candidate_dataset || '.' || candidate_column) AS a, greatest(base_dataset || '.' || base_column, candidate_dataset || '.' || candidate_column) AS b, max(score) AS score FROM s GROUP BY 1, 2")
def joinable_dedupe(spark, sf_dir):
    s = _scores(spark, sf_dir).select(F.concat_ws(".", "base_dataset", "base_column").alias("x"), F.concat_ws(".", "candidate_dataset", "candidate_column").alias("y"), "score")
    return s.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"))


@query(_SCORED + " SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM s) WHERE rn = CAST(floor(0.7 * (n - 1)) AS BIGINT) + 1")
def adaptive_threshold(spark, sf_dir):
    return curate.top_share(_scores(spark, sf_dir))


@query(_SCORED + " SELECT base_column, candidate_column, round(least(1.0, greatest(0.0, score / max(score) OVER ())), 3) AS normalised FROM s")
def score_normalize(spark, sf_dir):
    return curate.normalised(_scores(spark, sf_dir)).select("base_column", "candidate_column", "normalised")


# -- curation ------------------------------------------------------------------------------------------------------


@query("""SELECT 'n_code' AS column_1, 'n_name' AS column_2, CAST(count(DISTINCT n_name) AS DOUBLE) / count(DISTINCT (n_name, n_nationkey)) AS ratio FROM nation""")
def redundant_pairs(spark, sf_dir):
    return curate.pair_bijection(t(spark, sf_dir, "nation", "n_name", "concat('N', n_nationkey) AS n_code"), ["n_name", "n_code"])


@query("""SELECT 'c_custkey' AS "column", 0.0 AS null_share UNION ALL SELECT 'o_orderstatus', 1 - CAST(count(DISTINCT o_custkey) AS DOUBLE) / (SELECT count(*) FROM customer) FROM orders WHERE o_totalprice > 400000""")
def mostly_null(spark, sf_dir):
    large = t(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey", "o_orderstatus")
    made = star(base("customer", t(spark, sf_dir, "customer", "c_custkey")), [Candidate("orders", large, "o_custkey", "c_custkey")])
    return curate.null_shares(made.df)


_BIN = """SELECT CAST(least(9, greatest(0, ceil((x - lo) / ((hi - lo) / 10.0)) - 1)) AS INT) AS bin, count(*) AS n FROM (SELECT CAST(l_quantity * 8 AS BIGINT) AS x FROM lineitem), (SELECT min(CAST(l_quantity * 8 AS BIGINT)) AS lo, max(CAST(l_quantity * 8 AS BIGINT)) AS hi FROM lineitem) GROUP BY 1"""


@query(_BIN)
def bin_equal_width(spark, sf_dir):
    return curate.binned(t(spark, sf_dir, "lineitem", "CAST(l_quantity * 8 AS BIGINT) AS bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


_ONE = {"flag": "l_returnflag", "price": "CAST(CAST(l_quantity AS BIGINT) // 5 AS VARCHAR)", "size": "CAST(l_linenumber AS VARCHAR)", "step": "CAST(CAST(l_quantity AS BIGINT) // 10 AS VARCHAR)"}
_TWO = " UNION ALL ".join(f"SELECT '{x}' AS c1, '{y}' AS c2, {_ONE[x]} AS a, {_ONE[y]} AS b FROM lineitem" for x, y in combinations(_ONE, 2))
_DEP = f"""WITH c AS (SELECT c1, c2, a, b, count(*) AS n FROM ({_TWO}) GROUP BY ALL), r AS (SELECT c1, c2, a, sum(n) AS r FROM c GROUP BY ALL), k AS (SELECT c1, c2, b, sum(n) AS k FROM c GROUP BY ALL),
    s AS (SELECT c1, c2, sum(CAST(n AS DOUBLE) * n / (CAST(r AS DOUBLE) * k)) AS s, sum(n) AS n FROM c JOIN r USING (c1, c2, a) JOIN k USING (c1, c2, b) GROUP BY ALL), d AS (SELECT c1, c2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS dof FROM c GROUP BY ALL)
    SELECT c1 AS column_1, c2 AS column_2, round(log2(greatest((n * (s - 1) - dof) / sqrt(2 * dof), 1)), 6) AS soundness FROM s JOIN d USING (c1, c2)"""


def _dependent(spark, sf_dir):
    q = "CAST(l_quantity AS BIGINT)"
    return t(spark, sf_dir, "lineitem", "l_returnflag AS flag", "CAST(l_linenumber AS STRING) AS size", f"CAST({q} div 10 AS STRING) AS step", f"CAST({q} div 5 AS STRING) AS price")


@query(_DEP)
def dependence_pairs(spark, sf_dir):
    return curate.dependence(_dependent(spark, sf_dir), keep=kept)


@query("WITH x AS (" + _DEP + ") SELECT column_1, column_2, soundness FROM x WHERE soundness >= 4.0")
def relationship_edges(spark, sf_dir):
    return curate.relationship_edges(curate.dependence(_dependent(spark, sf_dir), keep=kept))


QUERIES |= lake_queries.QUERIES | derived_queries.QUERIES
ORACLE_SQL |= lake_queries.ORACLE_SQL | derived_queries.ORACLE_SQL
