"""The named queries over a lake of eight tables, from profile to composition, each with the same in SQL.

Nothing about the tables is told to the library; the SQL is written out from a list of their columns and storage types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, curate, discovery, profile
from ..operators.compose import ComposeError
from ..sources import lake as source
from .flow import Lake
from .gold import GoldConfig

#: Tables of the lake, with their columns by how they are stored: text, whole numbers (i), other numbers (f), times (d).
LAKE = {
    "region": {"r_regionkey": "i", "r_name": "t"},
    "nation": {"n_nationkey": "i", "n_name": "t", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "t", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "t"},
    "supplier": {"s_suppkey": "i", "s_name": "t", "s_nationkey": "i", "s_acctbal": "f"},
    "part": {"p_partkey": "i", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "i", "p_retailprice": "f"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "t", "o_totalprice": "f", "o_orderdate": "d", "o_orderpriority": "t"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i"}
    | dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "f")
    | {"l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "d"},
    "events": {"event_id": "i", "ts": "d", "user_id": "i", "event_type": "t", "value": "f", "props": "t"},
}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_open: dict[tuple, Lake] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    """The lake of a folder; its profiles, which have a row a column, are shared by the queries of a session for as long
    as its files stay as they are."""
    marks = tuple(source.fingerprint(spark, p) for n, p in source.list_tables(spark, sf_dir).items() if n in LAKE)
    at = (spark.sparkContext.applicationId, sf_dir, marks)
    if at not in _open:
        _open[at] = Lake.open(spark, sf_dir, list(LAKE))
    return _open[at]


# -- profiles ------------------------------------------------------------------------------------------------------

_FLAG = {
    "all_null": "r > 0 AND n = r",
    "high_incompleteness": "CAST(n AS DOUBLE) / r > 0.95",
    "high_top1_coverage": "r > n AND CAST(m AS DOUBLE) / (r - n) > 0.95",
    "high_outliers": "main = 'numeric' AND r - n >= 4 AND CAST(o AS DOUBLE) / r > 0.30",
    "unusable_type": "kind IN ('textual', 'array', 'other')",
}


def profile_sql(tables: dict[str, dict[str, str]], made: str = "") -> str:
    """p: a row a column, with its types, counts and flags (fl); ds: a row a table with its flags. made: CTEs before them."""
    each = [(t, c, k) for t, cs in tables.items() for c, k in cs.items()]
    counts = " UNION ALL ".join(f"SELECT '{t}' AS d, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v, count(*) AS f FROM {t} GROUP BY {c}" for t, c, k in each)
    out = " UNION ALL ".join(
        f"SELECT '{t}' AS d, '{c}' AS c, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS o FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t}),"
        f" (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {t})"
        for t, c, k in each
        if k in "if"
    )
    return f"""WITH {made} vc AS MATERIALIZED ({counts}), outliers AS ({out}), tests AS (
    SELECT d, c, k, CAST(sum(f) AS BIGINT) AS r, CAST(sum(CASE WHEN v IS NULL OR v = '' THEN f ELSE 0 END) AS BIGINT) AS n, count(v) AS u, max(CASE WHEN v IS NOT NULL THEN f END) AS m,
      CAST(sum(CASE WHEN v IS NOT NULL THEN f ELSE 0 END) AS BIGINT) AS filled, bool_and(v IN ('0', '1')) AS bits,
      bool_and(lower(trim(v)) IN ('true', 'false')) OR bool_and(lower(trim(v)) IN ('yes', 'no')) AS bools, bool_and(try_cast(v AS TIMESTAMP) IS NOT NULL) AS dates,
      bool_and(regexp_matches(v, '^\\s*\\[.*\\]\\s*$')) AS lists, bool_or(contains(v, 'base64')) AS blob,
      CAST(sum(CASE WHEN len(regexp_extract_all(v, '[\\p{{L}}\\p{{N}}_]+')) >= 12 AND length(v) > 40 THEN f ELSE 0 END) AS DOUBLE) AS prose FROM vc GROUP BY ALL),
  typed AS (SELECT *, CASE WHEN u = 0 THEN 'other' WHEN k = 'i' AND filled = r AND u = 2 AND bits THEN 'binary' WHEN k = 'i' AND filled = r AND u <= 20 THEN 'categorical_with_numbers' WHEN k = 'i' AND filled = r THEN 'integer'
      WHEN k IN ('i', 'f') THEN 'float' WHEN k = 'd' THEN 'date' WHEN bools THEN 'boolean' WHEN dates THEN 'date' WHEN lists THEN 'array' WHEN u <= 20 THEN 'categorical' WHEN blob THEN 'other' WHEN prose / filled > 0.5 THEN 'textual' ELSE 'string' END AS kind FROM tests),
  mains AS (SELECT *, CASE WHEN kind IN ('binary', 'categorical_with_numbers', 'integer', 'float') THEN 'numeric' ELSE 'string' END AS main FROM typed),
  p AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {w} THEN '{name}' END" for name, w in _FLAG.items())}], lambda x: x IS NOT NULL) AS fl FROM (SELECT mains.*, coalesce(o, 0) AS o FROM mains LEFT JOIN outliers USING (d, c))),
  ds AS (SELECT *, list_filter([CASE WHEN cols < 2 THEN 'too_few_columns' END, CASE WHEN r < 20 THEN 'too_few_rows' END, CASE WHEN valid < 2 THEN 'too_few_valid_columns' END], lambda x: x IS NOT NULL) AS fl
    FROM (SELECT d, max(r) AS r, count(*) AS cols, count(*) FILTER (len(fl) = 0) AS valid FROM p GROUP BY d)),
  usable AS (SELECT p.* FROM p JOIN ds USING (d) WHERE len(p.fl) = 0 AND len(ds.fl) = 0)"""


_PROFILE = profile_sql(LAKE)


@query(_PROFILE + """ SELECT d AS dataset, c AS "column", main AS main_type, kind AS secondary_type, r AS row_count, n AS null_count, round(100.0 * n / r, 1) AS null_pct, u AS unique_count, m AS top_freq, o AS outliers,
    array_to_string(list_transform(fl, lambda x: x || ':warning'), ',') AS flags FROM p""")
def lake_columns(spark, sf_dir):
    """Every column of every table: types, counts, outliers and flags with their severity."""
    flags = F.array_join(F.transform("flags", lambda x: F.concat(x["type"], F.lit(":"), x["severity"])), ",").alias("flags")
    return lake(spark, sf_dir).columns().select("dataset", "column", "main_type", "secondary_type", "row_count", "null_count", "null_pct", "unique_count", "top_freq", "outliers", flags)


_TWICE = " UNION ALL ".join(f"SELECT '{t}' AS d, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS twice" for t in LAKE)


@query(_PROFILE + f""" SELECT d AS dataset, r AS row_count, cols AS column_count, twice AS duplicate_row_count, array_to_string(list_transform(fl, lambda x: x || ':warning'), ',') AS flags FROM ds JOIN ({_TWICE}) USING (d)""")
def lake_datasets(spark, sf_dir):
    """Every table: rows, columns, repeated rows and flags."""
    flags = F.array_join(F.transform("flags", lambda x: F.concat(x["type"], F.lit(":"), x["severity"])), ",").alias("flags")
    return lake(spark, sf_dir).datasets().select("dataset", "row_count", "column_count", "duplicate_row_count", flags)


# -- catalogue -----------------------------------------------------------------------------------------------------


@query(_PROFILE + """ SELECT 'dataset::' || d AS id, 'dataset' AS kind FROM ds UNION ALL SELECT 'column::' || d || '::' || c, 'column' FROM p UNION ALL SELECT 'flag::dataset::' || d || '::' || unnest(fl), 'quality_flag' FROM ds
    UNION ALL SELECT 'flag::column::' || d || '::' || c || '::' || unnest(fl), 'quality_flag' FROM p""")
def catalog_nodes(spark, sf_dir):
    return lake(spark, sf_dir).catalogue()[0].select("id", "kind")


@query(_PROFILE + """ SELECT 'dataset::' || d AS source, 'column::' || d || '::' || c AS target, 'has_column' AS relation FROM p UNION ALL SELECT 'dataset::' || d, 'flag::dataset::' || d || '::' || unnest(fl), 'has_flag' FROM ds
    UNION ALL SELECT 'column::' || d || '::' || c, 'flag::column::' || d || '::' || c || '::' || unnest(fl), 'has_flag' FROM p""")
def catalog_edges(spark, sf_dir):
    return lake(spark, sf_dir).catalogue()[1].select("source", "target", "relation")


@query(_PROFILE + """ SELECT d AS dataset, string_agg(c, ',' ORDER BY c) AS columns FROM usable WHERE main = 'string' GROUP BY d""")
def usable_columns(spark, sf_dir):
    return catalog.usable_columns(lake(spark, sf_dir).usable()[0], "string").select("dataset", F.array_join("columns", ",").alias("columns"))


@query(_PROFILE + """ SELECT d AS dataset, max(r) AS row_count, bool_or(main = 'string') AS eligible FROM usable GROUP BY d""")
def eligible_bases(spark, sf_dir):
    return lake(spark, sf_dir).bases().select("dataset", "row_count", "eligible")


@query(_PROFILE + ' SELECT d AS dataset, c AS "column", CASE WHEN r > n THEN CAST(u AS DOUBLE) / (r - n) ELSE 0 END AS uniqueness FROM p')
def column_uniqueness(spark, sf_dir):
    return lake(spark, sf_dir).uniqueness()


@query(_PROFILE + """ SELECT d AS dataset, c AS "column", CAST(count(*) AS BIGINT) AS n FROM usable WHERE k = 't' AND CAST(u AS DOUBLE) / (r - n) >= 0.90 GROUP BY d, c""")
def unused_keys(spark, sf_dir):
    """Text columns that identify rows of their table and are not joined on, of the usable columns."""
    from ..operators.compose import base

    own = lake(spark, sf_dir)
    unique, usable = own.unique_values(), own.usable_pairs()
    found = [(t, c, 1) for t, df in own.tables.items() for c in curate.unused_keys(base(t, df), unique) if (t, c) in usable]
    return spark.createDataFrame(found, "dataset string, `column` string, n long")


# -- discovery -----------------------------------------------------------------------------------------------------


def soundex_sql(v: str) -> str:
    """Soundex as Spark has it, in SQL: unlike codes in a row count once, H and W part nothing, vowels part."""
    codes = f"translate(regexp_replace(upper({v}), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    held = f"replace(left({codes}, 1), '7', '0') || replace(substr({codes}, 2), '7', '')"
    for digit in "123456":
        held = f"regexp_replace({held}, '{digit}+', '{digit}', 'g')"
    return f"CASE WHEN regexp_matches({v}, '^[A-Za-z]') THEN upper(left({v}, 1)) || rpad(left(replace(substr({held}, 2), '0', ''), 3), 3, '0') ELSE {v} END"


_METRICS = _PROFILE + f""", tops AS (SELECT d, c, list(v) AS w, list({soundex_sql("v")}) AS sx FROM (SELECT *, row_number() OVER (PARTITION BY d, c ORDER BY f DESC, v) AS rn FROM vc WHERE v IS NOT NULL) WHERE rn <= 10 GROUP BY d, c),
  q AS (SELECT x.d, x.c, CAST(x.u AS DOUBLE) AS card, CAST(x.u AS DOUBLE) / CAST(x.r AS DOUBLE) AS uniq, x.r, w, sx FROM usable x JOIN tops USING (d, c) WHERE main = 'string'),
  s AS (SELECT a.d AS base_dataset, a.c AS base_column, b.d AS candidate_dataset, b.c AS candidate_column, b.uniq AS candidate_uniqueness,
    round(CAST(0.45 AS DOUBLE) * (CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(a.w)) + CAST(0.15 AS DOUBLE) * (CAST(len(list_intersect(list_distinct(a.sx), b.sx)) AS DOUBLE) / len(list_distinct(a.sx)))
    + CAST(0.15 AS DOUBLE) * (least(a.card, b.card) / greatest(a.card, b.card, 1)) + CAST(0.1 AS DOUBLE) * (1 - abs(a.uniq - b.uniq)) + CAST(0.15 AS DOUBLE) * (1 - CAST(levenshtein(a.c, b.c) AS DOUBLE) / greatest(length(a.c), length(b.c))), 6) AS score FROM q a JOIN q b ON a.d <> b.d)"""


@query(_METRICS + """ SELECT base_dataset, base_column, candidate_dataset, candidate_column, score FROM s""")
def lake_join_scores(spark, sf_dir):
    """Every usable text column with every one of another table, sounds included."""
    return lake(spark, sf_dir).join_scores().select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "score")


@query(_METRICS + """ SELECT base_dataset, base_column, candidate_dataset, candidate_column, score FROM s JOIN q a ON a.d = base_dataset AND a.c = base_column JOIN q b ON b.d = candidate_dataset AND b.c = candidate_column
    WHERE len(list_intersect(a.w, b.w)) > 0 OR len(list_intersect(a.sx, b.sx)) > 0""")
def lake_related_scores(spark, sf_dir):
    """The same for columns that share a common value or a sound, found by an index of values and sounds."""
    return lake(spark, sf_dir).join_scores(related=True).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "score")


@query(_METRICS + """ SELECT candidate_dataset, candidate_column, score, CAST(row_number() OVER (ORDER BY score DESC, candidate_dataset, candidate_column) AS INT) AS rank FROM s WHERE base_dataset = 'orders' AND base_column = 'o_orderstatus'""")
def lake_candidates(spark, sf_dir):
    """What joins with one column, best first."""
    return lake(spark, sf_dir).candidates("orders", "o_orderstatus").select("candidate_dataset", "candidate_column", "score", "rank")


_EDGES = _METRICS + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_dataset, candidate_dataset ORDER BY score DESC, candidate_column, base_column) AS rn FROM s WHERE score >= 0.001) WHERE rn = 1),
  e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base_dataset ORDER BY score DESC, candidate_dataset) AS k FROM b) WHERE k <= 4)"""


@query(_EDGES + " SELECT base_dataset, base_column, candidate_dataset, candidate_column, score, CAST(k AS INT) AS rank FROM e")
def lake_best_edges(spark, sf_dir):
    """The best column pair of each two tables, and of those the four best of a base."""
    return discovery.best_per_dataset(lake(spark, sf_dir).join_scores()).select("base_dataset", "base_column", "candidate_dataset", "candidate_column", "score", "rank")


@query(_EDGES + """, g AS (SELECT base_dataset, list_distinct(list_append(list(candidate_dataset), base_dataset)) AS ms FROM e GROUP BY base_dataset),
  h AS (SELECT base_dataset, r AS row_count, array_to_string(list_sort(ms), '+') AS members FROM g JOIN ds ON base_dataset = d)
  SELECT base_dataset, row_count, members, CASE WHEN first <> base_dataset THEN first END AS duplicate_of FROM (SELECT *, min(base_dataset) OVER (PARTITION BY members, row_count) AS first FROM h)""")
def base_dedupe(spark, sf_dir):
    own = lake(spark, sf_dir)
    return discovery.unique_bases(discovery.best_per_dataset(own.join_scores()), own.datasets().select(F.col("dataset").alias("base_dataset"), "row_count"))


@query(_METRICS + " SELECT 'column::' || base_dataset || '::' || base_column AS source, 'column::' || candidate_dataset || '::' || candidate_column AS target, score FROM s")
def governance_joinable(spark, sf_dir):
    """The joinable edges that a run adds to the catalogue."""
    own = lake(spark, sf_dir)
    none = spark.createDataFrame([], "source string, target string, score double")
    gold = spark.createDataFrame([], "table_id string, `column` string, dataset string, original string")
    return catalog.governance(own.catalogue()[0], gold, own.join_scores(), none).filter("relation = 'joinable'").select("source", "target", "score")


# -- composition ---------------------------------------------------------------------------------------------------


@query("""SELECT n.n_nationkey, n.n_name, n.n_regionkey, s.s_acctbal FROM nation n LEFT JOIN (SELECT s_name, avg(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) s ON n.n_name = s.s_name""")
def compose_usable_star(spark, sf_dir):
    """A star of the facade, which lets only usable columns be joined on; a flagged table's are refused."""
    own = lake(spark, sf_dir)
    try:
        own.star("nation", [("region", "r_name", "n_name")])
    except ComposeError:
        return own.star("nation", [("supplier", "s_name", "n_name")]).df.drop("s_suppkey", "s_nationkey")
    raise AssertionError("a flagged table was joined on")


@query("""SELECT o_orderkey, count(l_orderkey) AS lines FROM (SELECT o_orderkey FROM orders) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def compose_guarded_key(spark, sf_dir):
    """A candidate that is said to be unique and is not is aggregated all the same."""
    from ..operators.compose import Candidate, base, star

    own = lake(spark, sf_dir).tables
    items = own["lineitem"].select("l_orderkey", F.lit(1).cast("long").alias("lines"))
    made = star(base("orders", own["orders"].select("o_orderkey")), [Candidate("lineitem", items, "l_orderkey", "o_orderkey", {"lines": "sum"}, unique=True)])
    return made.df.withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))


def _columns(spark: SparkSession, run) -> DataFrame:
    rows = [(t.id, t.kind, c, t.provenance[c], t.originals[c]) for t in run.whole().tables for c in t.columns]
    return spark.createDataFrame(rows, "table_id string, kind string, `column` string, dataset string, original string")


@query()
def gold_every_table(spark, sf_dir):
    """One row a column of each output table of the autonomous composition of the lake, every table as a base."""
    return _columns(spark, lake(spark, sf_dir).gold())


@query()
def gold_ad_hoc(spark, sf_dir):
    """The same for composites grown table by table."""
    return _columns(spark, lake(spark, sf_dir).gold(GoldConfig.ad_hoc(uniqueness=0.0)))


# -- text files ----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 50 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 40 > 0 THEN o_totalprice END AS total, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a "quoted", cell' ELSE 'x' || o_orderkey END AS note FROM orders""")
def csv_preprocessed(spark, sf_dir):
    """Orders written as text cells with untidy names and null words, listed, read, typed and cleaned."""
    from ..sources.lake import shared_path, write_csv

    cells = [
        "CAST(o_orderkey AS STRING) AS ` Order Key `",
        "CASE WHEN o_orderkey % 100 = 0 THEN 'nan' WHEN o_orderkey % 50 = 0 THEN ' None ' ELSE concat('  ', o_orderstatus) END AS Status",
        "CASE WHEN o_orderkey % 40 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS TOTAL",
        "date_format(o_orderdate, 'M/d/yyyy') AS `Order Date`",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'a \"quoted\", cell' ELSE concat('x', o_orderkey) END AS note",
    ]
    folder = shared_path(spark, "csv")
    write_csv(spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet").selectExpr(*cells), f"{folder}/orders.csv")
    return Lake.open(spark, folder).tables["orders"]


# -- single tables -------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_row_count FROM lineitem""")
def duplicate_rows_whole(spark, sf_dir):
    return profile.duplicate_rows(lake(spark, sf_dir).tables["lineitem"])


_PART = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, count(*) AS f FROM part GROUP BY {c}" for c in ("p_name", "p_brand", "p_type"))


@query(f"""SELECT c AS "column", CAST(rn AS INT) AS rank, v AS value, {soundex_sql("v")} AS sound FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY f DESC, v) AS rn FROM ({_PART})) WHERE rn <= 10""")
def profile_sounds(spark, sf_dir):
    """The commonest values of text columns and how they sound."""
    held = profile.common_values(profile.value_counts(lake(spark, sf_dir).tables["part"], ["p_name", "p_brand", "p_type"]))
    pairs = F.posexplode(F.arrays_zip("freq_word_containment", "freq_word_soundex_containment")).alias("i", "x")
    return held.select("column", pairs).select("column", (F.col("i") + 1).alias("rank"), F.col("x.freq_word_containment").alias("value"), F.col("x.freq_word_soundex_containment").alias("sound"))
