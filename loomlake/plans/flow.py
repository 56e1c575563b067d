"""A lake from its folder to its composed tables: the one object a user needs.

Everything on rows is lazy and distributed. What the steps hand on to each other is profile-sized, one row a column or a
pair of columns, and is gathered once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators import catalog, discovery, profile
from ..operators.compose import Candidate, Composed, Step, attach, base, chain, star
from ..operators.curate import curate, declutter, mostly_null, redundant_groups, unused_keys
from ..operators.quality import dataset_flags
from ..sources import lake as source
from .gold import AD_HOC, EVERY_TABLE, GoldConfig, GoldRun, Shelf, build_gold, replay

#: Metrics that the score needs, of every usable column.
SCORED = ["cardinality", "uniqueness", "num_rows", "freq_word_containment", "freq_word_soundex_containment", "first_word", "last_word"]

#: Where a store has its catalogue; its other folders have a result a table each.
CATALOGUE = "catalogue"


class Lake:
    """tables: name -> DataFrame, preprocessed; sizes: bytes of their files; raw: the tables as read; store: a folder where
    what is known of each table is kept, with marks: the fingerprints under which it is valid."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], sizes: dict[str, int] | None = None, raw: dict[str, DataFrame] | None = None, store: str | None = None, marks: dict[str, str] | None = None):
        self.spark, self.tables, self.sizes, self.raw = spark, dict(sorted(tables.items())), sizes or {}, raw or tables
        self.store, self.marks = store, marks or {}
        self._held: dict = {}
        #: written value counts by table, as the column profiles made them
        self._counted: dict[str, DataFrame] = {}

    @staticmethod
    def open(spark: SparkSession, folder: str, names: list[str] | None = None, store: str | None = None) -> Lake:
        """The CSV and Parquet tables directly in folder, or those named.

        With a store, the types found for a table and its profiles are read from there as long as its files stay as they
        are; only tables that are new or changed are looked at again, and what is known of tables that are gone goes."""
        paths = {n: p for n, p in source.list_tables(spark, folder).items() if names is None or n in names}
        raw = {n: source.read_table(spark, p) for n, p in paths.items()}
        marks = {n: source.fingerprint(spark, p) for n, p in paths.items()} if store else {}
        tables = {}
        for n, df in raw.items():
            clean = source.cleaned(df)
            held = source.stored(spark, f"{store}/types", n, marks[n]) if store else None
            kinds = {r["column"]: r.kind for r in held.collect()} if held is not None else source.decide(clean)
            if store and held is None:
                source.store(spark.createDataFrame(list(kinds.items()), "column string, kind string"), f"{store}/types", n, marks[n])
            tables[n] = source.converted(clean, kinds)
        for kind in source.stored_names(spark, store) if store else []:
            if kind != CATALOGUE:
                source.prune(spark, f"{store}/{kind}", list(paths))
        return Lake(spark, tables, {n: source.size_of(spark, p) for n, p in paths.items()}, raw, store, marks)

    def _fresh(self, kind: str, make) -> DataFrame:
        """What make(tables) says of every table, one or more rows each with its ``dataset``: profile-sized, so gathered.

        With a store, make gets only the tables of which no valid result is kept, and its result is kept."""
        found = {n: source.stored(self.spark, f"{self.store}/{kind}", n, self.marks[n]) for n in self.tables} if self.store else {}
        stale = {n: df for n, df in self.tables.items() if found.get(n) is None}
        parts = [df for df in found.values() if df is not None]
        if stale:
            made = make(stale)
            rows = made.collect()
            for n in stale if self.store else []:
                source.store(self.spark.createDataFrame([r for r in rows if r.dataset == n], made.schema), f"{self.store}/{kind}", n, self.marks[n])
            parts.append(self.spark.createDataFrame(rows, made.schema))
        return _union(parts)

    def _once(self, name: str, make) -> DataFrame:
        """A profile-sized result, gathered on first use."""
        if name not in self._held:
            df = make()
            self._held[name] = self.spark.createDataFrame(df.collect(), df.schema)
        return self._held[name]

    def _kept_once(self, name: str, make):
        """A written result, or what holds some, made on first use."""
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def names(self) -> list[str]:
        return list(self.tables)

    def preview(self, name: str, order: list[str], offset: int = 0, limit: int = 50, raw: bool = False) -> DataFrame:
        return source.page((self.raw if raw else self.tables)[name], order, offset, limit)

    # -- profiles and catalogue -----------------------------------------------------------------------------------

    def columns(self) -> DataFrame:
        """The column profile of every table, flags included."""

        def make(tables: dict[str, DataFrame]) -> DataFrame:
            def keep(df: DataFrame, name: str) -> DataFrame:
                df = self._kept(df, name)
                self._counted |= dict.fromkeys(tables, df)
                return df

            return profile.lake_profile(tables, keep)

        return self._once("columns", lambda: self._fresh("columns", make))

    def value_counts(self, names: list[str]) -> DataFrame:
        """column (table and column, parted by MARK), value, freq of some tables: those that the profiles were made of,
        counted again where these were stored."""
        self.columns()
        for n in names:
            if n not in self._counted:
                self._counted[n] = self._kept(profile.labelled_counts({n: self.tables[n]}), "value-counts")
        parts = list({id(self._counted[n]): self._counted[n] for n in names}.values())
        own = [label for n in names for label in profile.labels(n, self.tables[n])]
        held = [df.filter(F.col("column").isin(own)).select(F.substring_index("column", profile.MARK, 2).alias("column"), "value", "freq") for df in parts]
        return _union(held)

    def datasets(self) -> DataFrame:
        """The dataset profile of every table, flags included."""
        columns = self.columns()
        return self._once("datasets", lambda: self._fresh("datasets", lambda tables: profile.dataset_profiles(tables, columns, self.sizes)))

    def deep_profile(self, name: str) -> DataFrame:
        return profile.deep_profile(self.tables[name], name)

    def catalogue(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of all tables, columns and flags."""
        return catalog.build(self._flagged(), self.columns())

    def _flagged(self) -> DataFrame:
        """The part of the dataset profiles that follows from those of columns: all but sizes and repeated rows."""
        return self._once("flagged", lambda: dataset_flags(self.columns()))

    def usable(self) -> tuple[DataFrame, DataFrame]:
        return catalog.usable(*self.catalogue())

    def usable_pairs(self, main_type: str | None = None) -> set[tuple[str, str]]:
        """(dataset, column) of the usable columns."""
        held = self.usable()[0].filter("kind = 'column'")
        held = held.filter(F.col("main_type") == main_type) if main_type else held
        return {(r.dataset, r.name) for r in held.select("dataset", "name").collect()}

    def uniqueness(self) -> DataFrame:
        return catalog.uniqueness(self.columns())

    def bases(self) -> DataFrame:
        """dataset, row_count, eligible: usable tables, and whether they have a usable text column and so may be bases."""
        return catalog.eligible_bases(self.usable()[0], self._flagged())

    # -- discovery -------------------------------------------------------------------------------------------------

    def metrics(self, main_type: str = "string") -> DataFrame:
        """What the score needs, of the usable columns of one main type."""
        return self.features(main_type).select("dataset", "column", "main_type", *[F.col(c).cast("double").alias(c) if c == "cardinality" else F.col(c) for c in SCORED])

    def features(self, main_type: str = "string") -> DataFrame:
        """All metrics of the registry, of the usable columns of one main type; numbers have the numerical ones too."""

        def make(tables: dict[str, DataFrame]) -> DataFrame:
            held = self.usable_pairs(main_type)
            names = {n: [c for c in df.columns if (n, c) in held] for n, df in tables.items()}
            wanted = [profile.MARK.join((n, c)) for n, cs in names.items() for c in cs]
            counts = self.value_counts([n for n, cs in names.items() if cs]).filter(F.col("column").isin(wanted)) if wanted else self.spark.createDataFrame([], "column string, value string, freq long")
            counts = self._kept(counts, "value-counts")
            one = profile.metrics_of(counts)
            if main_type == "numeric":
                one = one.join(profile.numerical_of(counts), "column")
            name = F.split("column", profile.MARK)
            return one.withColumns({"dataset": name[0], "column": name[1], "main_type": F.lit(main_type)})

        return self._once(f"features-{main_type}", lambda: self._fresh(f"features-{main_type}", make))

    def column_distances(self, main_type: str = "string") -> DataFrame:
        """Every registered distance of every usable column and every one of another table, of one main type."""
        return discovery.all_distances(self._pairs(self.features(main_type)))

    def _pairs(self, profiles: DataFrame, related: bool = False) -> DataFrame:
        return discovery.related_pairs(profiles) if related else discovery.pairs(profiles, max(1, -(-profiles.count() // discovery.BLOCK)))

    def join_scores(self, scorer=None, related: bool = False) -> DataFrame:
        """The score of every usable text column with every one of another table: of the closed form, or of a fitted scorer.

        It has a row a pair of columns, so it is written, not gathered, and on wide lakes made in blocks of columns. With
        ``related``, only the pairs that share a common value or a sound; an index finds them, so no others are made."""
        if scorer is not None:
            return self._kept(discovery.learned(scorer, discovery.all_distances(self._pairs(self.features(), related))), "scores")
        name = "related-scores" if related else "scores"
        return self._kept_once(name, lambda: self._kept(discovery.scored(discovery.distances(self._pairs(self.metrics(), related))), name))

    def candidates(self, dataset: str, column: str, scorer=None) -> DataFrame:
        """What joins with a usable column, best first."""
        if (dataset, column) not in self.usable_pairs():
            raise ValueError(f"not a usable column: {dataset}.{column}")
        profiles = self.metrics() if scorer is None else self.features()
        held = discovery.pairs(profiles, bases=profiles.filter((F.col("dataset") == dataset) & (F.col("column") == column)))
        scores = discovery.scored(discovery.distances(held)) if scorer is None else discovery.learned(scorer, discovery.all_distances(held))
        return discovery.ranked(scores).orderBy("rank")

    def labelled_pairs(self) -> DataFrame:
        """Distances of parts of the usable text columns, with label 1 for parts of one column."""

        def make() -> DataFrame:
            held, parts = self.usable_pairs("string"), []
            for n, df in self.tables.items():
                names = [c for c in df.columns if (n, c) in held]
                if names:
                    parts.append(discovery.split_counts(df, names, n))
            counts = self._kept(_union(parts), "split-counts")
            return self._kept(discovery.labelled_pairs(self._kept(profile.metrics_of(counts), "split-metrics")), "labelled")

        return self._kept_once("labelled", make)

    def fit_scorer(self, **how):
        """A tree ensemble fitted to this lake's own columns, for join_scores and candidates."""
        return discovery.fit_scorer(self.labelled_pairs(), **how)

    # -- composition -----------------------------------------------------------------------------------------------

    def _candidate(self, dataset: str, column: str, base_column: str, aggregations: dict[str, str] | None = None) -> Candidate:
        return Candidate(dataset, self.tables[dataset], column, base_column, aggregations or {})

    def star(self, dataset: str, joins: list[tuple]) -> Composed:
        """joins: (dataset, column, base column[, aggregations]); only usable columns may be joined on."""
        return star(base(dataset, self.tables[dataset]), [self._candidate(*j) for j in joins], self.usable_pairs())

    def chain(self, dataset: str, joins: list[tuple]) -> Composed:
        """joins: (base dataset, dataset, column, base column[, aggregations]), each attached to what is already there."""
        return chain(base(dataset, self.tables[dataset]), [Step(self._candidate(*j[1:]), j[0]) for j in joins])

    def join_preview(self, made: Composed, order: list[str], offset: int = 0, limit: int = 50) -> dict:
        """A page of a composite and what decluttering would say of its columns."""
        usable, unique, keep = self.usable_pairs(), self.unique_values(), set(made.protected)
        return {
            "page": source.page(made.df, order, offset, limit),
            "columns": [{"column": c, "dataset": made.provenance[c], "original": made.originals[c]} for c in made.df.columns],
            "renamed": made.renamed,
            "aggregated": list(made.aggregated),
            "protected": list(made.protected),
            "unused_keys": unused_keys(made, unique),
            "redundant_groups": redundant_groups(made, usable, keep),
            "mostly_null": mostly_null(made.df, keep),
        }

    def unique_values(self) -> dict[tuple[str, str], float]:
        return {(r.dataset, r["column"]): r.uniqueness for r in self.uniqueness().collect()}

    def curated(self, made: Composed, drop: list[str] | None = None):
        """Pair scores, the related columns and the clusters of a composite without the columns to drop."""
        from dataclasses import replace

        drop = declutter(made, self.usable_pairs(), self.unique_values()) if drop is None else drop
        return curate(replace(made, df=made.df.drop(*map(quoted, drop))))

    def gold(self, config: GoldConfig | None = None, mode: str = EVERY_TABLE, progress=None) -> GoldRun:
        config = config or (GoldConfig.ad_hoc() if mode == AD_HOC else GoldConfig())
        held = {r.dataset: r for r in self.bases().collect()}
        tables = {n: df for n, df in self.tables.items() if n in held}
        rows = {n: r.row_count for n, r in held.items()}
        bases = [n for n, r in held.items() if r.eligible]
        shelf = self._kept_once("shelf", lambda: Shelf(tables, self._kept, self.value_counts))
        return build_gold(tables, self.join_scores(), self.usable_pairs(), self.unique_values(), config, rows, bases, self._kept, progress, shelf)

    def replay(self, run: GoldRun, id: str, anew: bool = False) -> DataFrame:
        """The rows of a table of a run, stored or not, made again from this lake's tables."""
        return replay(run.table(id), self.tables, anew)

    def governance(self, run: GoldRun) -> DataFrame:
        """The edges that a run adds to the catalogue."""
        spark = self.spark
        gold = [(t.id, c, t.provenance[c], t.originals[c]) for t in run.tables for c in t.columns]
        gold = spark.createDataFrame(gold, "table_id string, column string, dataset string, original string")
        joins = {(t.id, j["dataset"], j["base_column"], j["column"], float(j["score"]), j["aggregated"]) for t in run.tables for j in t.joins}
        joins = spark.createDataFrame(sorted(joins), "table_id string, dataset string, base_column string, candidate_column string, score double, aggregated boolean")
        related = [(f"column::{a}::{b}", f"column::{c}::{d}", float(s)) for a, b, c, d, s in run.related]
        related = spark.createDataFrame(related, "source string, target string, score double")
        return catalog.governance(self.catalogue()[0], gold, run.scores, related, joins)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return source.kept(df, name)

    # -- stored state ----------------------------------------------------------------------------------------------

    def rebuild(self, folder: str, run: GoldRun | None = None) -> dict[str, int]:
        """Write the catalogue, the usable part of it and, after a run, the governance edges, as a new snapshot; rows
        written by table. Readers see the snapshot before it until this one is whole."""
        nodes, edges = self.catalogue()
        kept, links = catalog.usable(nodes, edges)
        parts = {"nodes": nodes, "edges": edges, "usable_nodes": kept, "usable_edges": links}
        parts |= {"governance": self.governance(run)} if run else {}
        path = source.new_snapshot(self.spark, folder)
        for name, df in parts.items():
            df.write.parquet(f"{path}/{name}")
        source.finish_snapshot(self.spark, path)
        return {n: df.count() for n, df in catalogue_of(self.spark, folder).items()}

    def catalogue_json(self, run: GoldRun | None = None, scorer=None) -> str:
        """The whole graph, the bounds of the score and whether there is a run as one text; it has a row a column, so it is
        small. With a run, the edges that it adds are part of it, but for the joinable ones, which are a row a pair."""
        rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]
        nodes, edges = self.catalogue()
        more = rows(catalog.composition_view(self.governance(run))) if run else []
        bounds = discovery.model_bounds(scorer) if scorer else discovery.score_bounds()
        return json.dumps({"nodes": rows(nodes), "edges": rows(edges) + more, "score_bounds": bounds, "has_run": run is not None}, sort_keys=True)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def catalogue_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest whole snapshot of a catalogue; none if there is none."""
    path = source.snapshot(spark, folder)
    return {n: spark.read.parquet(f"{path}/{n}") for n in source.stored_names(spark, path) if not n.startswith("_")} if path else {}


def refresh(spark: SparkSession, folder: str, store: str) -> dict[str, str]:
    """Bring a store up to date with a folder: types and profiles of tables that are new or changed, a catalogue snapshot.

    Returns what was done with each table: ``fresh``, ``profiled`` or ``pruned``."""
    paths = source.list_tables(spark, folder)
    before = set(source.stored_names(spark, f"{store}/columns"))
    fresh = {n for n, p in paths.items() if source.stored(spark, f"{store}/columns", n, source.fingerprint(spark, p)) is not None}
    own = Lake.open(spark, folder, store=store)
    own.datasets()
    if len(fresh) < len(paths) or before - set(paths):
        own.rebuild(f"{store}/{CATALOGUE}")
    return {n: "fresh" if n in fresh else "profiled" for n in paths} | dict.fromkeys(sorted(before - set(paths)), "pruned")
