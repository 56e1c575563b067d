"""Autonomous composition of a whole lake: every table as a base, or composites grown table by table.

Growth is a fold over the edges of discovery. Its state is a table of memberships (dataset, composite, home) beside the
composites themselves; for each edge a pure function says what may be tried, in order, and the first join that is wide
enough, meets enough rows and shares no member is made. What comes out is described by recipes, so every table can be made
again from the lake.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from ..functions.text import quoted
from ..operators import compose as C
from ..operators.curate import Digest, Faces, as_doubles, curate, declutter, digest, faces, relationship_edges
from ..operators.discovery import best_per_dataset, unique_bases
from ..operators.profile import MARK, value_counts
from . import recipe as R

EVERY_TABLE, AD_HOC = "every_table", "ad_hoc"
UNCURATED = "joined_uncurated"
#: Tables that are composed at a time: their jobs are many and mostly small.
AT_A_TIME = 4


class GoldError(RuntimeError):
    """A run whose tables are not all what they should be."""


@dataclass(frozen=True)
class GoldConfig:
    """threshold of scores, candidates of a base (every table), least uniqueness of a candidate's key, most columns and
    least match rate of a join (ad hoc)."""

    mode: str = EVERY_TABLE
    threshold: float = 0.001
    top: int | None = 4
    uniqueness: float = 0.0
    width: int = 80
    match: float = 0.1

    @staticmethod
    def ad_hoc(**own) -> GoldConfig:
        return GoldConfig(**{"mode": AD_HOC, "top": None, "uniqueness": 0.9} | own)


@dataclass
class GoldTable:
    """One output table: where its rows and columns come from, how it was joined, its recipe and a lazy DataFrame."""

    id: str
    name: str
    kind: str
    datasets: list[str]
    columns: list[str]
    df: DataFrame | None
    provenance: dict[str, str] = field(default_factory=dict)
    originals: dict[str, str] = field(default_factory=dict)
    joins: list[dict] = field(default_factory=list)
    #: recipe of the joined table, columns dropped before it was grouped, the group that this table is, if any
    recipe: dict = field(default_factory=dict)
    dropped: list[list[str]] = field(default_factory=list)
    cluster: str | None = None

    def by_source(self) -> dict[str, list[str]]:
        """The columns by the dataset that they come from."""
        out: dict[str, list[str]] = {}
        for c in self.columns:
            out.setdefault(self.provenance[c], []).append(c)
        return out

    def record(self) -> dict:
        """All but the rows."""
        return asdict(replace(self, df=None))


@dataclass
class GoldRun:
    config: GoldConfig
    tables: list[GoldTable]
    redundant: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    scores: DataFrame | None = None
    related: list[tuple[str, str, str, str, float]] = field(default_factory=list)
    #: what went wrong in grouping the columns of a composite, by its id
    failed: dict[str, str] = field(default_factory=dict)

    def whole(self) -> GoldRun:
        """This run if nothing went wrong in it; an error that names the composites otherwise."""
        if self.failed:
            raise GoldError("not grouped: " + "; ".join(f"{id} ({why})" for id, why in sorted(self.failed.items())))
        return self

    def table(self, id: str) -> GoldTable:
        found = [t for t in self.tables if t.id == id]
        if not found:
            raise KeyError(f"no such table in this run: {id}")
        return found[0]

    def by_base(self) -> dict[str, list[GoldTable]]:
        """The tables by the dataset whose rows they have, in order."""
        out: dict[str, list[GoldTable]] = {}
        for t in sorted(self.tables, key=lambda t: t.id):
            out.setdefault(t.id.split("::")[0], []).append(t)
        return out

    def record(self) -> dict:
        """The run as plain values."""
        return {"config": asdict(self.config), "redundant": self.redundant, "skipped": self.skipped, "failed": self.failed, "related": self.related, "tables": [t.record() for t in self.tables]}

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write the run's records, recipes included, to a folder of stored results."""
        record = self.record()
        R.store(spark, folder, "gold_run", {"run": record | {"tables": []}} | {f"table/{n:06d}": t for n, t in enumerate(record["tables"])})

    @staticmethod
    def load(spark: SparkSession, folder: str) -> GoldRun:
        """A stored run; its tables have no DataFrame until they are replayed."""
        held = R.load(spark, folder, "gold_run")
        run = held.pop("run")
        tables = [GoldTable(**held[k]) for k in sorted(held)]
        return GoldRun(GoldConfig(**run["config"]), tables, run["redundant"], run["skipped"], None, [tuple(r) for r in run["related"]], run["failed"])


def replay(table: GoldTable, lake: dict[str, DataFrame], anew: bool = False) -> DataFrame:
    """The rows of a table, made again from the tables of a lake.

    The columns are those recorded, and it is an error if one is gone. anew: the columns are grouped again on the rows as
    they are now, and it is an error if the table's group no longer exists."""
    made = R.build(table.recipe, lake)
    if not anew or table.cluster is None:
        names = R.columns_of(made, [[table.provenance[c], table.originals[c]] for c in table.columns])
        return made.df.select(*[quoted(a).alias(b) for a, b in zip(names, table.columns)])
    dropped = {made.column_of(*d) for d in table.dropped}
    _, _, found = curate(replace(made, df=made.df.drop(*[quoted(c) for c in dropped if c])))
    if table.cluster not in found:
        raise R.RecipeError(f"{table.id} has no group {table.cluster} any more")
    return found[table.cluster]


def display_name(datasets: list[str], most: int = 3) -> str:
    named = sorted(datasets)
    return "+".join(named[:most]) + (f" and {len(named) - most} more" if len(named) > most else "")


# -- what is read again ----------------------------------------------------------------------------------------------


class Shelf:
    """What a run makes once, writes and reads again: the digests of tables, the values of columns that are joined on, and
    what a table gives aggregated by a column. No composed table is written: its rows are its root's, with these joined on.

    keep(df, name): what writes; counts(tables): written value counts (column, value, freq) of tables by name, columns
    named by table and column, parted by MARK; counted here if not given. Threads share a shelf."""

    def __init__(self, tables: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame], counts: Callable[[list[str]], DataFrame] | None = None):
        self.tables, self.keep = tables, keep
        self._counts = counts or (lambda names: keep(reduce(DataFrame.unionAll, [value_counts(tables[n], label=lambda c, n=n: n + MARK + c) for n in names]), "value-counts"))
        self._lock, self._locks, self._held = threading.Lock(), {}, {}

    def _once(self, at: tuple, make: Callable):
        with self._lock:
            own = self._locks.setdefault(at, threading.Lock())
        with own:
            if at not in self._held:
                self._held[at] = make()
            return self._held[at]

    def digest(self, dataset: str) -> Digest:
        """Of a table's columns; those of all tables are made at once."""

        def make() -> Digest:
            names = [n for n, df in self.tables.items() if df.columns]
            kinds = {n + MARK + f.name: f.dataType for n in names for f in self.tables[n].schema}
            floats = [c for c, k in kinds.items() if isinstance(k, T.FloatType)]
            counts = self._counts(names)
            if floats:
                of = {n: [f.name for f in self.tables[n].schema if isinstance(f.dataType, T.FloatType)] for n in names}
                again = [value_counts(as_doubles(self.tables[n]), cs, label=lambda c, n=n: n + MARK + c) for n, cs in of.items() if cs]
                counts = counts.filter(~F.col("column").isin(floats)).unionAll(self.keep(reduce(DataFrame.unionAll, again), "value-counts"))
            return digest(counts, [c for c, k in kinds.items() if isinstance(k, T.NumericType)], self.keep)

        return self._once(("digest",), make).of(dataset + MARK)

    def values(self, dataset: str, column: str) -> DataFrame:
        """__key, __n: the values of a table's column and how many rows have each."""
        rows = lambda: self.tables[dataset].groupBy(quoted(column).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        return self._once(("values", dataset, column), lambda: self.keep(rows(), "values"))

    def looked(self, dataset: str, column: str) -> DataFrame:
        """A table's other columns aggregated by a column of it, and ``__key``."""
        df = self.tables[dataset]
        make = lambda: C.grouped(C.Candidate(dataset, df, column, ""), {c: c for c in df.columns if c != column})
        return self._once(("looked", dataset, column), lambda: self.keep(make(), "looked"))

    def values_of(self, made: C.Composed, column: str) -> DataFrame:
        """v, n: the values of a composite's column and how many rows have each."""
        on = made.determinants()[column]
        held = self.values(made.datasets[0], on)
        if on == column:
            return held.select(F.col("__key").alias("v"), F.col("__n").alias("n"))
        return made.spread(held, on).groupBy(quoted(column).alias("v")).agg(F.sum("__n").alias("n"))

    def match(self, left: C.Composed, on: str, right: C.Composed, of: str) -> float:
        """The share of left's rows whose value in a column is one of a column of right."""
        there = self.values_of(right, of).select(F.col("v").alias("w"))
        met = self.values_of(left, on).join(there, F.col("v") == F.col("w"), "left")
        return met.agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0))).first()[0]

    def faces(self, made: C.Composed) -> Faces:
        dataset = made.datasets[0]
        return faces(made, lambda c: self.values(dataset, c), self.digest(dataset), self.keep)


# -- growth ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A dataset's place in a composite, which is named by the dataset whose rows it has. A dataset has one home; where it
    was attached as a copy it is a member, but not at home."""

    dataset: str
    composite: str
    home: bool = True


@dataclass(frozen=True)
class Composite:
    made: C.Composed
    rows: int
    joins: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Try:
    """One thing to try for an edge: ``with_`` a composite, or a table of the lake where that is None; the table's home is
    the new composite if ``settles``, and the composite at hand keeps its rows if ``stays``."""

    with_: str | None
    settles: bool
    stays: bool = False


def tries(members: list[Member], here: str, dataset: str) -> list[Try]:
    """What may be tried to bring a dataset into the composite ``here``, in order.

    Nothing if it is there already. A dataset without a home comes as it is. Otherwise the whole composite that it is at
    home in comes; and if that fails, and the dataset neither gives that composite its rows nor lives there alone, a copy."""
    if any(m.dataset == dataset and m.composite == here for m in members):
        return []
    home = next((m.composite for m in members if m.dataset == dataset and m.home), None)
    if home is None:
        return [Try(None, settles=True)]
    lodgers = sum(m.composite == home and m.home for m in members)
    copy = [Try(None, settles=False, stays=True)] if home != dataset and lodgers > 1 else []
    return [Try(home, settles=True), *copy]


def moved(members: list[Member], into: str, *gone: str) -> list[Member]:
    """Memberships after composites have become one."""
    return [replace(m, composite=into) if m.composite in gone else m for m in members]


class Growth:
    """Composites by name and the memberships; grown() folds edges over them."""

    def __init__(self, tables: dict[str, DataFrame], config: GoldConfig, keep: Callable[[DataFrame, str], DataFrame], shelf: Shelf | None = None):
        self.tables, self.config, self.keep, self.shelf = tables, config, keep, shelf or Shelf(tables, keep)
        self.composites: dict[str, Composite] = {}
        self.members: list[Member] = []

    def joined(self, base: Composite, at: tuple[str, str], other: Composite, key: tuple[str, str], score: float) -> Composite | None:
        """base with other's columns on two source columns, or None if a rule forbids it."""
        on, of = base.made.column_of(*at), other.made.column_of(*key)
        width = len(base.made.df.columns) + len(other.made.df.columns) - 1
        if on is None or of is None or width > self.config.width or set(base.made.datasets) & set(other.made.datasets):
            return None
        if not C.comparable(base.made.df.schema[on].dataType, other.made.df.schema[of].dataType):
            return None
        # the right one's key stays as a column, so rows that meet one have a value, and the two columns' values tell them
        if self.shelf.match(base.made, on, other.made, of) < self.config.match:
            return None
        try:
            made = C.merge(base.made, on, other.made, of, hold=lambda df: self.keep(df, "looked"))
        except C.ComposeError:
            return None
        names = set(made.df.columns)
        protected = dict.fromkeys([*made.protected, *(c for c in other.made.protected if c in names)])
        made = replace(made, protected=tuple(protected))
        step = {"dataset": key[0], "column": key[1], "base_dataset": at[0], "base_column": at[1], "score": score, "aggregated": True}
        return Composite(made, base.rows, (*base.joins, *other.joins, step))

    def grown(self, rows: dict[str, int], edges: dict[str, list]) -> dict[str, Composite]:
        """Tables have a turn each, the one with most rows first; in its turn a table offers its candidates, best first, to
        the composite that is its home."""
        for name in sorted(rows, key=lambda n: (-rows[n], n)):
            here = next((m.composite for m in self.members if m.dataset == name and m.home), None)
            if here is None:
                here = name
                self.composites[name] = Composite(C.base(name, self.tables[name]), rows[name])
                self.members.append(Member(name, name))
            for edge in edges.get(name, []):
                here = self.step(here, name, edge, rows)
        return self.composites

    def step(self, here: str, name: str, edge, rows: dict[str, int]) -> str:
        """The name of the composite at hand after one edge; the first join that succeeds changes the state."""
        dataset, ends = edge.candidate_dataset, ((name, edge.base_column), (edge.candidate_dataset, edge.candidate_column))
        for t in tries(self.members, here, dataset):
            other = self.composites[t.with_] if t.with_ else Composite(C.base(dataset, self.tables[dataset]), rows[dataset])
            mine = self.composites[here]
            swap = other.rows > mine.rows and not t.stays
            made = self.joined(other, ends[1], mine, ends[0], edge.score) if swap else self.joined(mine, ends[0], other, ends[1], edge.score)
            if made is None:
                continue
            into = (t.with_ or dataset) if swap else here
            gone = [here, *([t.with_] if t.with_ else [])]
            self.composites = {k: v for k, v in self.composites.items() if k not in gone} | {into: made}
            self.members = moved(self.members, into, *gone) + ([] if t.with_ else [Member(dataset, into, t.settles)])
            return into
        return here


# -- output ----------------------------------------------------------------------------------------------------------


def outputs(id: str, made: C.Composed, joins: list[dict], drop: list[str], run: GoldRun, keep, faces: Faces | None = None) -> Iterator[GoldTable]:
    """The tables that a composite gives once its columns are grouped: one a group. What was joined but holds no group
    gives none; a bare table gives itself. If a scorer fails, the joined table is given as it is, the run goes on and says so in
    ``failed``, which whole() looks at. Failed and cancelled jobs are no scorer's fault and end the run."""
    origin = lambda c: (made.provenance[c], made.originals[c])
    lean = replace(made, df=made.df.drop(*map(quoted, drop)))

    def table(id: str, name: str, kind: str, df: DataFrame, datasets: list[str], cluster: str | None = None) -> GoldTable:
        own = {c: origin(c) for c in df.columns}
        parts = {"recipe": made.recipe, "dropped": [list(origin(c)) for c in drop], "cluster": cluster}
        return GoldTable(id, name, kind, datasets, df.columns, df, {c: d for c, (d, _) in own.items()}, {c: o for c, (_, o) in own.items()}, joins, **parts)

    try:
        soundness, _, found = curate(lean, keep=keep, faces=faces)
        pairs = relationship_edges(soundness).collect()  # pairs of columns of one table
    except (Py4JError, PySparkException, MemoryError):
        raise
    except Exception as e:  # noqa: BLE001 - whatever a scorer raises, the other tables are still to be made
        run.failed[id] = f"{type(e).__name__}: {e}"
        yield table(id, display_name(made.datasets), UNCURATED, lean.df, made.datasets)
        return
    run.related += [(*origin(r.column_1), *origin(r.column_2), r.soundness) for r in pairs if origin(r.column_1) != origin(r.column_2)]
    if set(found) <= {"unclustered"}:
        if not joins:
            yield table(id, display_name(made.datasets), "unclustered", lean.df, made.datasets)
        return
    for k, df in found.items():
        yield table(f"{id}::cf2::{k}", k.replace("_", " ").capitalize(), "cluster", df, sorted({made.provenance[c] for c in df.columns}), k)


def build_gold(tables: dict[str, DataFrame], scores: DataFrame, usable: set[tuple[str, str]], uniqueness: dict[tuple[str, str], float], config: GoldConfig = GoldConfig(), rows: dict[str, int] | None = None, bases: list[str] | None = None, keep=None, progress: Callable[[str, int, int], None] | None = None, shelf: Shelf | None = None) -> GoldRun:
    """tables: name -> preprocessed DataFrame; scores of column pairs (of which the best edge of each two tables is gathered).

    rows: numbers of rows, counted if not given; bases: the tables that may be bases, all if not given; keep(df, name):
    what writes what is read again, and reads it back; progress: called with the table at hand, its place and how many
    there are; shelf: one of these tables that other runs have filled."""
    rows = rows or {n: df.count() for n, df in sorted(tables.items())}
    bases = sorted(rows) if bases is None else sorted(bases)
    hold = keep or (lambda df, name: df)
    shelf = shelf or Shelf(tables, hold)
    chosen = best_per_dataset(scores, config.threshold, config.uniqueness, config.top if config.mode == EVERY_TABLE else None)
    edges: dict[str, list] = {n: [] for n in bases}
    for e in sorted(chosen.collect(), key=lambda e: (e.base_dataset, e["rank"])):
        if e.base_dataset in edges and e.candidate_dataset in tables:
            edges[e.base_dataset].append(e)
    run = GoldRun(config, [], skipped=sorted(set(rows) - set(bases)), scores=scores)
    if config.mode == AD_HOC:
        made = {n: (c.made, list(c.joins)) for n, c in Growth(tables, config, hold, shelf).grown({n: rows[n] for n in bases}, edges).items()}
    else:
        sizes = scores.sparkSession.createDataFrame(list(rows.items()), "base_dataset string, row_count long")
        run.redundant = {r.base_dataset: r.duplicate_of for r in unique_bases(chosen, sizes).filter("duplicate_of IS NOT NULL").collect()}
        alone = [n for n in edges if n not in run.redundant]
        made = dict(zip(alone, _at_a_time(scores.sparkSession, lambda n: _star(n, edges[n], tables, shelf), alone)))

    def grouped(name: str) -> GoldRun:
        (composed, joins), part = made[name], GoldRun(config, [])
        held = shelf.faces(composed)
        drop = declutter(composed, usable, uniqueness, faces=held) if joins else []
        part.tables += outputs(name, composed, joins, drop, part, keep, held)
        return part

    names = sorted(made)
    parts = _at_a_time(scores.sparkSession, grouped, names, lambda place: progress(names[place], place, len(names)) if progress else None)
    for part in parts:
        run.tables += part.tables
        run.related += part.related
        run.failed |= part.failed
    return run


def _at_a_time(spark: SparkSession, work: Callable[[str], object], names: list[str], before: Callable[[int], None] = lambda place: None) -> list:
    """work of each name in order, AT_A_TIME of them side by side, their Spark jobs with the properties of this thread.
    before(place): called before each is waited for. An error ends all."""
    pool = ThreadPoolExecutor(AT_A_TIME)
    try:
        waiting, found = [pool.submit(inheritable_thread_target(spark)(work), n) for n in names], []
        for place, future in enumerate(waiting):
            before(place)
            found.append(future.result())
        return found
    finally:
        pool.shutdown(cancel_futures=True)


def _star(name: str, edges: list, tables: dict[str, DataFrame], shelf: Shelf) -> tuple[C.Composed, list[dict]]:
    """A table with the best candidates that can be attached to it, and the joins made."""
    made, joins = C.base(name, tables[name]), []
    for e in edges:
        try:
            # tried on the plan before anything is aggregated
            candidate = C.Candidate(e.candidate_dataset, tables[e.candidate_dataset], e.candidate_column, e.base_column)
            C.attach(made, candidate)
        except C.ComposeError:
            continue
        made = C.attach(made, candidate, looked=shelf.looked(e.candidate_dataset, e.candidate_column))
        joins.append({"dataset": e.candidate_dataset, "column": e.candidate_column, "base_dataset": name, "base_column": e.base_column, "score": e.score, "aggregated": True})
    return made, joins


def lineage(run: GoldRun) -> list[tuple[str, str]]:
    """(table, source dataset) of all tables."""
    return [(t.id, d) for t in run.tables for d in t.datasets]


def search(tables: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Rows whose column holds the text, whatever the case."""
    return tables.filter(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column).limit(limit)
