"""Composition: aggregate a candidate to its key, then left-join it, so the base's rows are never multiplied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import quoted

#: A candidate of so many bytes at most (by the planner's estimate, which files bound) cannot have a key whose values overfill
#: a task, so its modes and medians may be taken in one aggregation.
ONE_PASS = 128 << 20
#: Steps of an octave that order the values of a median.
STEPS = 4_096

NUMERIC = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median}
TEXT = {"most_common": lambda c: F.mode(c, deterministic=True), "count_distinct": F.count_distinct}


class ComposeError(ValueError):
    """A join that cannot be made as asked."""


@dataclass(frozen=True)
class Candidate:
    """A table to attach: its key column, the base column it meets, and functions for columns (others take the default).

    ``unique`` says that the key should be unique and without nulls: that is checked, and only then is the aggregation
    spared (see guarded()). ``order`` is what ``first`` goes by."""

    dataset: str
    df: DataFrame
    key: str
    base_column: str
    aggregations: dict[str, str] = field(default_factory=dict)
    unique: bool = False
    order: str | None = None
    #: what its rows take, where the planner's estimate does not tell (of joins it takes the product)
    size: int | None = None


@dataclass(frozen=True)
class Lookup:
    """One join of a composed table: the column it is looked up by, and what is found, a row a key (``__key``)."""

    on: str
    df: DataFrame
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Composed:
    """A lazy result and its lineage: column -> source dataset, column -> original name. Its rows are those of ``root``, with
    the columns of ``lookups`` joined on in turn, so what is joined on is a function of a column of root."""

    df: DataFrame
    provenance: dict[str, str]
    originals: dict[str, str]
    protected: tuple[str, ...] = ()
    aggregated: tuple[str, ...] = ()
    renamed: dict[str, str] = field(default_factory=dict)
    #: How it was made, as plain values; see plans/recipe.py.
    recipe: dict = field(default_factory=dict)
    root: DataFrame | None = None
    lookups: tuple[Lookup, ...] = ()

    @property
    def datasets(self) -> list[str]:
        return list(dict.fromkeys(self.provenance.values()))

    def recipe_of(self, column: str) -> list[str]:
        """Where a column comes from: its source dataset and its name there."""
        return [self.provenance[column], self.originals[column]]

    def column_of(self, dataset: str, original: str) -> str | None:
        return next((c for c, d in self.provenance.items() if d == dataset and self.originals[c] == original), None)

    def determinants(self) -> dict[str, str]:
        """Each column's column of root that it is a function of; itself for those of root."""
        out = {c: c for c in self.root.columns}
        for held in self.lookups:
            out |= dict.fromkeys(held.columns, out[held.on])
        return out

    def spread(self, values: DataFrame, on: str) -> DataFrame:
        """values, which has a column ``__key`` with values of root's column ``on``, with all that is a function of it."""
        of = self.determinants()
        for held in self.lookups:
            if of[held.on] == on:
                by = F.col("__key") if held.on == on else quoted(held.on)
                values = values.join(held.df.withColumnRenamed("__key", "__met"), by == F.col("__met"), "left").drop("__met")
        return values


def base(dataset: str, df: DataFrame) -> Composed:
    return Composed(df, dict.fromkeys(df.columns, dataset), {c: c for c in df.columns}, recipe={"table": dataset, "columns": df.columns}, root=df)


def function_of(candidate: Candidate, column: str) -> str:
    """The function of a column: the one asked for, else the default of its type."""
    numeric = isinstance(candidate.df.schema[column].dataType, T.NumericType)
    return candidate.aggregations.get(column, "mean" if numeric else "most_common")


def aggregate(candidate: Candidate, column: str) -> Column:
    numeric = isinstance(candidate.df.schema[column].dataType, T.NumericType)
    name = function_of(candidate, column)
    if name == "first":
        if numeric or not candidate.order:
            raise ComposeError("first needs a text column and an order")
        return F.min_by(quoted(column), quoted(candidate.order))
    known = NUMERIC if numeric else TEXT
    if name not in known:
        raise ComposeError(f"{name} does not apply to {column}")
    return known[name](quoted(column))


def _counted(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """__key, i, a column v0, v1, ... for each of columns (all but the i-th null), n: how often a key has a value.

    A key with very many rows is spread by its values; rows are combined before the shuffle."""
    parts = [F.struct(F.lit(i).alias("i"), *[(c if i == j else F.lit(None).cast(df.select(c).schema[0].dataType)).alias(f"v{j}") for j, c in enumerate(columns.values())]) for i, _ in enumerate(columns)]
    held = df.filter(quoted(key).isNotNull()).select(quoted(key).alias("__key"), F.explode(F.array(*parts)).alias("x")).select("__key", "x.*")
    values = [f"v{j}" for j in range(len(columns))]
    return held.filter(reduce(or_, [F.col(v).isNotNull() for v in values])).groupBy("__key", "i", *values).agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """__key and, for each new name, the commonest value of a column (the least of equally common ones), in two levels:
    (key, value) counts, then the best of them, so no task holds a key's values."""
    counts = _counted(df, key, {n: quoted(c) for n, c in columns.items()})
    best = [F.min(F.when(F.col("i") == i, F.struct((-F.col("n")).alias("n"), F.col(f"v{i}").alias("v"))))["v"].alias(n) for i, n in enumerate(columns)]
    return counts.groupBy("__key").agg(*best)


def medians(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """__key and, for each new name, the exact median of a numeric column, as a double.

    (key, value) counts are summed over steps of the value's logarithm, which order them; running sums over a key's steps
    tell where the two middle rows are, and only in those steps values are ordered. NaN stands behind all numbers."""
    each = {n: quoted(c).cast("double") for n, c in columns.items()}
    counts = _counted(df, key, each)
    v = F.coalesce(*[f"v{i}" for i in range(len(each))])
    size = F.floor(F.log2(F.abs("v")) * STEPS)
    step = F.when(F.isnan("v"), 1 << 40).when(F.col("v") == 0, 0).when(F.col("v") > 0, F.lit(1 << 30) + size).otherwise(F.lit(-(1 << 30)) - size)
    counts = counts.select("__key", "i", "n", v.alias("v")).withColumn("step", step)
    at = ["__key", "i"]
    steps = counts.groupBy(*at, "step").agg(F.sum("n").alias("m"))
    upto = Window.partitionBy(*at).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"before": F.sum("m").over(upto) - F.col("m"), "rows": F.sum("m").over(Window.partitionBy(*at))})
    low, high = F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)
    steps = steps.filter((F.col("before") <= high) & (F.col("before") + F.col("m") > low)).drop("m")
    inner = Window.partitionBy(*at, "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(steps, [*at, "step"]).withColumn("upto", F.col("before") + F.sum("n").over(inner))
    pick = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    found = ranked.groupBy(*at).agg(((pick(low) + pick(high)) / 2).alias("median"))
    return found.groupBy("__key").agg(*[F.max(F.when(F.col("i") == i, F.col("median"))).alias(n) for i, n in enumerate(each)])


def estimated_bytes(df: DataFrame) -> int:
    """What the planner takes a DataFrame's size to be; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def grouped(candidate: Candidate, names: dict[str, str], one_pass: int = ONE_PASS) -> DataFrame:
    """__key and the aggregated columns of a candidate, column -> new name; null keys, which meet nothing, are left out.

    Modes and medians need all values of a key: they are taken in one aggregation only where the candidate is small."""
    df, key = candidate.df, candidate.key
    rows = df.filter(quoted(key).isNotNull())
    if not names:
        return rows.select(quoted(key).alias("__key")).distinct()
    sums = {n: F.first(quoted(c)) if c == key else aggregate(candidate, c) for c, n in names.items()}
    large = (estimated_bytes(df) if candidate.size is None else candidate.size) > one_pass
    of = lambda f: {n: c for c, n in names.items() if large and c != key and function_of(candidate, c) == f}
    apart = {"most_common": (modes, of("most_common")), "median": (medians, of("median"))}
    split = {n for _, held in apart.values() for n in held}
    out = rows.groupBy(quoted(key).alias("__key")).agg(*([c.alias(n) for n, c in sums.items() if n not in split] or [F.count(F.lit(1)).alias("__rows")])).drop("__rows")
    for take, held in apart.values():
        if held:
            out = out.join(take(df, key, held), "__key", "left")
    return out.select("__key", *[quoted(n) for n in names.values()])


def is_unique(df: DataFrame, key: str) -> bool:
    """Whether no two rows share the key and none lacks it."""
    return df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | quoted(key).isNull()).isEmpty()


def guarded(candidate: Candidate) -> Candidate:
    """The granularity guard: candidate as it may be joined, unique only if its key is."""
    return replace(candidate, unique=candidate.unique and is_unique(candidate.df, candidate.key))


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether columns of these types may be joined on."""
    return a == b or (isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType))


def attach(left: Composed, candidate: Candidate, keep_key: bool = False, lineage: Composed | None = None, usable: set[tuple[str, str]] | None = None, looked: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> Composed:
    """left with the candidate's columns, one row for each row of left. Null keys never match.

    looked: the candidate's aggregated columns under their own names and ``__key``, where they are at hand. hold: what
    writes them and reads them back, where they are not.

    lineage: where the candidate is composed itself, with ``keep_key`` its key stays a column. usable: the (dataset,
    column) pairs that may be joined on, if only those may."""
    key, own = candidate.key, candidate.df
    if usable is not None:
        at = (left.provenance.get(candidate.base_column), left.originals.get(candidate.base_column))
        of = (lineage.provenance[key], lineage.originals[key]) if lineage and key in lineage.provenance else (candidate.dataset, key)
        if not {at, of} <= usable:
            raise ComposeError(f"flagged columns cannot be joined on: {sorted(x for x in (at, of) if x not in usable)}")
    if candidate.base_column not in left.df.columns or key not in own.columns:
        raise ComposeError(f"no such column: {candidate.base_column} or {key}")
    a, b = left.df.schema[candidate.base_column].dataType, own.schema[key].dataType
    candidate = guarded(candidate)
    if not comparable(a, b):
        raise ComposeError(f"{candidate.base_column} is {a.simpleString()}, {key} is {b.simpleString()}")
    members = set(lineage.datasets) if lineage else {candidate.dataset}
    if members & set(left.datasets):
        raise ComposeError(f"already part of it: {sorted(members & set(left.datasets))}")
    taken, names, renamed = set(left.df.columns), {}, {}
    for c in own.columns:
        if c == key and not keep_key:
            continue
        name = c
        if name in taken:
            stem = name = f"{c}__{lineage.provenance[c] if lineage else candidate.dataset}"
            n = 2
            while name in taken:
                name, n = f"{stem}_{n}", n + 1
            renamed[name] = c
        taken.add(name)
        names[c] = name
    if candidate.unique:
        prepared = own.select(quoted(key).alias("__key"), *[quoted(c).alias(n) for c, n in names.items()])
    elif looked is not None:
        prepared = looked.select("__key", *[quoted(c).alias(n) for c, n in names.items()])
    else:
        prepared = grouped(candidate, names)
    prepared = hold(prepared) if hold and looked is None else prepared
    df = left.df.join(prepared, quoted(candidate.base_column) == F.col("__key"), "left").drop("__key")
    source = {n: lineage.provenance[c] if lineage else candidate.dataset for c, n in names.items()}
    original = {n: lineage.originals[c] if lineage else c for c, n in names.items()}
    at, of = left.recipe_of(candidate.base_column), lineage.recipe_of(key) if lineage else [candidate.dataset, key]
    right = lineage.recipe if lineage else {"table": candidate.dataset, "columns": own.columns}
    how = {"aggregations": candidate.aggregations, "unique": candidate.unique, "order": candidate.order, "keep_key": keep_key}
    recipe = {"left": left.recipe, "right": right, "at": at, "key": of, **how}
    return replace(left, df=df, recipe=recipe, provenance=left.provenance | source, originals=left.originals | original, protected=tuple(dict.fromkeys((*left.protected, candidate.base_column, *((names[key],) if key in names else ())))), aggregated=left.aggregated + (() if candidate.unique else (candidate.dataset,)), renamed=left.renamed | renamed, lookups=(*left.lookups, Lookup(candidate.base_column, prepared, tuple(names.values()))))


def star(left: Composed, candidates: list[Candidate], usable: set[tuple[str, str]] | None = None) -> Composed:
    if not candidates:
        raise ComposeError("no candidate")
    for c in candidates:
        left = attach(left, c, usable=usable)
    return left


@dataclass(frozen=True)
class Step:
    """One join of a chain: candidate (base_column is the original name in base_dataset)."""

    candidate: Candidate
    base_dataset: str


def chain(root: Composed, steps: list[Step]) -> Composed:
    """Steps applied in order; each attaches to a dataset already folded in, the first to the root. One lazy plan."""
    for i, s in enumerate(steps):
        if i == 0 and s.base_dataset != root.datasets[0]:
            raise ComposeError("the first step must start at the root")
        column = root.column_of(s.base_dataset, s.candidate.base_column)
        if column is None:
            raise ComposeError(f"{s.base_dataset}.{s.candidate.base_column} is not part of the chain")
        root = attach(root, replace(s.candidate, base_column=column))
    return root


def merge(left: Composed, base_column: str, right: Composed, key: str, aggregations: dict[str, str] | None = None, unique: bool = False, hold: Callable[[DataFrame], DataFrame] | None = None) -> Composed:
    """Two composites joined; the right one's key stays as a column."""
    size = estimated_bytes(right.root) * len(right.df.columns) // max(1, len(right.root.columns)) if right.lookups else None
    return attach(left, Candidate("", right.df, key, base_column, aggregations or {}, unique, size=size), keep_key=True, lineage=right, hold=hold)


@dataclass(frozen=True)
class Chain:
    """A chain built step by step: every state it has had, which no later step changes."""

    states: tuple[Composed, ...]

    @staticmethod
    def of(dataset: str, df: DataFrame) -> Chain:
        return Chain((base(dataset, df),))

    @property
    def now(self) -> Composed:
        return self.states[-1]

    def then(self, *steps: Step) -> Chain:
        """One iteration more: the steps attached to what is there."""
        made = self.now
        for s in steps:
            column = made.column_of(s.base_dataset, s.candidate.base_column)
            if column is None:
                raise ComposeError(f"{s.base_dataset}.{s.candidate.base_column} is not part of the chain")
            made = attach(made, replace(s.candidate, base_column=column))
        return Chain((*self.states, made))

    def at(self, i: int) -> Chain:
        """The chain as it was after i iterations; 0 is the root alone."""
        if not 0 <= i < len(self.states):
            raise ComposeError(f"no iteration {i}")
        return Chain(self.states[: i + 1])

    def searchable(self, usable: set[tuple[str, str]]) -> list[tuple[str, str, str]]:
        """(column, dataset, original) of the columns that go back to a usable one, and so can be joined on next."""
        now = self.now
        return [(c, now.provenance[c], now.originals[c]) for c in now.df.columns if (now.provenance[c], now.originals[c]) in usable]


def match_rate(composed: Composed, new: list[str]) -> DataFrame:
    """One row: the share of rows with a value in any newly attached column; 1 if there is none."""
    hit = F.avg(F.when(F.coalesce(*[quoted(c).cast("string") for c in new]).isNotNull(), 1.0).otherwise(0.0)) if new else F.lit(1.0)
    return composed.df.agg(F.coalesce(hit, F.lit(0.0)).alias("match_rate"))
