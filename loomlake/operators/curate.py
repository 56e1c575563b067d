"""Curation of a composed table: columns that add nothing go, the rest is grouped by statistical dependence."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import quoted
from .compose import Composed
from .profile import ranked, value_counts

# Thresholds and bin counts.
NEAR_BIJECTION, LEAST_VALUES, MOSTLY_NULL, PRIMARY_KEY = 0.98, 3, 0.96, 0.90
BINS, AS_CATEGORIES, HEAVY_TAIL, RELATED = 10, 30, 2.0, 4.0
#: Pairs of columns that a row is unfolded into at a time; share of distinct values from which a column identifies rows.
BLOCK, IDENTIFIER = 256, 0.90
#: Rows of which the codes are counted at a time.
BATCH = 1 << 18
#: Values of a column that is counted by codes, those of all such columns, and cells that a task holds for pairs, at most.
DENSE, WORDS, CELLS = 16_384, 1 << 18, 4 << 20
#: Rows by pairs up to which hashes do for all columns: Python workers would take longer to start.
FEW = 20_000_000


class Groups:
    """Union-find over names; columns of one table, so a few thousand at most."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a

    def sets(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return sorted((sorted(v) for v in out.values()), key=lambda v: (-len(v), v[0]))


@dataclass(frozen=True)
class Digest:
    """What value counts say of columns: the share of rows without a value, the values between bins of those that are
    binned, and, once they are, distinct values and rows with one (sizes()) and the counts of columns of DENSE values at most."""

    nulls: dict[str, float]
    edges: dict[str, list[float]]
    size: dict[str, tuple[int, int]]
    counts: DataFrame

    def of(self, mark: str) -> Digest:
        """The columns whose names begin with a mark, without it."""
        own = lambda held: {c.removeprefix(mark): v for c, v in held.items() if c.startswith(mark)}
        counts = self.counts.filter(F.col("column").isin([c for c in self.size if c.startswith(mark)]))
        return Digest(own(self.nulls), own(self.edges), own(self.size), counts.withColumn("column", F.substr("column", F.lit(len(mark) + 1))))

    def plus(self, other: Digest) -> Digest:
        return Digest(self.nulls | other.nulls, self.edges | other.edges, self.size | other.size, self.counts.unionByName(other.counts))


def digest(counts: DataFrame, numbers: list[str], keep) -> Digest:
    """The digest of written value counts; numbers: the numeric columns. A row a column is gathered."""
    some, f = F.col("value").isNotNull(), F.col("freq")
    missing = ~some | (F.col("column").isin(numbers) & (F.col("value") == "NaN"))
    sums = [F.count("value").alias("u"), F.coalesce(F.sum(F.when(some, f)), F.lit(0)).alias("n"), (F.sum(F.when(missing, f).otherwise(0)) / F.sum("freq")).alias("nulls")]
    found = {r["column"]: r for r in counts.groupBy("column").agg(*sums).collect()}
    edges = bin_edges(counts, numbers) if numbers else {}
    few = counts.filter(F.col("column").isin([c for c, r in found.items() if r.u <= DENSE and c not in edges])).select("column", "value", "freq")
    if edges:
        table = counts.sparkSession.createDataFrame(list(edges.items()), "column string, edges array<double>")
        x = F.col("value").try_cast("double")
        beyond = [F.coalesce((F.col("x") > F.get("edges", F.lit(k))).cast("int"), F.lit(0)) for k in range(max(map(len, edges.values())))]
        code = F.when(some, reduce(add, beyond, F.lit(0)).cast("string"))
        few = few.unionAll(counts.join(F.broadcast(table), "column").withColumn("x", x).groupBy("column", code.alias("value")).agg(F.sum("freq").alias("freq")))  # a row a column
    few = keep(few, "values")
    size = {c: (r.u, r.n) for c, r in found.items()} | (sizes(few.filter(F.col("column").isin(list(edges))), list(edges)) if edges else {})
    return Digest({c: r.nulls for c, r in found.items()}, edges, size, few)


@dataclass(frozen=True)
class Face:
    """Rows that stand for those of a composed table in some of its columns. The first face is the table's root. The others
    have a row for each value (``__key``) of the root's column ``on``, how many rows have it (``__n``), and the columns that
    are a function of it."""

    df: DataFrame
    columns: tuple[str, ...]
    on: str | None = None


@dataclass(frozen=True)
class Faces:
    """The faces of a composed table and the digest of all its columns."""

    parts: list[Face]
    digest: Digest

    def of(self, columns: list[str]) -> Face | None:
        """The face that has all of some columns."""
        return next((f for f in self.parts if set(columns) <= set(f.columns)), None)


def faces(made: Composed, values: Callable[[str], DataFrame], root: Digest, keep) -> Faces:
    """values(column): __key and __n of a column of the composed table's root; root: the digest of its root, where floats
    count as doubles; keep(df, name): what writes."""
    of, parts, counts = made.determinants(), [Face(as_doubles(made.root), tuple(made.root.columns))], []
    for on in dict.fromkeys(of[held.on] for held in made.lookups):
        columns = [c for held in made.lookups if of[held.on] == on for c in held.columns]
        if columns:
            parts.append(Face(keep(made.spread(values(on), on), "face"), tuple(columns), on))
            counts.append(value_counts(parts[-1].df, columns, weight="__n"))
    if not counts:
        return Faces(parts, root)
    numbers = [f.name for x in parts[1:] for f in x.df.schema if f.name in x.columns and isinstance(f.dataType, T.NumericType)]
    return Faces(parts, root.plus(digest(keep(reduce(DataFrame.unionAll, counts), "face-counts"), numbers, keep)))


def as_doubles(df: DataFrame) -> DataFrame:
    """df with its columns of single precision as doubles, as bins take them."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType)]
    return df.withColumns({c: quoted(c).cast("double") for c in floats}) if floats else df


def cells(df: DataFrame, pairs: list[tuple[str, str]], counts: DataFrame, size: dict[str, tuple[int, int]], coded: frozenset[str] = frozenset()) -> DataFrame:
    """pair (its place in pairs), a, b, n: how often each two values meet, over rows where both columns have one.
    counts: the value counts of the columns; size: what sizes() makes of them; coded: columns of long integers, which stand
    for themselves in a and b.

    a and b stand for values and mean nothing else. Columns of DENSE values at most (those with fewest first, WORDS values
    in all) get dictionary codes (their dictionaries are gathered) and, where a pair's cells fit CELLS, are counted in numpy
    matrices of a cell for each two codes, in blocks of pairs that fit CELLS; the other pairs, and all where there is little to count, by 64-bit hashes of their values, in blocks of BLOCK pairs.
    Either way cells are counted before the shuffle, whose size hangs on cells and not on rows."""
    rows = max((n for _, n in size.values()), default=0)
    dense, left = set(), WORDS if rows * len(pairs) > FEW else -1
    for u, c in sorted((u, c) for c, (u, _) in size.items()):
        if u > min(DENSE, left):
            break
        dense.add(c)
        left -= u
    small = [k for k, (a, b) in enumerate(pairs) if a in dense and b in dense and size[a][0] * size[b][0] <= CELLS]
    out = []
    if small:
        names = sorted({c for k in small for c in pairs[k]})
        words: dict[str, list[str]] = {c: [] for c in names}
        for r in counts.filter(F.col("value").isNotNull() & F.col("column").isin(names)).select("column", "value").collect():
            words[r["column"]].append(r["value"])
        whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
        codes = df.select(*[quoted(c).cast("long" if c in whole else "string").alias(f"c{i}") for i, c in enumerate(names)])
        held = [([int(w) for w in words[c]] if c in whole else words[c], c in whole, c in coded) for c in names]
        at, blocks, room = {c: i for i, c in enumerate(names)}, [[]], CELLS
        for k in small:
            x, y = pairs[k]
            cost = max(1, len(words[x]) * len(words[y]))
            if cost > room and blocks[-1]:
                blocks.append([])
                room = CELLS
            blocks[-1].append((k, at[x], at[y], len(words[x]), max(1, len(words[y]))))
            room -= cost
        for block in blocks:
            out.append(codes.mapInArrow(_dense_counts(block, held), "pair int, a long, b long, n long").groupBy("pair", "a", "b").agg(F.sum("n").alias("n")))
    rest = [(k, *p) for k, p in enumerate(pairs) if k not in set(small)]
    return reduce(DataFrame.unionAll, out + _unfolded(df, rest, coded))


def _unfolded(df: DataFrame, pairs: list[tuple[int, str, str]], coded: frozenset[str] = frozenset(), weight: str | None = None) -> list[DataFrame]:
    """cells() of pairs (number, column, column) by hashes of the values, in blocks. weight: how many rows a row stands for."""
    names, out = sorted({c for _, *p in pairs for c in p}), []
    code = lambda c: quoted(c).cast("long") if c in coded else F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c).cast("string")))
    codes = df.select(F.array(*map(code, names)).alias("codes"), (quoted(weight) if weight else F.lit(1)).cast("long").alias("n"))
    at = {c: i for i, c in enumerate(names)}
    for first in range(0, len(pairs), BLOCK):
        block = json.dumps([{"p": k, "i": at[x], "j": at[y]} for k, x, y in pairs[first : first + BLOCK]])
        places = F.from_json(F.lit(block), "array<struct<p:int,i:int,j:int>>")
        met = F.transform(places, lambda x: F.struct(x["p"].alias("pair"), F.get("codes", x["i"]).alias("a"), F.get("codes", x["j"]).alias("b")))
        each = codes.select("n", F.explode(met).alias("x")).select("x.*", "n").filter("a IS NOT NULL AND b IS NOT NULL")
        out.append(each.groupBy("pair", "a", "b").agg(F.sum("n").alias("n")))
    return out


def _dense_counts(block: list[tuple[int, int, int, int, int]], words: list[tuple[list, bool, bool]]):
    """For mapInArrow: a task's counts of the pairs (place, column, column, values of each) of a block, in one matrix each,
    whose first row and column are for nulls. words: a column's values, whether they are numbers, whether they are codes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        held = {k: np.zeros((n + 1) * (m + 1), np.int64) for k, _, _, n, m in block}
        used = sorted({c for _, i, j, _, _ in block for c in (i, j)})
        values = {c: pa.array(words[c][0], pa.int64() if words[c][1] else pa.string()) for c in used}
        waiting: list[dict] = []

        def count():
            codes = {c: np.concatenate([w[c] for w in waiting]) for c in used} if waiting else {}
            waiting.clear()
            for k, i, j, _, m in block if codes else []:
                both = codes[i] * (m + 1) + codes[j]
                if len(held[k]) <= len(both):
                    held[k] += np.bincount(both, minlength=len(held[k]))
                else:
                    np.add.at(held[k], both, 1)

        rows = 0
        for batch in batches:
            waiting.append({c: pc.fill_null(pc.add(pc.index_in(batch.column(c).cast(values[c].type), value_set=values[c]).cast(pa.int64()), 1), 0).to_numpy(zero_copy_only=False) for c in used})
            rows += batch.num_rows
            if rows >= BATCH:
                count()
                rows = 0
        count()
        for k, i, j, _, m in block:
            a, b = np.divmod(np.flatnonzero(held[k]), m + 1)
            some = (a > 0) & (b > 0)
            a, b = a[some], b[some]
            if len(a):
                n = held[k].reshape(-1, m + 1)[a, b]
                a, b = (np.array(words[c][0], np.int64)[x - 1] if words[c][2] else x - 1 for c, x in ((i, a), (j, b)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int32)), pa.array(a), pa.array(b), pa.array(n)], ["pair", "a", "b", "n"])

    return run


def _named(found: DataFrame, pairs: list[tuple[str, str]], *columns) -> DataFrame:
    """found (pair, ...) as column_1, column_2 and the given columns."""
    names = F.from_json(F.lit(json.dumps([{"x": x, "y": y} for x, y in pairs])), "array<struct<x:string,y:string>>")
    return found.withColumn("_of", F.get(names, F.col("pair"))).select(F.col("_of.x").alias("column_1"), F.col("_of.y").alias("column_2"), *columns)


def sizes(counts: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """column -> (distinct values, rows with one), from value counts; one row a column reaches the driver."""
    found = counts.filter("value IS NOT NULL").groupBy("column").agg(F.count(F.lit(1)).alias("u"), F.sum("freq").alias("n")).collect()
    return dict.fromkeys(columns, (0, 0)) | {r["column"]: (r.u, r.n) for r in found}


def pair_bijection(df: DataFrame, columns: list[str], known: Digest | None = None) -> DataFrame:
    """column_1, column_2, ratio: the number of values over the number of value pairs, for columns of equal cardinality.
    known: their digest, if it is at hand."""
    counts = known.counts if known else value_counts(df, columns)
    size = {c: known.size[c] for c in columns} if known else sizes(counts, columns)
    n = {c: u for c, (u, _) in size.items()}
    tested = [(a, b) for a, b in combinations(sorted(columns), 2) if n[a] == n[b] >= LEAST_VALUES]
    if not tested:
        return df.sparkSession.createDataFrame([], "column_1 string, column_2 string, ratio double")
    found = cells(df, tested, counts, size).groupBy("pair").agg(F.count(F.lit(1)).alias("met"))
    values = F.get(F.from_json(F.lit(json.dumps([n[a] for a, _ in tested])), "array<bigint>"), F.col("pair"))
    return _named(found, tested, (values / F.col("met")).alias("ratio"))


def redundant_groups(composed: Composed, usable: set[tuple[str, str]], keep: set[str] = frozenset(), faces: Faces | None = None) -> list[tuple[str, list[str]]]:
    """(kept column, all columns) of each group of near one-to-one text columns of the same source. faces: see faces(), which
    spares the rows of the composed table, here and below."""
    by_source: dict[str, list[str]] = {}
    for c in composed.df.columns:
        if isinstance(composed.df.schema[c].dataType, T.StringType) and (composed.provenance[c], composed.originals[c]) in usable:
            by_source.setdefault(composed.provenance[c], []).append(c)
    groups = Groups()
    for columns in by_source.values():
        if len(columns) > 1:
            face = faces and faces.of(columns)
            found = pair_bijection(face.df, columns, faces.digest) if face else pair_bijection(composed.df, columns)
            for r in found.filter(F.col("ratio") >= NEAR_BIJECTION).collect():
                groups.join(r.column_1, r.column_2)
    return [(next((c for c in g if c in keep), g[0]), g) for g in groups.sets()]


def restricted(groups: list[tuple[str, list[str]]], columns: list[str], keep: set[str] = frozenset()) -> list[tuple[str, list[str]]]:
    """Groups of redundant columns once only some columns are left: those with two of them or more, and what each keeps."""
    left = set(columns)
    held = [[c for c in g if c in left] for _, g in groups]
    return [(next((c for c in g if c in keep), min(g)), g) for g in held if len(g) > 1]


def null_shares(df: DataFrame) -> DataFrame:
    """column, share of rows without a value (NaN is none)."""
    missing = lambda f: quoted(f.name).isNull() | F.isnan(quoted(f.name)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name).isNull()
    one = df.agg(*[F.avg(missing(f).cast("int")).alias(f"c{i}") for i, f in enumerate(df.schema)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_share")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def mostly_null(df: DataFrame, protected: set[str] = frozenset(), faces: Faces | None = None) -> list[str]:
    if faces:
        return [c for c in df.columns if c not in protected and (faces.digest.nulls.get(c) or 0.0) >= MOSTLY_NULL]
    return [r["column"] for r in null_shares(df).filter(F.col("null_share") >= MOSTLY_NULL).collect() if r["column"] not in protected]


def unused_keys(composed: Composed, uniqueness: dict[tuple[str, str], float]) -> list[str]:
    """Text columns that identify rows of their source and are not joined on."""
    return [c for c in composed.df.columns if isinstance(composed.df.schema[c].dataType, T.StringType) and c not in composed.protected and uniqueness.get((composed.provenance[c], composed.originals[c]), 0.0) >= PRIMARY_KEY]


def declutter(composed: Composed, usable: set[tuple[str, str]], uniqueness: dict[tuple[str, str], float], keys: bool = True, redundant: bool = True, nulls: bool = True, faces: Faces | None = None) -> list[str]:
    """Columns to drop, in the table's order; protected ones never."""
    keep, out = set(composed.protected), set()
    if keys:
        out |= set(unused_keys(composed, uniqueness))
    if redundant:
        out |= {c for kept, g in redundant_groups(composed, usable, keep, faces) for c in g if c != kept}
    if nulls:
        out |= set(mostly_null(composed.df, keep, faces))
    return [c for c in composed.df.columns if c in out - keep]


def binned(df: DataFrame, bins: int = BINS, keep=None) -> DataFrame:
    """All columns as categories: whole numbers with few values as they are, other numbers in right-closed bins, of
    equal depth where the tails are heavy, else of equal width.

    Quantiles, moments and distinct values come from one table of value counts, which keep(df, name) writes."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not numbers:
        return df
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType)}
    counts = value_counts(df.select(*[quoted(c).cast("double").alias(c) if c in floats else quoted(c) for c in numbers]))
    counts = keep(counts, "numbers") if keep else counts
    return df.withColumns({c: _label(c, edges) for c, edges in bin_edges(counts, numbers, bins).items()})


def _label(column: str, edges: list[float]) -> Column:
    """The number of a value's bin; edges: the values between bins, each of the bin before it."""
    x = quoted(column).cast("double")
    label = F.when(x.isNull(), None)
    for k, edge in enumerate(edges):
        label = label.when(x <= edge, k)
    return label.otherwise(len(edges)).cast("int")


def bin_edges(counts: DataFrame, numbers: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """The values between the bins of each numeric column that is binned, from its value counts; a row a column is gathered."""
    counts = counts.filter(F.col("column").isin(numbers))
    x, n = F.col("value").try_cast("double"), F.col("freq")
    held = counts.filter("value IS NOT NULL").select("column", x.alias("v"), n.alias("n"))
    cuts = {r["column"]: r.q for r in ranked(held.filter(~F.isnan("v")), [k / bins for k in range(bins + 1)]).collect()}  # one row a column
    v, n = F.col("v"), F.col("n")
    sums = held.groupBy("column").agg(F.count(v).alias("d"), F.sum(F.when(v != F.floor(v), n).otherwise(0)).alias("w"), F.sum(n).alias("rows"), (F.sum(v * n) / F.sum(n)).alias("mean"))
    square = (v - F.col("mean")) * (v - F.col("mean"))
    moments = held.join(F.broadcast(sums), "column").withColumn("square", square).groupBy(*sums.columns).agg(F.sum(n * F.col("square")).alias("m2"), F.sum(n * F.col("square") * F.col("square")).alias("m4"))  # one row a column
    stats, out = {r["column"]: r for r in moments.collect()}, {}
    for c in numbers:
        s, q = stats.get(c), cuts.get(c)
        if s is None or s.d <= 1 or (not s.w and s.d <= AS_CATEGORIES):
            continue
        n = s.rows
        g2 = n * s.m4 / (s.m2 * s.m2) - 3 if s.m2 * s.m2 else None
        tail = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if g2 is not None and n >= 4 else 0.0
        low, high = q[0], q[-1]
        edges = sorted(set(q)) if abs(tail) > HEAVY_TAIL else [low + (high - low) * k / bins for k in range(bins + 1)]
        out[c] = edges[1:-1]
    return out


def dependence(df: DataFrame, columns: list[str] | None = None, keep=None) -> DataFrame:
    """(column_1, column_2, soundness) of all pairs of categorical columns, over rows where both have a value.

    log2 of the standardised chi-square, (chi2 - dof) / sqrt(2 dof), 0 where that is below 1: it grows with the evidence,
    does not depend on row order, and is near 0 for independent columns. Columns that identify rows (IDENTIFIER of their
    values distinct, and more than AS_CATEGORIES of them) depend on nothing: with one row a value there is no evidence,
    so they score 0 and are not counted. keep(df, name): what writes the value counts and the cells, which are read again."""
    columns = sorted(columns or df.columns)
    none = df.sparkSession.createDataFrame([], "column_1 string, column_2 string, soundness double")
    if len(columns) < 2:
        return none
    counts = value_counts(df, columns)
    counts = keep(counts, "values") if keep else counts
    size = sizes(counts, columns)
    tested, zero = _tested(df, columns, size)
    if not tested:
        return zero
    met = cells(df, tested, counts, size)
    return _scores(keep(met, "cells") if keep else met, tested).unionByName(zero)


def _tested(df: DataFrame, columns: list[str], size: dict[str, tuple[int, int]]) -> tuple[list[tuple[str, str]], DataFrame]:
    """The pairs to count, and the scores of the others."""
    single = {c for c, (u, n) in size.items() if u > AS_CATEGORIES and u >= IDENTIFIER * n}
    tested = [(a, b) for a, b in combinations(columns, 2) if not {a, b} & single]
    blank = [(a, b, 0.0) for a, b in combinations(columns, 2) if {a, b} & single and size[a][1] and size[b][1]]
    return tested, df.sparkSession.createDataFrame(blank, "column_1 string, column_2 string, soundness double")


def _scores(met: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The soundness of each pair, from its cells."""
    left = met.groupBy("pair", "a").agg(F.sum("n").alias("r"))
    right = met.groupBy("pair", "b").agg(F.sum("n").alias("c"))
    held = met.join(left, ["pair", "a"]).join(right, ["pair", "b"])
    inner = held.groupBy("pair").agg(F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"), F.sum("n").alias("n"))
    spread = left.groupBy("pair").agg(F.count(F.lit(1)).alias("R")).join(right.groupBy("pair").agg(F.count(F.lit(1)).alias("K")), "pair")
    dof = ((F.col("R") - 1) * (F.col("K") - 1)).cast("double")
    z = (F.col("n") * (F.col("s") - 1) - dof) / F.sqrt(2 * dof)
    score = F.round(F.when(dof > 0, F.log2(F.greatest(z, F.lit(1.0)))).otherwise(0.0), 6)
    return _named(inner.join(spread, "pair"), pairs, score.alias("soundness"))


def dependence_of(faces: Faces, columns: list[str], keep) -> DataFrame:
    """dependence() of the binned columns of a composed table, from its faces.

    Only the root's columns are counted on its rows. What is a function of a root's column is one more column there, its
    class: a number for all the values (of the columns that are tested) that a value of the root's column has. Cells of
    classes are unfolded to those of their columns."""
    columns, root = sorted(columns), faces.parts[0].df
    if len(columns) < 2:
        return root.sparkSession.createDataFrame([], "column_1 string, column_2 string, soundness double")
    size = dict.fromkeys(columns, (0, 0)) | faces.digest.size
    tested, zero = _tested(root, columns, size)
    if not tested:
        return zero
    met = keep(_cells_of(faces, columns, sorted({c for p in tested for c in p}), size, keep), "cells")
    return _scores(met, [(x, y) for x in columns for y in columns]).unionByName(zero)


def _cells_of(faces: Faces, columns: list[str], live: list[str], size: dict[str, tuple[int, int]], keep) -> DataFrame:
    """The cells of all pairs of ``live`` columns; a pair's number is its place among columns by columns."""
    at, place = {c: i for i, c in enumerate(columns)}, lambda x, y: at[x] * len(columns) + at[y]
    edges = faces.digest.edges
    label = lambda c: _label(c, edges[c]) if c in edges else quoted(c)
    root, *others = faces.parts
    own = [c for c in live if c in root.columns]
    looked = [(f, held) for f in others if (held := [c for c in live if c in f.columns])]
    axes = root.df.select(*[label(c).alias(c) for c in own], *[quoted(f.on).alias(f"__on{i}") for i, (f, _) in enumerate(looked)])
    parts, named, members, out = [faces.digest.counts.filter(F.col("column").isin(own))], [], [], []
    for i, (f, held) in enumerate(looked):
        values = f.df.select("__key", "__n", *[label(c).cast("string").alias(f"c{at[c]}") for c in held])
        each = [f"c{at[c]}" for c in held]
        classed = keep(values.withColumn("__class", F.when(F.coalesce(*each).isNotNull(), F.xxhash64(F.to_json(F.struct(*each))))), "classes")
        axes = axes.join(classed.select(F.col("__key").alias(f"__key{i}"), F.col("__class").alias(f"__class{i}")), F.col(f"__on{i}") == F.col(f"__key{i}"), "left").drop(f"__on{i}", f"__key{i}")
        classes = classed.filter("__class IS NOT NULL").groupBy("__class", *each).agg(F.sum("__n").alias("__n"))
        named.append(f"__class{i}")
        parts.append(classes.select(F.lit(named[-1]).alias("column"), F.col("__class").cast("string").alias("value"), F.col("__n").alias("freq")))
        texts = F.array(*[F.struct(F.lit(at[c]).alias("of"), F.col(f"c{at[c]}").alias("value")) for c in held])
        member = classes.select(F.lit(i).alias("axis"), F.col("__class").alias("class"), F.explode(texts).alias("x")).filter("x.value IS NOT NULL")
        members.append(member.select("axis", "class", F.col("x.of").alias("of"), F.xxhash64("x.value").alias("value")))
        inside = [(place(x, y), f"c{at[x]}", f"c{at[y]}") for x, y in combinations(held, 2)]
        out += _unfolded(classes, inside, weight="__n") if inside else []
    pairs = list(combinations([*own, *named], 2))
    if pairs:
        held = reduce(DataFrame.unionAll, parts)
        met = keep(cells(axes, pairs, held, sizes(held, named) | {c: size[c] for c in own}, frozenset(named)), "met")
        axis = {n: i for i, n in enumerate(named)}
        sides = axes.sparkSession.createDataFrame([(k, axis.get(x), at.get(x), axis.get(y), at.get(y)) for k, (x, y) in enumerate(pairs)], "pair int, left int, x int, right int, y int")
        met = met.join(F.broadcast(sides), "pair")  # a row a pair
        found = [met.filter("left IS NULL AND right IS NULL").select("x", "a", "y", "b", "n")]
        if members:
            to = reduce(DataFrame.unionAll, members)
            a, b = (to.toDF(f"{s}_axis", f"{s}_class", f"{s}_of", f"{s}_value") for s in "ab")
            met = met.filter("right IS NOT NULL").join(b, (F.col("right") == F.col("b_axis")) & (F.col("b") == F.col("b_class"))).drop("b", "y")
            met = met.withColumnsRenamed({"b_of": "y", "b_value": "b"})
            found.append(met.filter("left IS NULL").select("x", "a", "y", "b", "n"))
            met = met.filter("left IS NOT NULL").join(a, (F.col("left") == F.col("a_axis")) & (F.col("a") == F.col("a_class"))).drop("a", "x")
            found.append(met.withColumnsRenamed({"a_of": "x", "a_value": "a"}).select("x", "a", "y", "b", "n"))
        met, turned = reduce(DataFrame.unionAll, found), F.col("x") > F.col("y")
        swap = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
        pair = (swap("x", "y") * len(columns) + swap("y", "x")).cast("int")
        out.append(met.select(pair.alias("pair"), swap("a", "b").alias("a"), swap("b", "a").alias("b"), "n").groupBy("pair", "a", "b").agg(F.sum("n").alias("n")))
    return reduce(DataFrame.unionAll, out)


def relationship_edges(soundness: DataFrame, threshold: float = RELATED) -> DataFrame:
    """Undirected edges: the greatest score of each pair of different columns, at the threshold or above."""
    return soundness.filter((F.col("column_1") != F.col("column_2")) & (F.col("soundness") >= threshold)).groupBy(F.least("column_1", "column_2").alias("column_1"), F.greatest("column_1", "column_2").alias("column_2")).agg(F.max("soundness").alias("soundness"))


def clusters(columns: list[str], edges: list[tuple[str, str]], protected: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """cluster_1, cluster_2, ... by size and first name, and ``unclustered``; protected columns lead each."""
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    sets = groups.sets()
    loose = [c for c in columns if c not in protected and c not in groups.up]
    named = {f"cluster_{i}": s for i, s in enumerate(sets, 1)} | ({"unclustered": loose} if loose else {})
    return {k: [c for c in columns if c in protected] + [c for c in columns if c in set(s) - set(protected)] for k, s in named.items()}


def curate(composed: Composed, threshold: float = RELATED, keep=None, faces: Faces | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(all pair scores, the table without columns that relate to nothing, the clusters), from one scoring pass. keep: see
    dependence(); with it the binned table is written too, as every block of pairs reads it. With faces, the same scores come
    from these."""
    scored = [c for c in composed.df.columns if c not in composed.protected]
    if faces and keep:
        soundness = keep(dependence_of(faces, scored, keep), "soundness")
    else:
        bins = binned(composed.df.select(*[quoted(c) for c in scored]), keep=keep)
        soundness = dependence(keep(bins, "binned") if keep else bins, scored, keep)
    edges = [(r.column_1, r.column_2) for r in relationship_edges(soundness, threshold).collect()]
    related = {c for e in edges for c in e} | set(composed.protected)
    pick = lambda names: composed.df.select(*[quoted(c) for c in names])
    return soundness, pick([c for c in composed.df.columns if c in related]), {k: pick(v) for k, v in clusters(composed.df.columns, edges, composed.protected).items()}


def top_share(scores: DataFrame, share: float = 0.7) -> DataFrame:
    """The adaptive threshold: the score at place floor(share * (n - 1)) in ascending order."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # scores have six decimals, so there are few
    upto = F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("score", upto.alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("rows"))
    return ranked.filter(F.col("upto") > F.floor(F.lit(share) * (F.col("rows") - 1))).agg(F.min("score").alias("threshold"))


def normalised(scores: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    return scores.withColumn("normalised", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / top)), 3))
