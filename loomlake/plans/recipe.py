"""How a composed table is made, as plain values: stored as JSON, and made again from a lake's tables in any session.

A recipe is a tree. Leaves are tables with the columns that were used; every other node joins what its two branches make,
on a column of each, named by source dataset and original name, so that renaming on the way does not matter.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import quoted
from ..operators.compose import Candidate, Composed, ComposeError, attach, base, merge


class RecipeError(ComposeError):
    """A recipe that the lake at hand cannot follow."""


def build(recipe: dict, tables: dict[str, DataFrame]) -> Composed:
    """The composed table of a recipe, lazily, from the tables of a lake."""
    if "table" in recipe:
        name = recipe["table"]
        if name not in tables:
            raise RecipeError(f"no such table: {name}")
        gone = sorted(set(recipe["columns"]) - set(tables[name].columns))
        if gone:
            raise RecipeError(f"{name} has no column {', '.join(gone)}")
        return base(name, tables[name].select(*[quoted(c) for c in recipe["columns"]]))
    left, right = build(recipe["left"], tables), build(recipe["right"], tables)
    at, key = left.column_of(*recipe["at"]), right.column_of(*recipe["key"])
    if at is None or key is None:
        raise RecipeError(f"no column to join on: {recipe['at']} or {recipe['key']}")
    if recipe["keep_key"]:
        return merge(left, at, right, key, recipe["aggregations"], recipe["unique"])
    return attach(left, Candidate(right.datasets[0], right.df, key, at, recipe["aggregations"], recipe["unique"], recipe["order"]))


def columns_of(made: Composed, wanted: list[list[str]]) -> list[str]:
    """The present names of columns given by (dataset, original); an error if one is gone."""
    found = [made.column_of(*w) for w in wanted]
    if None in found:
        raise RecipeError(f"gone: {', '.join('.'.join(w) for w, c in zip(wanted, found) if c is None)}")
    return found


def store(spark: SparkSession, folder: str, name: str, recipes: dict[str, dict]) -> None:
    """Write named recipes, or whatever plain values stand for them, as one table of JSON texts."""
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(recipes.items())]
    spark.createDataFrame(rows, "id string, recipe string").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> dict[str, dict]:
    return {r.id: json.loads(r.recipe) for r in spark.read.parquet(f"{folder.rstrip('/')}/{name}").collect()}
