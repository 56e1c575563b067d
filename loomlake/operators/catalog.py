"""The catalogue as two tables, nodes and edges, built from flagged profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curate import top_share

PRIMARY_KEY = 0.90


def build(datasets: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """datasets (dataset, row_count, flags), columns (dataset, column, main_type, unique_count, row_count, null_count, flags) -> nodes, edges."""
    of, oc = F.concat(F.lit("dataset::"), "dataset"), F.concat(F.lit("column::"), "dataset", F.lit("::"), "column")
    none = F.lit(None).cast("string")
    flags = datasets.select(of.alias("owner"), "dataset", F.explode("flags").alias("f")).unionByName(columns.select(oc.alias("owner"), "dataset", F.explode("flags").alias("f")))
    flag_id = F.concat(F.lit("flag::"), "owner", F.lit("::"), F.col("f.type"))
    nodes = datasets.select(of.alias("id"), F.lit("dataset").alias("kind"), "dataset", none.alias("name"), none.alias("main_type")).unionByName(columns.select(oc.alias("id"), F.lit("column").alias("kind"), "dataset", F.col("column").alias("name"), "main_type")).unionByName(flags.select(flag_id.alias("id"), F.lit("quality_flag").alias("kind"), "dataset", F.col("f.type").alias("name"), none.alias("main_type")))
    edges = columns.select(of.alias("source"), oc.alias("target"), F.lit("has_column").alias("relation")).unionByName(flags.select(F.col("owner").alias("source"), flag_id.alias("target"), F.lit("has_flag").alias("relation")))
    return nodes, edges


def usable(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without flagged datasets (and all of theirs) and flagged columns."""
    flagged = edges.filter("relation = 'has_flag'").select(F.col("source").alias("id")).distinct()
    clean = nodes.filter("kind <> 'quality_flag'").join(flagged, "id", "left_anti")
    kept = clean.filter("kind = 'dataset'").select("dataset")
    clean = clean.join(kept, "dataset", "left_semi")
    ids = clean.select("id")
    return clean, edges.filter("relation = 'has_column'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def usable_columns(nodes: DataFrame, main_type: str | None = None) -> DataFrame:
    """dataset, columns: of the usable nodes."""
    held = nodes.filter("kind = 'column'")
    return (held.filter(F.col("main_type") == main_type) if main_type else held).groupBy("dataset").agg(F.array_sort(F.collect_set("name")).alias("columns"))


def uniqueness(columns: DataFrame) -> DataFrame:
    some = F.col("row_count") - F.col("null_count")
    return columns.select("dataset", "column", F.when(some > 0, F.col("unique_count") / some).otherwise(0.0).alias("uniqueness"))


def eligible_bases(nodes: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset, row_count, eligible, of the usable datasets: eligible with a usable text column."""
    texts = nodes.filter("kind = 'column' AND main_type = 'string'").select("dataset").distinct().withColumn("eligible", F.lit(True))
    held = nodes.filter("kind = 'dataset'").select("dataset").join(datasets.select("dataset", "row_count"), "dataset")
    return held.join(texts, "dataset", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))


def governance(nodes: DataFrame, gold: DataFrame, scores: DataFrame, soundness: DataFrame, joins: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, relation, score, detail) of a composed run: gold (table_id, column, dataset, original), scores
    (base_dataset, base_column, candidate_dataset, candidate_column, score), soundness (source, target, score), joins
    (table_id, dataset, base_column, candidate_column, score, aggregated). Edges to missing nodes and loops are dropped."""
    of = lambda d, c: F.concat(F.lit("column::"), F.col(d), F.lit("::"), F.col(c))
    table, none, blank = F.concat(F.lit("gold::"), "table_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("detail")
    relation = lambda x: F.lit(x).alias("relation")
    dataset = F.concat(F.lit("dataset::"), "dataset")
    edges = gold.select(table.alias("source"), dataset.alias("target"), relation("built_from"), none, blank).distinct()
    edges = edges.unionByName(gold.select(table.alias("source"), of("dataset", "original").alias("target"), relation("derived_from"), none, F.col("column").alias("detail")))
    edges = edges.unionByName(scores.select(of("base_dataset", "base_column").alias("source"), of("candidate_dataset", "candidate_column").alias("target"), relation("joinable"), "score", blank))
    edges = edges.unionByName(soundness.select("source", "target", relation("statistically_related"), "score", blank))
    if joins is not None:
        how = F.concat("base_column", F.lit(" = "), "candidate_column", F.when(F.col("aggregated"), " aggregated").otherwise(""))
        edges = edges.unionByName(joins.select(table.alias("source"), dataset.alias("target"), relation("joined_via"), "score", how.alias("detail")))
    ids = nodes.select("id").unionByName(gold.select(table.alias("id"))).distinct()
    return edges.filter("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


# -- views of the graph ------------------------------------------------------------------------------------------------

#: Relations that a composed run adds about its tables.
COMPOSITION = ("built_from", "derived_from", "joined_via", "statistically_related")


def initial_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets, columns and flags, as before any composition."""
    return nodes.filter(F.col("kind").isin("dataset", "column", "quality_flag")), edges.filter(F.col("relation").isin("has_column", "has_flag")).select("source", "target", "relation")


def joinable_once(governed: DataFrame) -> DataFrame:
    """One joinable edge (source, target, score) for each two columns: the direction with the greater score, ties to the
    lesser source."""
    one = F.col("source") < F.col("target")
    best = F.min(F.struct((-F.col("score")).alias("s"), "source", "target")).alias("e")
    held = governed.filter("relation = 'joinable'").groupBy(F.when(one, F.col("source")).otherwise(F.col("target")), F.when(one, F.col("target")).otherwise(F.col("source"))).agg(best)
    return held.select("e.source", "e.target", (-F.col("e.s")).alias("score"))


def joinability_view(edges: DataFrame, governed: DataFrame, threshold: float | None = None) -> DataFrame:
    """source, target, relation, score: the columns of every dataset, and the joinable pairs from the threshold on; without
    one, from the score that about three tenths of the pairs reach."""
    joins = joinable_once(governed)
    least = top_share(joins) if threshold is None else edges.sparkSession.createDataFrame([(float(threshold),)], "threshold double")
    kept = joins.join(F.broadcast(least), F.col("score") >= F.col("threshold")).select("source", "target", F.lit("joinable").alias("relation"), "score")  # one row
    columns = edges.filter("relation = 'has_column'").select("source", "target", "relation", F.lit(None).cast("double").alias("score"))
    return columns.unionByName(kept)


def composition_view(governed: DataFrame, table: str | None = None) -> DataFrame:
    """What a run says of its tables, or of one of them: sources, columns, joins; related columns belong to no table."""
    held = governed.filter(F.col("relation").isin(*COMPOSITION))
    return held if table is None else held.filter((F.col("source") == f"gold::{table}") & (F.col("relation") != "statistically_related"))
