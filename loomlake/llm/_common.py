"""What the operators of this subpackage share: shared scratch tables, tables by path, word forms.

Words of the contracts are ASCII-whitespace runs; ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at
exactly \\x20 and \\x09-\\x0D, so both are used on the UTF-8 bytes of a text.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Spark's translate() takes it.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and everything runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_folder:
        _own_folder["path"] = "file://" + tempfile.mkdtemp(prefix="spark-loomlake-")
    return _own_folder["path"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation.

    The folder is scratch space: its tables serve one run and may be deleted after it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, written, with ``place``: gapless from 0 in the given order. Rows alike in it are interchangeable.

    Range partitions are sorted each on its own; of each, only its number of rows reaches the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = written(ranged, name)
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r.part: r.n for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, n = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(n)
        n += sizes.get(k, 0)
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), part)
    return held.withColumn("place", start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written df as it may be joined: broadcast if it has at most so many rows, which are counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def word_count(text: Column) -> Column:
    """Words that ASCII white space parts; null for a null text."""
    return F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for sessions that were started without it on their Python path."""
    from pathlib import Path
    from zipfile import ZipFile

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-loomlake-code-"), "loomlake_code.zip")  # served as long as the session lives
    with ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with the code that function needs."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
