"""Reading a folder of CSV or Parquet tables, preprocessing them, and keeping results fresh."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DATE_HINTS, DATE_SHARE, NUMERIC_SHARE, as_date, as_number, clean_names, clean_text, quoted
from ..operators.profile import value_counts

#: Bytes of a row group of what is written to be read again.
ROW_GROUP = 8 << 20


def list_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name -> path of the CSV and Parquet entries directly in folder, sorted, through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = {}
    for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
        name, _, kind = x.getPath().getName().rpartition(".")
        if name and kind.lower() in ("csv", "parquet"):
            found[name] = x.getPath().toString()
    return dict(sorted(found.items()))


def text_shape(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether quoted cells hold line breaks) of CSV files, from one scan of their lines on the executors.

    UTF-8 if all lines read as that, else ISO-8859-1. A line with an odd number of quotes begins or ends a cell that goes on
    in another line; without one, files can be split."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd, broken = lines.agg(F.bool_or(~F.is_valid_utf8("value")), F.bool_or(quotes % 2 == 1)).first()
    return "ISO-8859-1" if odd else "UTF-8", bool(broken)


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if all bytes of the files read as that, else ISO-8859-1; decided on the executors."""
    return text_shape(spark, path)[0]


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, breaks: bool | None = None) -> DataFrame:
    """Every cell as text, empty cells null, quoted line breaks kept, a byte order mark dropped from the first header.

    Without an encoding, UTF-8 is read, and ISO-8859-1 where the file is no UTF-8. Files without quoted line breaks are
    split over tasks; breaks says whether there are any, and the lines are looked at if it does not."""
    if encoding is None or breaks is None:
        found = text_shape(spark, path)
        encoding, breaks = encoding or found[0], found[1] if breaks is None else breaks
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=breaks, escape='"', encoding=encoding)
    return df.toDF(*[c.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf") for c in df.columns])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in a folder of our own only where all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-loomlake-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and a lost executor costs no recomputation.

    Row groups are small, so that many tasks can read what few have written."""
    path = shared_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)


def cleaned(df: DataFrame) -> DataFrame:
    """Names cleaned, text cells cleaned, NaN null."""
    df = clean_names(df)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: clean_text(quoted(c)) for c in texts} | {c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def decide(df: DataFrame, numeric_share: float = NUMERIC_SHARE, date_share: float = DATE_SHARE) -> dict[str, str]:
    """What each text column of a cleaned df becomes: ``long``, ``double`` or ``date``; those that stay are left out.

    All decisions come from the counts of values, so each distinct one is tried once. Dates are only tried where the name hints at one."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    hinted = [c for c in texts if any(h in c for h in DATE_HINTS)]
    v, f = F.col("value"), F.col("freq")
    number = as_number(v)
    date = as_date(F.when(F.col("column").isin(hinted), v)) if hinted else F.lit(None)
    rows = lambda test: F.coalesce(F.sum(F.when(test, f)), F.lit(0))
    sums = {"rows": F.sum("freq"), "held": rows(v.isNotNull()), "numbers": rows(number.isNotNull()), "whole": rows(number == F.floor(number)), "dates": rows(date.isNotNull())}
    found = value_counts(df, texts).groupBy("column").agg(*[e.alias(n) for n, e in sums.items()])
    out = {}
    for r in sorted(found.collect(), key=lambda r: texts.index(r["column"])):
        if r.held and r.numbers / r.held >= numeric_share:
            out[r["column"]] = "long" if r.whole == r.rows else "double"
        elif r.held and r["column"] in hinted and r.dates / r.held >= date_share:
            out[r["column"]] = "date"
    return out


def converted(df: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """A cleaned df with its decisions applied, in one projection."""
    return df.withColumns({c: as_date(quoted(c)) if kind == "date" else as_number(quoted(c)).cast(kind) for c, kind in decisions.items()}) if decisions else df


def preprocess(df: DataFrame, numeric_share: float = NUMERIC_SHARE, date_share: float = DATE_SHARE) -> DataFrame:
    """Names cleaned, text cells cleaned; text columns that are nearly all numbers become numbers (long if whole and
    without nulls), those named like dates and nearly all dates become ISO dates. NaN becomes null."""
    df = cleaned(df)
    return converted(df, decide(df, numeric_share, date_share))


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows offset.. of df in a stated order; limit is held to 1..500."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def fingerprint(spark: SparkSession, path: str, version: int = 1) -> str:
    """What a stored result must carry to be fresh: the newest change and the bytes of the files, and the format's version."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(p)
    return f"{version}:{fs.getFileStatus(p).getModificationTime()}:{held.getLength()}:{held.getFileCount()}"


def store(df: DataFrame, folder: str, name: str, mark: str) -> None:
    df.withColumn("_mark", F.lit(mark)).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def stored(spark: SparkSession, folder: str, name: str, mark: str) -> DataFrame | None:
    """A stored result if it is there and fresh."""
    path = f"{folder.rstrip('/')}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    df = spark.read.parquet(path)
    return None if df.filter(F.col("_mark") != mark).limit(1).count() else df.drop("_mark")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def stored_names(spark: SparkSession, folder: str) -> list[str]:
    """The names of the results in a folder of stored results."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def prune(spark: SparkSession, folder: str, live: list[str]) -> list[str]:
    """Delete the stored results of tables that are gone; their names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [n for n in stored_names(spark, folder) if n not in live]
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, n), True)
    return gone


def new_snapshot(spark: SparkSession, folder: str) -> str:
    """The path of a snapshot that comes after all others of a folder."""
    return f"{folder.rstrip('/')}/snapshot-{time.time_ns():020d}-{uuid.uuid4().hex}"


def finish_snapshot(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Mark a snapshot as whole, which is one step of the file system; of the whole ones the newest stay."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(p, "_WHOLE")).close()
    for old in _whole(spark, str(p.getParent()))[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), old), True)


def _whole(spark: SparkSession, folder: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in stored_names(spark, folder) if n.startswith("snapshot-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, f"{n}/_WHOLE"))]


def snapshot(spark: SparkSession, folder: str) -> str | None:
    """The newest whole snapshot of a folder."""
    found = _whole(spark, folder)
    return f"{folder.rstrip('/')}/{found[-1]}" if found else None


def clear(spark: SparkSession, folder: str) -> list[str]:
    """Delete all stored results."""
    return prune(spark, folder, [])
