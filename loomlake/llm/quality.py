"""Quality rules as a bitmask ledger, on DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long whose bit i is set where
rule i fails. A policy is a named, versioned set of rules; applying one is a single bitwise AND, so new policies and
ablations never touch the texts again. No shuffle is needed before the (16-row) ablation table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, UPPER, let

#: name -> when a document fails, over the measurements of measure(). The position is the rule's bit; append only.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "word_length": "word_chars > 40 * n_words",
}
#: Versions stay as they were published; a new one gets a new name.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}
WINDOW = 8


def bits(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the same array."""

    def windows(hashes: Column) -> Column:
        start = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(start, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twice = lambda a: F.transform(a, lambda x, j: F.when((F.get(a, j - 1)["w"] == x["w"]) | (F.get(a, j + 1)["w"] == x["w"]), x["i"]))
        starts = let(ordered, lambda a: F.array_sort(F.filter(twice(a), lambda i: i.isNotNull())))
        gaps = lambda s: F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW))))
        return let(starts, lambda s: F.aggregate(gaps(s), F.lit(0), lambda a, x: a + x))

    unlike = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda w: F.when(unlike(w), F.lit(0)).otherwise(covered(w))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(some)


def measure(documents: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns and the measurements of every row; a null text has no words."""
    carry = documents.columns if carry is None else carry
    held = documents.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = held.select("row", "text", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"))
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return held.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        count(UPPER).cast("long").alias("n_capitals"),
    )


def ledger(documents: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """measure() and ``failed``, the mask of failed rules."""
    failed = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(documents, text, carry).withColumn("failed", failed)


def passes(policy: str = "v1") -> Column:
    return F.col("failed").bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed, n_only: rows that each rule of the policy rejects, and those that it alone rejects.

    One pass over the masks; a rule is left out by clearing its bit."""
    mask = bits(POLICIES[policy])
    held = ledger.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = held.select("m", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def judge_documents(documents: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, the measurements, ``failed``, base_failed and kept, one row for each row of documents.

    A null or empty text has no words and fails; repeated rows are judged alike; other columns are not read."""
    return ledger(documents, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "failed", "n_lines", "n_capitals"
    )


def keep_good(documents: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of documents that pass, with the columns of documents.

    Null, empty and blank texts fail; repeated rows stay or go together; an empty table stays empty."""
    good = ledger(documents).filter(passes("base") & passes(policy))
    return good.select([F.col("row").getField(c).alias(c) for c in documents.columns])
