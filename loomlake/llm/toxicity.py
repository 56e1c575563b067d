"""Toxicity by cumulative-link ordinal regression on sparse words.

P(grade > k) = sigmoid(w . x - t_k): one weight vector serves all thresholds t_0 <= t_1 <= ... The output is the
probability of each threshold and the expected severity, their sum.

Labels hold two classes. Grades come from the labelled sample itself: a text labelled clean has grade 0; a text
labelled toxic has grade 1 to 3 by how many words it holds of those that toxic labels single out (fewer than 2, 2 to
3, more). The model is fitted in numpy on a bounded sample of labelled texts; scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped
from .licences import words

#: Labelled texts fitted on at most, words of the vocabulary at most, least document frequency of a word, and the least
#: log odds of its toxic share in standard errors (rarer or weaker words would only memorise the sample).
SAMPLE, VOCABULARY, LEAST_TEXTS, LEAST_ERRORS = 8_000, 4_096, 6, 3.5
#: Places of the histogram by which the sample is chosen.
PLACES = 1 << 16
#: Least lower bound of the log odds of a word's toxic share for it to count towards a grade; grades' least counts.
SINGLED_OUT, GRADES = 2.0, (0, 2, 4)
#: A text is rejected when toxicity of any grade is likelier than not.
REJECT = 0.5


class Ordinal:
    """weights: word -> weight; thresholds ascending."""

    def __init__(self, weights: dict[bytes, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.asarray(thresholds, float)

    def score(self, text: bytes | None) -> np.ndarray:
        """P(grade > k) for each threshold; a word counts by the logarithm of its occurrences and one."""
        known = self.weights
        found = Counter(w for w in words(text) if w in known)
        margin = sum(known[w] * np.log1p(n) for w, n in found.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin, -500, 500)))


def fit(texts: list[bytes | None], toxic: list[int], steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam, full batches over a sparse matrix in coordinate form, from zero: deterministic."""
    label = np.asarray(toxic, int)
    seen, hit = Counter(), Counter()
    for x, y in zip(texts, label):
        own = set(words(x))
        seen.update(own)
        if y:
            hit.update(own)
    n1 = max(1, int(label.sum()))
    n0 = max(1, len(label) - n1)
    if not label.any() or label.all():
        return Ordinal({}, [(-1.0 if label.all() and len(label) else 1.0) * 20.0] * len(GRADES))

    def odds(w: bytes) -> tuple[float, float]:
        a, b = hit[w] + 0.5, seen[w] - hit[w] + 0.5
        return np.log(a / n1) - np.log(b / n0), np.sqrt(1 / a + 1 / b)

    rated = {w: odds(w) for w, n in seen.items() if n >= LEAST_TEXTS}
    seen.clear()
    hit.clear()
    # at least one word, so that the arrays below are never empty
    chosen = sorted((w for w, (o, e) in rated.items() if abs(o) >= LEAST_ERRORS * e), key=lambda w: (-abs(rated[w][0]) / rated[w][1], w))[:VOCABULARY] or [b""]
    number = {w: i for i, w in enumerate(chosen)}
    counts = [Counter(w for w in words(x) if w in number) for x in texts]
    marked = {w for w in chosen if w in rated and rated[w][0] - rated[w][1] >= SINGLED_OUT}
    grade = np.array([sum(sum(n for w, n in c.items() if w in marked) >= g for g in GRADES) if y else 0 for c, y in zip(counts, label)])
    cells = [(r, number[w], np.log1p(n)) for r, c in enumerate(counts) for w, n in c.items()]
    row, col, val = (np.array(x) for x in (zip(*cells) if cells else ((0,), (0,), (0.0,))))
    K = len(GRADES)
    # theta_0 and the logs of the gaps, so that thresholds stay in order
    p = np.concatenate([np.zeros(len(chosen)), [2.0], np.zeros(K - 1)])
    m, v, n, d = np.zeros_like(p), np.zeros_like(p), len(label), len(chosen)
    for t in range(1, steps + 1):
        gaps = np.exp(np.clip(p[d + 1 :], -10, 3))
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        margin = np.bincount(row, val * p[col], minlength=n)
        above = 1 / (1 + np.exp(np.clip(theta - margin[:, None], -30, 30)))  # P(grade > k)
        bounds = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        at = np.arange(n)
        own = np.maximum(bounds[at, grade] - bounds[at, grade + 1], 1e-9)  # P(grade)
        slope = above * (1 - above)
        padded = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], 1)
        by_margin = -(padded[at, grade] - padded[at, grade + 1]) / own / n
        sign = (np.arange(K) == grade[:, None] - 1).astype(float) - (np.arange(K) == grade[:, None])
        by_theta = (sign * slope / own[:, None]).sum(0) / n
        g = np.concatenate([np.bincount(col, val * by_margin[row], minlength=d) + decay * p[:d], [by_theta.sum()], by_theta[1:][::-1].cumsum()[::-1] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(p[d + 1 :], -10, 3))
    return Ordinal({w: float(p[i]) for w, i in number.items()}, list(p[d] + np.concatenate([[0.0], np.cumsum(gaps)])))


def fit_on(documents: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled rows, those of the lowest hashes of doc_id.

    The sample is chosen on the labels alone, by a threshold on the hash that a histogram of fixed size gives, so only its
    texts are gathered. Labels that are null or belong to no document are left out; a document with several labels counts
    with each; of several texts with one doc_id the least counts."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PLACES))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
    least, total = 0, 0
    for r in sorted(known.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.place):
        total += r.n
        if total > sample:
            break
        least = r.place + 1
    chosen = F.broadcast(known.filter(place < least))  # at most sample rows
    found = documents.select("doc_id", F.col(text).cast("binary").alias("text")).join(chosen, "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: (r.doc_id, r.toxic))
    return fit([None if r.text is None else bytes(r.text) for r in found], [int(r.toxic > 0) for r in found])


def score_texts(documents: DataFrame, model: Ordinal, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns, p_any (P(grade > 0)), severity (the expected grade), grade (the likeliest) of every row."""
    carry = carry or ["doc_id"]
    kept = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            p = np.array([model.score(x) for x in b.column("text").to_pylist()]).reshape(-1, len(model.thresholds))
            share = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(f"c{i}") for i in range(len(carry))], pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(share.argmax(1).astype(np.int32))], [*carry, "p_any", "severity", "grade"])

    kinds = dict(documents.dtypes)
    return mapped(kept, run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", p_any double, severity double, grade int")


def grade_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_any, severity, grade, toxic (boolean) of every row of documents.

    A null or empty text has no words and the base rate's grade. Without labels of both classes nothing is toxic (or
    everything, if all labels are). Repeated rows are graded alike; other columns are not read."""
    return score_texts(documents, fit_on(documents, labels)).withColumn("toxic", F.col("p_any") >= REJECT)


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are not toxic, with the columns of documents.

    A null or empty text is never toxic while labels of both classes exist; repeated rows stay or go together."""
    model = fit_on(documents, labels)
    held = documents.select(F.struct(*documents.columns).alias("row"), F.col("text"))
    clean = score_texts(held, model, carry=["row"]).filter(F.col("p_any") < REJECT)
    return clean.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
