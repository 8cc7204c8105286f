"""Quality classifier: cumulative-link regression on graded ratings over hashed words."""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise
from gleaner.llm.common import bounded_batches

BUCKETS = 1 << 18
STRIP = ".,;:!?\"'()[]{}<>«»|*%&$#@~^_=+-/\\`"
MARKS = "!*%&$#|@"


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets(dict):
    """Bucket of a raw lower-case word, remembered for the words seen lately."""

    def __missing__(self, word):
        if len(self) >= 100_000:
            self.clear()
        self[word] = found = word_bucket(word.strip(STRIP) or "\x00")
        return found


def shapes(text: str, words: list[str]) -> list[int]:
    """Buckets of how much of a text is capitals, marks, repeated words, and long words."""
    n, chars = max(len(words), 1), max(len(text), 1)
    level = lambda share: min(int(share * 16), 8)
    upper = sum(map(str.isupper, text.split()))
    marks = [f"{m}{level(text.count(m) / n)}" for m in MARKS]
    named = [f"upper{level(upper / n)}", f"distinct{int(8 * len(set(words)) / n)}", f"chars{min(chars // n, 16)}"]
    return [word_bucket(f"\x00shape {x}") for x in marks + named]


def features(text: str, buckets: Buckets) -> np.ndarray:
    """Distinct hashed words and shapes of a whole text."""
    words = text.lower().split()
    return np.unique(np.fromiter({*map(buckets.__getitem__, set(words)), *shapes(text, words)}, dtype=np.int64))


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . features - thresholds[k]); one weight vector serves all thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - self.thresholds[None], -50, 50)))


def regress(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, steps: int = 400, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of least penalised negative log-likelihood, by Adam over all rows."""
    at = np.concatenate([*(np.full(len(r), i) for i, r in enumerate(rows)), np.zeros(0)]).astype(np.int64)
    which = np.concatenate([*rows, np.zeros(0)]).astype(np.int64)
    share = np.array([(np.sum(grades <= k) + 1) / (len(grades) + n_grades) for k in range(n_grades - 1)])
    first = np.log(share / (1 - share))
    # Thresholds as a first one and the logs of their distances stay in order.
    p = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v, n = np.zeros_like(p), np.zeros_like(p), max(len(grades), 1)
    for step in range(1, steps + 1):
        gaps = np.exp(p[n_features + 1:])
        theta = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, p[which], minlength=len(grades))
        below = 1 / (1 + np.exp(-np.clip(theta[None] - score[:, None], -50, 50)))  # P(grade <= k)
        edges = np.hstack([np.zeros((len(grades), 1)), below, np.ones((len(grades), 1))])
        i = np.arange(len(grades))
        chance = np.maximum(edges[i, grades + 1] - edges[i, grades], 1e-9)
        slope = edges * (1 - edges)
        by_score = (slope[i, grades + 1] - slope[i, grades]) / chance
        by_theta = np.zeros((len(grades), n_grades + 1))
        by_theta[i, grades + 1] -= slope[i, grades + 1] / chance
        by_theta[i, grades] += slope[i, grades] / chance
        d_theta = by_theta[:, 1:-1].sum(0) / n
        gradient = np.concatenate([
            np.bincount(which, by_score[at], minlength=n_features) / n + l2 / n * p[:n_features] * 10,
            [d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        p -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1:]))])


def fit(docs: DataFrame, grades: DataFrame, doc: str = "doc_id", text: str = "text", n_grades: int = 3, sample: int = 12_000,
        keep: int = 2_048, least_rows: int = 4, seed: int = 5) -> Model | None:
    """Fits on at most ``sample`` rated documents, drawn by a hash of the id (the one bounded step; scoring covers all rows),
    with one text each.

    ``grades`` holds (doc_id, grade) with grades from 0 to ``n_grades`` - 1. Buckets that tell the best grade from the others or
    the worst from the others most are chosen, ``keep`` of them at most; each chosen bucket has to occur in ``least_rows`` rated
    documents. None if no document is rated."""

    bounded_batches(docs.sparkSession)

    def rows(frames):
        buckets = Buckets()
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"doc_id": frame["doc_id"], "grade": frame["grade"], "draw": frame["draw"],
                                    "buckets": [features(t or "", buckets) for t in frame["text"]]})

    drawn = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(
        F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("draw"))
    # Bounded: `sample` rows of two numbers.
    found = texts.join(F.broadcast(drawn), "doc_id").mapInPandas(rows, "doc_id long, grade int, draw long, buckets array<long>")
    # An id may stand on many rows: one of its texts, that of the least hash, speaks for it.
    rated = materialise(found.groupBy("doc_id", "grade").agg(F.min(F.struct("draw", "buckets")).alias("least")).select(
        "doc_id", "grade", "least.buckets"), "rated")
    totals = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    n = sum(totals.values())
    if not n:
        return None

    def contrast(inside: Column, size: int) -> Column:
        """Squared difference of a bucket's share inside and outside, in units of its spread."""
        outside, rest = F.col("n") - inside, n - size
        mean = F.col("n") / n
        if not size or not rest:
            return F.lit(0.0)
        return F.pow(inside / size - outside / rest, 2) / ((mean * (1 - mean) + 1 / n) * (1 / size + 1 / rest))

    counted = rated.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum((F.col("grade") == n_grades - 1).cast("int")).alias("best"),
        F.sum((F.col("grade") == 0).cast("int")).alias("worst")).where(F.col("n") >= least_rows)
    strength = F.greatest(contrast(F.col("best"), totals.get(n_grades - 1, 0)), contrast(F.col("worst"), totals.get(0, 0)))
    chosen = sorted(r["bucket"] for r in counted.withColumn("strength", strength).where("strength > 12").orderBy(
        F.desc("strength"), "bucket").limit(keep).collect())
    place = {b: i for i, b in enumerate(chosen)}
    lean = rated.select("doc_id", "grade", F.array_intersect("buckets", F.array(*map(F.lit, chosen)).cast("array<long>")).alias("b")).toPandas()
    lean = lean.sort_values("doc_id")
    weights, thresholds = regress([np.array([place[b] for b in r], dtype=np.int64) for r in lean["b"]], lean["grade"].to_numpy(np.int64), len(chosen), n_grades)
    return Model(dict(zip(chosen, weights.tolist())), thresholds)


def rate(text: Column, model: Model | None, n_grades: int = 3) -> Column:
    """Struct of ``expected_grade`` and ``tail_probability`` (of the best grade); both at their most without a model."""

    def scores(texts):
        buckets, out = Buckets(), []
        for t in texts:
            words = (t or "").lower().split()
            found = {*map(buckets.__getitem__, set(words)), *shapes(t or "", words)}
            out.append(sum(model.weights[b] for b in model.weights.keys() & found))
        return out

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rated(texts: pd.Series) -> pd.DataFrame:
        tails = model.tails(np.array(scores(texts), dtype=np.float64)) if model else np.ones((len(texts), n_grades - 1))
        return pd.DataFrame({"expected_grade": tails.sum(1), "tail_probability": tails[:, -1]})

    return rated(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grade of each label: 0 toxic, 1 poor, 2 good; rows with neither rating take no part."""
    toxic, quality = F.coalesce("toxic", F.lit(0)), F.coalesce("quality", F.lit(1))
    return labels.where("toxic is not null or quality is not null").select(
        "doc_id", F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2).alias("grade"))


def classify(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``doc_id``, ``expected_grade`` (0 to 2), ``tail_probability`` and ``kept`` (it is at least ``least``) for every row.

    Null and empty texts are rated as texts without words; null ids and repeated rows are kept as they are; without labels
    every row is kept; an empty table gives no rows; further columns are ignored."""
    model = fit(docs, grades_of(labels), doc, text)
    return docs.select(F.col(f"`{doc}`").alias("doc_id"), rate(F.col(f"`{text}`"), model).alias("r")).select(
        "doc_id", "r.expected_grade", "r.tail_probability", (F.col("r.tail_probability") >= least).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns."""
    model = fit(docs, grades_of(labels), doc, text)
    return docs.where(rate(F.col(f"`{text}`"), model)["tail_probability"] >= least)
