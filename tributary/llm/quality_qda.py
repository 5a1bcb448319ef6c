"""Quality by a regularised quadratic discriminant over transformed statistics of a document.

Every text becomes one short vector: rates of characters, words and lines, each transformed so that it is roughly symmetric. Per class
the labelled vectors give a count, a mean and a covariance; these moments are summed by Spark over all labelled training rows, so the
driver only sees two small matrices. A class covariance is shrunk towards the pooled one (``POOL``), and its
diagonal is raised by ``RIDGE`` times the pooled variances. Its Cholesky factor is taken once, inverted once and sent to the tasks; the score of a row is the logistic of the
difference of log densities, from Mahalanobis distances ``|L^-1 (x - mean)|^2``, plus the log odds of the classes.

Defined results: null text is an empty text, and has a score like any other; labels that are null or not 0/1 are ignored; a document with
several label rows counts once per row; a null id is held out or not by the hash of the empty text; with fewer than two rows of a class the
score of every row is the share of label 1 (0.5 without labels). Extra columns of the input pass through ``score`` untouched, unless
named like a result column, which win. An empty table gives an empty one. Texts may be of any length; their statistics are of one size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.tables import keep

POOL, RIDGE = 0.5, 0.02
#: Words added to every text's number in rates, so that a few words more or less do not tell a short text apart.
SMOOTH = 20
SYMBOLS = b"#*$%&|<>"
#: Character classes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 space, 5 full stop, 6 comma, 7 other end marks, 8 symbol, 9 not ASCII.
CLASSES = np.zeros(256, np.uint8)
for _class, _chars in enumerate(
    (b"", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r", b".", b",", b"!?;:", SYMBOLS, bytes(range(128, 256)))
):
    CLASSES[list(_chars)] = _class
FEATURES = (
    "words", "word_length", "upper", "digits", "full_stops", "commas", "end_marks", "symbols", "other_marks", "not_ascii", "distinct",
    "repeated", "most_common_line", "line_length",
)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=10).tolist()
    words = text.split()
    n, chars = len(words), max(1, len(data) - counts[4])
    lines = [x for x in text.split("\n") if x]
    rate = lambda k: (k / (n + SMOOTH)) ** 0.5
    return [
        np.log1p(n),
        np.log1p(chars / max(1, n)),
        (counts[2] / max(1, counts[1] + counts[2])) ** 0.5,
        rate(counts[3]),
        rate(counts[5]),
        rate(counts[6]),
        rate(counts[7]),
        rate(counts[8]),
        rate(counts[0]),
        (counts[9] / chars) ** 0.5,
        # distinct words against what is usual at this length (growth as a power)
        np.log1p(len(set(words))) - 0.8 * np.log1p(n),
        rate(sum(map(eq, words, words[1:]))),
        (1 - len(set(lines)) / max(1, len(lines))) ** 0.5,
        np.log1p(n / max(1, len(lines))),
    ]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``features``; one pass in batches, no shuffle."""
    others = [c for c in docs.columns if c not in (text, "features")]
    vector = F.pandas_udf(_vectors, "array<double>")
    return docs.select(*others, vector(F.coalesce(F.col(text), F.lit(""))).alias("features"))


def _vectors(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


@dataclass
class Discriminant:
    """Two classes: means, inverted Cholesky factors, log determinants and log shares; or a constant where a class is missing."""

    means: np.ndarray
    inverse_factors: np.ndarray
    log_determinants: np.ndarray
    log_shares: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, factor, determinant, share in zip(self.means, self.inverse_factors, self.log_determinants, self.log_shares):
            z = (x - mean) @ factor.T
            density.append(share - 0.5 * determinant - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def from_moments(counts, sums, products, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """From per class counts, sums and sums of outer products."""
    counts = np.asarray(counts, float)
    if (counts < 2).any():
        empty = np.zeros((2, 0))
        return Discriminant(empty, empty, empty, empty, float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = np.asarray(sums) / counts[:, None]
    scatters = np.asarray(products) - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatters.sum(0) / (counts.sum() - 2)
    factors, determinants = [], []
    for scatter, n in zip(scatters, counts):
        covariance = (1 - pool) * scatter / (n - 1) + pool * pooled
        # the ridge is relative to the pooled variance of each statistic, which keeps the result independent of their units
        covariance += ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
        factor = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(factor))
        determinants.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(determinants), np.log(counts / counts.sum()))


def fit(labelled: DataFrame, label: str = "quality", pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """From all rows (``features``, ``label`` 0 or 1). Each task hands over one row of moments per class."""
    d = len(FEATURES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            for k in (0, 1):
                rows = batch["features"][batch[label] == k]
                if len(rows):
                    x = np.stack(rows.to_list())
                    total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"class": [0, 1], "moments": list(total)})

    rows = labelled.filter(F.col(label).isin(0, 1)).select("features", F.col(label).cast("int").alias(label))
    parts = rows.mapInPandas(moments, "class int, moments array<double>").select("class", F.posexplode("moments").alias("at", "value"))
    total = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("class", "at").agg(F.sum("value").alias("value")).collect():  # 2 * (1 + d + d * d) rows
        total[row["class"], row["at"]] = row["value"]
    return from_moments(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), pool, ridge)


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` with ``score`` and ``predicted`` in place of ``features``."""

    def scores(vectors: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(vectors.to_list()))) if len(vectors) else pd.Series([], dtype=float)

    rows = rows.drop("score", "predicted").withColumn("score", F.pandas_udf(scores, "double")("features")).drop("features")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train(docs_features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """On labelled rows that are not held out."""
    learnt = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key))).select(F.col(key), F.col(label))
    return fit(docs_features.select(key, "features").join(learnt, key), label)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vectors = keep(features(docs))
    model = train(vectors, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(vectors, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant takes for good; it learns from the labelled documents as they were given."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # vectors are joined with labels, not texts: many labels make this a shuffle
    model = train(features(given.filter(~held_out(F.col("doc_id")))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.withColumn("features", F.pandas_udf(_vectors, "array<double>")(F.coalesce(F.col("text"), F.lit("")))), model)
    return scored.filter("predicted = 1").select(*docs.columns)
