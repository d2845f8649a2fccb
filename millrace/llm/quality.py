"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is a logistic model over surface statistics of its whole text. Its site adds what
the labels say about the host and the path: binomial posteriors, in which a host is shrunk towards the global
rate and a path towards its host, each by a strength that is estimated from how much the groups differ beyond
chance. A site without labels thus falls back on the level above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, packed_row, prepare, saved, sized_broadcast

#: Labelled documents that the classifier is fitted on, at most; site rates use all labels.
SAMPLE = 20_000
#: Sites up to which their table is broadcast.
BROADCAST_SITES = 100_000
THRESHOLD = 0.5
FEATURES = ("log words", "mean word length", "upper share", "digit share", "mark share", "symbol share", "bar share", "bang share", "distinct share", "symbol-ended words", "repeated lines", "log line length")

_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.arange(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*+/<=>@\\^_`{}~", np.uint8))
_SPACE, _BANG = np.isin(np.arange(256), [*range(9, 14), 32]), np.arange(256) == 33
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:?\"'()-", np.uint8))


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; an empty one has zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    ink = sum(map(len, words))
    letters = max(1, counts[_UPPER].sum() + counts[_LOWER].sum())
    rows = [r for r in data.split(b"\n") if r]
    codes = np.frombuffer(data + b" ", np.uint8)
    marked = np.count_nonzero((_SYMBOL | _BANG)[codes[:-1]] & _SPACE[codes[1:]])
    return [math.log1p(len(words)), ink / len(words), counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / ink, counts[_MARK].sum() / ink, counts[_SYMBOL].sum() / ink, counts[124] / ink, counts[33] / ink, len(set(words)) / len(words), marked / len(words), 1 - len(set(rows)) / len(rows), math.log1p(len(data) / len(rows))]


@dataclass(frozen=True)
class Logistic:
    """Weights for standardised features, the intercept first; logits are bounded."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        """Newton's method with an L2 penalty. Without both classes the logit is the smoothed log odds."""
        n, k = x.shape
        mean, scale = (x.mean(0), x.std(0) + 1e-9) if n else (np.zeros(k), np.ones(k))
        z = np.hstack([np.ones((n, 1)), np.clip((x - mean) / scale, -8, 8)])
        w = np.zeros(k + 1)
        w[0] = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        if 0 < y.sum() < n:
            penalty = ridge * np.eye(k + 1)
            penalty[0, 0] = 1e-6
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
                w = w + step
                if np.abs(step).max() < 1e-8:
                    break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:], -30, 30)


def _labels(labels: DataFrame, target: str) -> DataFrame:
    """One 0/1 label a document: the mean of its labels, ties good; nulls are no labels."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    return said.groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("_y"))


def fit_classifier(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Logistic:
    """Fits on at most ``sample`` labelled documents, those with the smallest hashes of their ids."""
    chosen = F.broadcast(_labels(labels, target).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # Of rows that share an id, one stands for all, so that no more than ``sample`` come back.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["y", "x"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.first("_y").alias("_y"), F.max("text").alias("text"))
    rows = sorted(texts.select("_y", "text").mapInArrow(run, "y int, x array<double>").collect())  # ``sample`` at most
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return Logistic.fit(x, np.array([r["y"] for r in rows], float))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-counts of the prior, from the analysis of variance of the groups' rates; 1 to 10,000."""
    rate = F.col("good") / F.col("n")
    got = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (rate - centre) ** 2).alias("b"), F.sum(F.col("n") * rate * (1 - rate)).alias("w")).first()
    if not got["n"] or got["k"] < 2 or got["n"] <= got["k"]:
        return 10.0
    between, within = got["b"] / (got["k"] - 1), got["w"] / (got["n"] - got["k"])
    size = (got["n"] - got["nn"] / got["n"]) / (got["k"] - 1)
    rho = (between - within) / max(between + (size - 1) * within, 1e-12)
    return min(1e4, max(1.0, (1 - rho) / rho)) if rho > 1e-4 else 1e4


def site_posteriors(docs: DataFrame, labels: DataFrame, host: str, path: str, target: str = "quality") -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate, n) for every site of ``docs``, and the global rate (smoothed by half
    a label each way). Null hosts and paths are sites of their own."""
    where = docs.select("doc_id", column(host).alias("host"), column(path).alias("path")).join(_labels(labels, target), "doc_id", "left")
    sites = saved(where.groupBy("host", "path").agg(F.count("_y").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("good")))
    total = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mu = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k_host = _strength(hosts.where("n > 0"), F.lit(mu))
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("good") + k_host * mu) / (F.col("n") + k_host)).alias("host_rate"))
    sites = sites.join(hosts, sites["host"].eqNullSafe(hosts["_host"])).drop("_host")
    k_path = _strength(sites.where("n > 0"), F.col("host_rate"))
    return saved(sites.withColumn("path_rate", (F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path))), mu


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """row (the input row, all columns), evidence (the text's logit), host_rate, path_rate, probability, kept.

    probability is the logistic of evidence + logit(path_rate) - logit(global rate). A document is kept from
    ``threshold`` on. Null and empty texts have zero features; null hosts and paths are sites of their own;
    labels may repeat, contradict each other (the mean decides) or be absent (then all evidence is 0).
    """
    prepare(docs.sparkSession)
    model = fit_classifier(docs, labels, target)
    sites, mu = site_posteriors(docs, labels, host, path, target)
    packed = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.logit(x), pa.float64())], ["row", "evidence"])

    seen = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("evidence", T.DoubleType())]))
    small = sized_broadcast(sites.select("host", "path", "host_rate", "path_rate"), sites.count(), BROADCAST_SITES)
    joined = seen.join(small, seen["row"][host].eqNullSafe(small["host"]) & seen["row"][path].eqNullSafe(small["path"]), "left")
    logit = lambda p: F.log(p / (1 - p))
    bounded = F.least(F.greatest(F.coalesce("path_rate", F.lit(mu)), F.lit(1e-6)), F.lit(1 - 1e-6))
    p = 1 / (1 + F.exp(-(F.col("evidence") + logit(bounded) - math.log(mu / (1 - mu)))))
    out = joined.select("row", "evidence", F.coalesce("host_rate", F.lit(mu)).alias("host_rate"), F.coalesce("path_rate", F.lit(mu)).alias("path_rate"), p.alias("probability"))
    return out.withColumn("kept", F.col("probability") >= threshold)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps.

    Nulls, empty texts and contradicting labels count as in ``score_quality``; repeated rows share their fate; a
    probability on the threshold is kept; an empty table stays empty.
    """
    return score_quality(docs, labels).where("kept").select("row.*")
