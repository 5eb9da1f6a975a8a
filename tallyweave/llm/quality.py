"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics come from DataFrame functions. Random Fourier features approximate a Gaussian kernel
over them; the normal equations of ridge regression are summed by partition; scores of a
calibration fold, which the fit does not see, give a monotone map to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, crc_mod, documents, materialize, table, worker_pass
from .divergence import COMMON_WORDS
from .labelled import training_rows

FEATURES, WIDTH, RIDGE = 256, 4.0, 1e-3
#: Labelled rows that the classifier is fitted on, at most about.
SAMPLE = 40_000
THRESHOLD = 0.7
FOLDS, CALIBRATION = 4, 3
STATISTICS = ("words", "word_length", "upper", "space", "point", "digit", "symbol", "other", "distinct", "common", "bare", "shouted", "repeated_lines", "line_words", "long_words")


def statistics(docs: DataFrame) -> DataFrame:
    """Adds ``x``, the STATISTICS of the whole text; null counts as empty, whose shares are 0."""
    common = sorted({w + e for words in COMMON_WORDS.values() for w in words for e in ("", ",", ".")})
    df = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_t", f"[{WHITE}]+"), ""))
    df = df.withColumn("_rest", F.regexp_replace("_t", "[a-zß-öø-ÿ]+", ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{WHITE}]")))
    gone = lambda pattern: F.length("_rest") - F.length(F.regexp_replace("_rest", pattern, ""))
    df = df.withColumn("_n", F.size("_w").cast("double")).withColumn("_c", F.length("_t").cast("double")).withColumn("_space", gone(f"[{WHITE}]+"))
    df = df.withColumn("_marks", F.array(gone(r"\p{Lu}+"), F.col("_space"), gone(r"[.,;:!?'\"()\-]+"), gone("[0-9]+"), gone(r"[#*$%&|<>=~^@_{}\[\]\\/]+")))
    words, chars = F.greatest(F.col("_n"), F.lit(1.0)), F.greatest(F.col("_c"), F.lit(1.0))
    share = lambda c: F.size(c) / words
    x = [
        F.log1p("_n"), F.least((F.col("_c") - F.col("_space")) / words, F.lit(50.0)), *[F.get("_marks", F.lit(i)) / chars for i in range(5)],
        (F.length("_rest") - F.aggregate("_marks", F.lit(0), lambda a, y: a + y)) / chars,
        share(F.array_distinct("_w")), share(F.filter("_w", lambda w: w.isin(common))), share(F.filter("_w", lambda w: F.length(w) == 1)),
        share(F.filter("_w", lambda w: w.endswith("!"))), 1 - F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        F.log1p(words / F.greatest(F.size("_lines"), F.lit(1))), share(F.filter("_w", lambda w: F.length(w) > 18)),
    ]
    # A condition on a row number, always true, keeps the optimizer from writing all of this, with
    # its shared parts many times over, into the arguments of whatever reads x.
    array = F.when(F.monotonically_increasing_id() >= 0, F.array(*[c.cast("double") for c in x]))
    return df.withColumn("x", array).drop("_t", "_w", "_rest", "_lines", "_n", "_c", "_space", "_marks")


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit, one at the mean score of each block."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, of scores, count
    for s, y in zip(scores[order], labels[order], strict=True):
        blocks.append([float(y), float(s), 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][2] >= blocks[-1][0] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[2] + 1) for b in blocks]))


@dataclass
class Classifier:
    center: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a trace of the raw score keeps the order within a level."""
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.knots, self.levels) * 0.998 + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Classifier:
    """Fit on about ``sample`` labelled rows that are not held out. Without any label every score is 0.5."""
    d = len(STATISTICS)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int")
    labelled = training_rows(docs.select("doc_id", "text"), labels, label, modulus, held_out, sample)
    rows = materialize(statistics(labelled).select("x", "label", fold.alias("fold")).repartition(8), "quality-training")
    moments = rows.select(*[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    center = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(17)
    model = Classifier(center, scale, rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + d + 1), np.array([0.0]), np.array([0.5]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FEATURES + d + 1,) * 2), np.zeros(FEATURES + d + 1)
        for batch in batches:
            z = model.features(_matrix(batch.column("x"), d))
            gram += z.T @ z
            right += z.T @ batch.column("label").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], names=["gram", "right"])

    gram, right = np.zeros((FEATURES + d + 1,) * 2), np.zeros(FEATURES + d + 1)
    for part in rows.filter(F.col("fold") != CALIBRATION).select("x", "label").mapInArrow(worker_pass(sums), "gram binary, right binary").collect():  # eight tasks
        gram += np.frombuffer(part.gram).reshape(gram.shape)
        right += np.frombuffer(part.right)
    if not gram[-1, -1]:
        return model
    model.weights = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.eye(len(gram)), right)
    seen = rows.filter(F.col("fold") == CALIBRATION).select("x", "label").toPandas()
    if len(seen):
        model.knots, model.levels = isotonic(model.raw(np.stack(seen["x"])), seen["label"].to_numpy(dtype=float))
    return model


def score_column(model: Classifier, x: str = "x") -> Column:
    """Scores of a column of statistics."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return worker_pass(lambda xs: (pd.Series(model.scores(np.stack(x)) if len(x) else [], dtype=float) for x in xs))(batches)

    return scores(x)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, held-out rows being those that no fit sees.

    One map-side pass over all texts follows the fit. Null and empty texts score as texts without
    words; repeated rows score alike; labels without a document, null labels and documents
    without a label are allowed.
    """
    model = train(docs, labels)
    scored = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("score", score_column(model))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
