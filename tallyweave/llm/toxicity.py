"""Toxicity by weak supervision.

A lexicon of words and word stems is mined from labelled rows in disjoint folds: an entry belongs to
the fold whose rows alone speak for it most, and is one of a few voters of that fold, so no two
voters share an entry. Beside these lexicon voters, pattern voters look
at the text itself (capitals, runs of marks, letters hidden by signs, angry address, stretched words)
and at how hits are spread over lines and kinds. A generative label model estimates each voter's
accuracy from the centred agreement of voters over all texts, and what pairs agree on beyond the
label; posterior labels train a linear classifier, whose scores are calibrated on labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, materialize, table, worker_pass
from .labelled import training_rows

#: Labelled rows to mine the lexicon and to calibrate on, and posterior rows to train on, at most about.
SAMPLE, POSTERIORS = 16_000, 40_000
STEMS = (5, 6, 8)  # lengths of the stems that count as units beside whole words
LEAST, RATIO = 4, 30  # toxic rows that an entry needs, and how much more frequent it is in them
FOLDS, FOLD_LEAST, FOLD_RATIO = 3, 2, 10  # disjoint parts of the labelled rows, and what an entry needs in AGREED of them
AGREED = 2
GAIN = 20  # least of (toxic rows) x (log ratio): half the log likelihood ratio, so chance finds among a million units fail
BANKS = 4 * FOLDS  # lexicon voters
#: What pattern voters look for in the text, whatever the lexicon holds.
PATTERNS = {
    "shouted": r"[A-ZÀ-Þ]{3,}(?:[ ,]+[A-ZÀ-Þ]{2,}){2,}",
    "marks": r"[!?]{2,}",
    "hidden": r"(?<=[^\W\d_])[*@$#]+(?=[^\W\d_])",
    "address": r"\b(?:you|your|du|dich|ihr|euch|tu|toi|vous|tú|usted|eres)\b[^.!?\n]{0,60}!",
    "stretched": r"([aeiouAEIOU])\1{3,}",
}
#: Characters of which a pattern needs one; without them the text need not be searched.
_NEEDS = {"marks": "!?", "hidden": "*@$#", "address": "!"}
SPREAD = ("kinds", "lines", "dense")
VOTERS = BANKS + len(PATTERNS) + len(SPREAD)
WIDTH = BANKS + 4 + len(PATTERNS)  # numbers kept of a text: hits by bank, all, kinds, lines, words, patterns
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = tuple((re.compile(p), _NEEDS.get(name, " ")) for name, p in PATTERNS.items())


def units(word: str) -> list[str]:
    """The word and its stems, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _unit_set(text: str) -> set[str]:
    return {u for w in set(_WORD.findall(text.lower())) for u in units(w)}


@dataclass
class Lexicon:
    banks: dict[str, int] = field(default_factory=dict)  # each entry's voter

    def __post_init__(self):
        self.heads = {u[:3] for u in self.banks}

    def hits(self, text: str | None) -> np.ndarray:
        """Hits by bank, all hits, distinct words hit, lines with a hit, words, and matches of each
        pattern; a word counts for its longest entry."""
        text = text or ""
        lower = text.lower()
        words = _WORD.findall(lower)
        out, kinds = np.zeros(WIDTH), set()
        for w in [w for w in words if w[:3] in self.heads]:
            for u in (w, *(w[:k] + "*" for k in reversed(STEMS) if len(w) > k)):
                if u in self.banks:
                    out[self.banks[u]] += 1
                    out[BANKS] += 1
                    kinds.add(w)
                    break
        lines = sum(not kinds.isdisjoint(_WORD.findall(line)) for line in lower.split("\n")) if out[BANKS] > 1 else out[BANKS]
        out[BANKS + 1 : BANKS + 4] = len(kinds), lines, len(words)
        out[BANKS + 4 :] = [len(p.findall(text)) if any(c in text for c in needs) else 0 for p, needs in _PATTERNS]
        return out

    @staticmethod
    def features(found: np.ndarray) -> np.ndarray:
        counts, (total, kinds, lines, words), patterns = found[:, :BANKS], found[:, BANKS : BANKS + 4].T, found[:, BANKS + 4 :]
        words = np.maximum(words, 1)
        shares = np.minimum(100 * patterns / words[:, None], 5)
        return np.column_stack([np.log1p(counts), np.log1p(total), np.log1p(kinds), np.log1p(lines), np.minimum(100 * total / words, 10), np.log1p(1000 * total / words), np.log1p(1000 * kinds / words), total >= 1, total >= 2, kinds >= 2, shares]).astype(float)

    @staticmethod
    def votes(found: np.ndarray) -> np.ndarray:
        """0 or 1 of every voter, and 1 for the row itself, so that sums of products hold means and counts too."""
        total, kinds, lines, words = found[:, BANKS : BANKS + 4].T
        often = 1000 * total / np.maximum(words, 1)
        spread = np.column_stack([(kinds >= 2) & (often >= 2), (lines >= 2) & (often >= 2), often >= 4])
        return np.column_stack([found[:, :BANKS] >= 1, found[:, BANKS + 4 :] >= 1, spread, np.ones(len(found))]).astype(float)


def mine(rows: DataFrame) -> Lexicon:
    """Every unit whose share of toxic rows is far above the rest's, from labelled rows (doc_id, text, label).

    First the units of toxic rows are counted, then those that enough of them hold in all rows, by
    fold; what reaches the driver is bounded by the sample. Without toxic rows the lexicon is empty.
    """
    names = [f"{kind}{f}" for kind in ("toxic", "clean") for f in range(FOLDS)]

    def toxic_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for frame in batches:
            for text in frame["text"]:
                found.update(_unit_set(text or ""))
        yield pd.DataFrame({"unit": list(found), "n": list(found.values())}).astype({"unit": "str", "n": "int64"})

    rows = rows.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(FOLDS)).cast("int").alias("fold"))
    some = rows.filter(F.col("label") > 0).select("text").mapInPandas(worker_pass(toxic_units), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    known = rows.sparkSession.sparkContext.broadcast(frozenset(r.unit for r in some.select("unit").toLocalIterator()))

    def by_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {"": np.zeros(2 * FOLDS, dtype=np.int64)}  # the empty unit is in every row
        for frame in batches:
            for text, label, fold in zip(frame["text"], frame["label"], frame["fold"], strict=True):
                at = fold if label > 0 else FOLDS + fold
                for u in ("", *(u for u in _unit_set(text or "") if u in known.value)):
                    if u not in found:
                        found[u] = np.zeros(2 * FOLDS, dtype=np.int64)
                    found[u][at] += 1
        counts = np.stack(list(found.values()))
        yield pd.DataFrame({"unit": list(found), **{n: counts[:, i] for i, n in enumerate(names)}})

    sums = rows.mapInPandas(worker_pass(by_fold), ", ".join(["unit string", *(f"{n} long" for n in names)])).groupBy("unit").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("unit")
    all_rows = sums.loc[sums.unit == "", names].to_numpy(dtype=float).sum(axis=0)
    sums = sums[sums.unit != ""]
    counts = sums[names].to_numpy(dtype=float)
    toxic, clean = counts[:, :FOLDS], counts[:, FOLDS:]

    def ratio(t: np.ndarray, c: np.ndarray, n_t: np.ndarray, n_c: np.ndarray) -> np.ndarray:
        return np.log((t + 0.5) / (np.maximum(n_t, 1) + 1)) - np.log((c + 0.5) / (np.maximum(n_c, 1) + 1))

    whole = ratio(toxic.sum(axis=1), clean.sum(axis=1), all_rows[:FOLDS].sum(), all_rows[FOLDS:].sum())
    of_fold = ratio(toxic, clean, all_rows[:FOLDS], all_rows[FOLDS:])
    of_fold[(of_fold <= np.log(FOLD_RATIO)) | (toxic < FOLD_LEAST)] = 0
    good = (toxic.sum(axis=1) * whole >= GAIN) & (toxic.sum(axis=1) >= LEAST) & (whole > np.log(RATIO)) & ((of_fold > 0).sum(axis=1) >= AGREED)
    order = sorted(np.flatnonzero(good), key=lambda i: (-toxic[i].sum() * whole[i], sums.unit.iloc[i]))
    banks: dict[str, int] = {}
    size = [0] * FOLDS
    for i in order:
        unit = sums.unit.iloc[i]
        if not any(u in banks for u in units(unit.rstrip("*"))):  # no stem of it is an entry
            f = int((toxic[i] * of_fold[i]).argmax())
            banks[unit] = 4 * f + size[f] % 4
            size[f] += 1
    return Lexicon(banks)


@dataclass
class LabelModel:
    """Posterior log odds are a constant plus the weighted votes."""

    constant: float
    weights: np.ndarray
    accuracy: np.ndarray  # correlation of each voter with the label
    beyond: np.ndarray  # correlation of each pair that the label doesn't explain

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.constant + votes[:, : len(self.weights)] @ self.weights, -30, 30)))


def label_model(sums: np.ndarray, prior: float) -> LabelModel:
    """From the sum over all rows of the outer product of (votes, 1).

    For standardised voters that depend on each other through the label only, corr(i, j) = ai aj, so ai
    is the median of sqrt(cij cik / cjk); with a voter's rate it gives how often it votes in either
    class. What a pair's correlation has beyond ai aj is the voters' own dependence: a voter's evidence
    is divided by one plus its dependence on all others, so voters that repeat each other count once
    together. Voters that never differ, or agree with no others, count nothing.
    """
    n = max(sums[-1, -1], 1.0)
    mean = sums[-1, :-1] / n
    moment = sums[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(moment), 0))
    m = len(mean)
    c = moment / np.maximum(np.outer(scale, scale), 1e-12)
    accuracy = np.zeros(m)
    for i in np.flatnonzero(scale > 1e-4):
        good = [j for j in range(m) if j != i and scale[j] > 1e-4 and c[i, j] > 0.02]
        found = [np.sqrt(c[i, j] * c[i, k] / c[j, k]) for j in good for k in good if k < j and c[j, k] > 0.02]
        if found:
            accuracy[i] = np.clip(np.median(found), 0, 0.97)
    left = np.sqrt(1 - accuracy**2)
    beyond = (c - np.outer(accuracy, accuracy)) / np.outer(left, left)
    beyond[scale <= 1e-4] = 0
    beyond[:, scale <= 1e-4] = 0
    np.fill_diagonal(beyond, 0)
    beyond = np.clip(beyond, -1, 1)
    odds = np.sqrt((1 - prior) / prior)
    toxic = np.clip(mean + accuracy * scale * odds, 1e-3, 1 - 1e-3)
    clean = np.clip(mean - accuracy * scale / odds, 1e-3, 1 - 1e-3)
    share = (accuracy > 0) / (1 + np.maximum(beyond, 0).sum(axis=1))
    told, silent = share * np.log(toxic / clean), share * np.log((1 - toxic) / (1 - clean))
    return LabelModel(float(np.log(prior / (1 - prior)) + silent.sum()), told - silent, accuracy, beyond)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of ridge logistic regression on soft labels, by Newton steps; the last one is the constant's."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["found"]) if len(frame) else np.zeros((0, WIDTH))


def hit_table(docs: DataFrame, lexicon: Lexicon, *beside: str) -> DataFrame:
    """doc_id, text_hash, ``found`` (see :meth:`Lexicon.hits`) of every whole text, and the integer columns ``beside``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.hits(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, kind), *[batch.column(c) for c in beside]], names=["doc_id", "text_hash", "found", *beside])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", *beside)
    return rows.mapInArrow(worker_pass(run), "doc_id long, text_hash long, found array<double>" + "".join(f", {c} int" for c in beside))


def agreement(hits: DataFrame) -> np.ndarray:
    """Sum over all rows of the outer product of (votes, 1): by task, then by place in the matrix, then here."""
    m = VOTERS + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, m))
        for frame in batches:
            v = Lexicon.votes(_matrix(frame))
            total += v.T @ v
        yield pd.DataFrame({"at": np.arange(m * m), "x": total.ravel()})

    sums = hits.select("found").mapInPandas(worker_pass(run), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().set_index("at")["x"]
    return sums.reindex(range(m * m), fill_value=0.0).to_numpy().reshape(m, m)


@dataclass
class Detector:
    lexicon: Lexicon
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, found: np.ndarray) -> np.ndarray:
        x = Lexicon.features(found)
        return np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -15, 15)

    def scores(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(found) + self.shift, -30, 30)))

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(np.stack([self.lexicon.hits(x) for x in texts])) if texts else np.zeros(0)


def fit(rows: DataFrame, labels: DataFrame) -> tuple[Detector, DataFrame]:
    """The detector, and the table of hits of all rows, from which voters' agreement was taken."""
    labelled = materialize(training_rows(rows, labels, "toxic", 5, 0, SAMPLE).repartition(16), "toxic-training")
    lexicon = mine(labelled)
    hits = materialize(hit_table(rows, lexicon), "toxic-hits")
    sums = agreement(hits)
    known = hit_table(labelled, lexicon, "label").select("found", "label").toPandas()
    y = known["label"].to_numpy(dtype=float)
    prior = float(np.clip((y.sum() + 1) / (len(y) + 10), 0.01, 0.5))
    model = label_model(sums, prior)
    of = max(1, -(-int(sums[-1, -1]) // POSTERIORS))
    some = _matrix(hits.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(of)) == 0).select("found").toPandas())
    detector = Detector(lexicon, np.zeros(Lexicon.features(some[:0]).shape[1] + 1))
    if len(some):
        detector.weights = _logistic(Lexicon.features(some), model.posterior(Lexicon.votes(some)), ridge=1.0)
    else:
        detector.shift = model.constant
    if len(known) and 0 < y.sum() < len(y):
        detector.slope, detector.shift = map(float, _logistic(detector.raw(_matrix(known))[:, None], y))
    return detector, hits


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    One pass over all texts for the hits, written once; voter agreement is over all rows. The
    lexicon, the linear classifier and the calibration are fitted on bounded hashed samples.
    Null and empty texts have no hits and score as such; repeated rows score alike. Without
    toxic labels the lexicon is empty and every score is low.
    """
    detector, hits = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": detector.scores(_matrix(frame))})

    out = hits.select("doc_id", "found").mapInPandas(worker_pass(run), "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and text_hash (xxhash64 of the text) of rows that score ``threshold`` or more, once each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    detector, hits = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.asarray(batch.column("found").flatten(), dtype=float).reshape(-1, WIDTH)
                yield batch.select(["doc_id", "text_hash"]).filter(pa.array(detector.scores(found) >= threshold))

    return hits.mapInArrow(worker_pass(run), "doc_id long, text_hash long").distinct()


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
