"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a better and a worse labelled document are drawn; weights minimise the logistic loss of the difference of
their features (the Bradley-Terry likelihood). A document's score is the weighted sum of its features; the threshold
is a quantile of the labelled documents' scores, the one that separates the labels best. Scores are shown in 0..1 by a
logistic curve through the threshold.

Features are read from the whole text: shares of character classes, repetition, word and line shapes. doc_id, lang,
source and labels are no features.

Labels are fitted on at most `max_labelled` rows (the first by hash of doc_id): a documented bound on what the driver
gathers. Without both labels all scores are 0.5. Rules: a null text is empty; several labels of a doc_id count by their
mean; rows that repeat a doc_id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import pick

MAX_LABELLED = 20_000
PAIRS = 200_000
SEED = 20240611
SYMBOLS = b"!|#*$%&.,;:?-_/\\<>=@\"'()[]{}"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:]))
    letters = count[65:91].sum() + count[97:123].sum()
    lines = raw.split(b"\n")
    shown = [x for x in lines if x.strip()]
    short = sum(1 for w in words if len(w) <= 3)
    alone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    marked = sum(1 for w in words if w[-3:-2] == w[-2:-1] == w[-1:] and not w[-1:].isalnum())
    cased = sum(map(str.isupper, text.split())) if text else 0
    starts = sum(1 for w in words if 65 <= w[0] <= 90)
    entropy = -float(np.sum((p := count[count > 0] / n) * np.log(p)))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), count[65:91].sum() / max(1.0, letters), count[48:58].sum() / n, count[128:].sum() / n, (count[32] + count[9:14].sum()) / n,
        distinct / m, np.log(distinct + 1) / np.log(m + 2), again / m, n / m, short / m, alone / m, marked / m, cased / m, starts / m, entropy,
        np.log1p(len(shown)), 1 - len(set(shown)) / max(1, len(shown)), len(words) / max(1, len(shown)) / 100, count[[33, 35, 36, 37, 38, 42, 124]].sum() / m,
        *[count[c] / m for c in SYMBOLS],
    ]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray, cut: float) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bradley_terry(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = SEED, ridge: float = 1e-3) -> Ranker:
    """Newton's method on the pairs' logistic loss; then the score quantile that separates the labels best."""
    width = x.shape[1] if x.ndim == 2 else len(features(""))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -np.log(7 / 3), 1.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(width)
    for _ in range(25):
        grad, hess = -ridge * w, ridge * np.eye(width)
        for at in range(0, pairs, 20_000):
            d = z[better[at : at + 20_000]] - z[worse[at : at + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # how wrong each pair is
            grad += d.T @ p / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.sort(s)
    # quantiles of all labelled scores; balanced accuracy chooses among them
    grid = np.unique(np.quantile(order, np.linspace(0.001, 0.999, 999)))
    right = (np.searchsorted(np.sort(s[bad]), grid, "left") / len(bad) + 1 - np.searchsorted(np.sort(s[good]), grid, "left") / len(good)) / 2
    best = grid[right >= right.max() - 1e-12]
    return Ranker(mean, scale, w, float(best[len(best) // 2]), 1.0 / max(1e-9, float(s.std())) * 3)


def feature_rows(docs: DataFrame, extra: str = "") -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            cols = [batch.column("doc_id"), *([batch.column(extra)] if extra else []), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *([extra] if extra else []), "x"])

    return docs.mapInArrow(run, f"doc_id {kind}," + (f" {extra} int," if extra else "") + " x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Fits on labelled doc_ids outside the held-out fold, at most `max_labelled` of them, which is what is broadcast and gathered.

    Of rows that repeat a doc_id the greatest text stands for it.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("_q")).where("_q != 0.5")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", (F.col("_q") > 0.5).cast("int").alias("label"))
    marked = pick(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    got = feature_rows(marked, "label").toPandas().sort_values("doc_id")  # one order, so that reruns draw the same pairs
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(features("")))
    return bradley_terry(x, got["label"].to_numpy())


def score(docs: DataFrame, ranker: Ranker, cut: float = 0.3) -> DataFrame:
    """doc_id, score in 0..1, predicted (1 if score >= cut) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], dtype=float).reshape(batch.num_rows, len(ranker.mean))
            s = ranker.scores(x, cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker, cut: float = 0.3) -> DataFrame:
    """The rows of docs that score at least `cut`, all columns; judged as they stream by, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.as_py()) for t in batch.column("text")], dtype=float).reshape(batch.num_rows, len(ranker.mean))
                yield batch.filter(pa.array(ranker.scores(x, cut) >= cut))

    return docs.mapInArrow(run, docs.schema)
