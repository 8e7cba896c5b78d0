"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: raw bytes, lower-cased bytes, and marks of repeated words. Each indicator is scaled by its
smoothed log-count ratio between the classes (counted over every labelled training row), vectors are scaled to length 1,
and a linear hinge-loss model is fitted by dual coordinate descent (Hsieh et al., 2008) on a bounded sample of the labelled
rows: `sample` rows of each class, by hash of the id. A logistic curve on the margins of the sample turns margins into scores.

Defined results: null or empty text has no features and gets the score of the intercept. Repeated labels of an id are averaged;
null labels don't count. With no labelled rows, or one class only, every score is that class's share (0.5 without rows). Repeated rows count each, ties
of hashes go by id. A text's features are one bit each, so its length bounds nothing but its own task's time. Other columns pass through; columns
of the names of score and prediction are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, encode, map_texts, word_hashes

DIMS = 1 << 16
SAMPLE = 5000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def feature_lists(texts: list) -> Iterator[np.ndarray]:
    """For each text the sorted ids of its n-grams: 3 raw bytes, 5 lower-cased bytes, 2 words with equal words alike
    (a word that repeats the one before it, or the one two before it), 4 of those marks."""
    words, offsets = word_hashes(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        raw = np.frombuffer(b"\n" + encode(text) + b"\n", np.uint8) if isinstance(text, str) and text else np.zeros(0, np.uint8)
        seen = np.zeros(DIMS, bool)
        for n, codes, salt in ((3, raw, 0x9E3779B97F4A7C15), (5, _LOWER[raw], 0xC2B2AE3D27D4EB4F), (4, _marks(words[a:b]), 0x165667B19E3779F9)):
            if len(codes) >= n:
                wide = codes.astype(U64)
                gram = np.zeros(len(codes) - n + 1, U64)
                for j in range(n):
                    gram |= wide[j : len(codes) - n + 1 + j] << U64(8 * j)
                seen[(gram * U64(salt) + U64(n << 60)) >> U64(48)] = True
        yield np.flatnonzero(seen).astype(np.int32)


def _marks(words: np.ndarray) -> np.ndarray:
    """Per word: 1 + whether it equals the word before (1) or two before (2)."""
    out = np.ones(len(words), np.uint8)
    out[1:] += words[1:] == words[:-1]
    out[2:] += np.uint8(2) * (words[2:] == words[:-2])
    return out


def features(text: object) -> np.ndarray:
    return next(feature_lists([text]))


@dataclass
class Model:
    weights: np.ndarray  # over features, log-count ratios included
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray, ratios: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        return float(self.weights[ids].sum() / max(1e-12, np.sqrt((ratios[ids] ** 2).sum()))) + self.bias

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def dual_descent(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, tol: float = 0.02, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM with a bias feature of 1: (weights, bias). cost: the upper bound of each row's dual variable.

    rows hold feature ids only; a row's values, its ratios scaled to length 1, are made when it is visited.
    """
    scale = np.array([1.0 / max(1e-12, np.sqrt((ratios[r] ** 2).sum())) for r in rows])
    w, bias = np.zeros(DIMS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([(ratios[r] ** 2).sum() * s * s + 1.0 for r, s in zip(rows, scale, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            values = ratios[rows[i]] * scale[i]
            g = y[i] * (w[rows[i]] @ values + bias) - 1.0
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost[i] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * values
                bias += step
        if worst < tol:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of Platt's curve by damped Newton steps, with his smoothed targets."""
    pos = y > 0
    t = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum(), (s * margins).sum()], [(s * margins).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5.0 / max(1e-12, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(a, 0.0), b


def _in_parts(texts: pd.Series, size: int = 256) -> Iterator[np.ndarray]:
    for k in range(0, len(texts), size):
        yield from feature_lists(texts.iloc[k : k + size].tolist())


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = np.zeros((2, DIMS), np.int64)
    total = np.zeros(2, np.int64)
    for pdf in batches:
        for ids, good in zip(_in_parts(pdf["text"]), pdf["good"], strict=True):
            found[int(good), ids] += 1
            total[int(good)] += 1
    at = np.flatnonzero(found.any(axis=0))
    yield pd.DataFrame({"feature": np.append(at, -1), "bad": np.append(found[0, at], total[0]), "good": np.append(found[1, at], total[1])})


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": pdf["h"], "good": pdf["good"], "ids": [ids.astype(np.uint16).tobytes() for ids in _in_parts(pdf["text"])]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = 1.0, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Model, np.ndarray]:
    """docs: the training rows only. The driver gets at most DIMS counts and 2 * sample vectors."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id"))
    marks = marks.agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("good")).withColumn("h", F.xxhash64("__id", F.lit(1)))
    marks = marks.hint("merge")  # labels grow with the documents: one plan at every size, never a broadcast
    body = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("text"))
    train = body.join(marks, "__id")
    counted = train.select("text", "good").mapInPandas(_counts, "feature int, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    totals = counted[counted["feature"] == -1]
    n_bad, n_good = (int(totals["bad"].sum()), int(totals["good"].sum())) if len(totals) else (0, 0)
    if not n_bad or not n_good:
        share = n_good / (n_bad + n_good) if n_bad + n_good else 0.5
        return Model(np.zeros(DIMS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))), np.zeros(DIMS)
    p, q = np.ones(DIMS), np.ones(DIMS)
    real = counted[counted["feature"] >= 0]
    p[real["feature"]] += real["good"]
    q[real["feature"]] += real["bad"]
    ratios = np.log((p / (n_good + 2)) / (q / (n_bad + 2)))
    # the bounded sample: per class the smallest hashes among training rows, found by id before texts are read
    known = body.select("__id").join(marks, "__id")
    picked = [known.where(F.col("good") == g).select("__id", "good", "h").distinct().orderBy("h", "__id").limit(sample) for g in (False, True)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample rows
    got = body.join(chosen, "__id").select("h", "good", "text").mapInPandas(_vectors, "h long, good boolean, ids binary").toPandas()
    got = got.sort_values(["h", "ids"], kind="stable").reset_index(drop=True)
    rows = [np.frombuffer(x, np.uint16) for x in got["ids"]]  # views of the collected bytes
    y = np.where(got["good"].to_numpy(bool), 1.0, -1.0)
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    # balanced within the fit; the curve below restores the classes' shares
    bound = cost * 0.5 / np.maximum(share, 1e-9)[(y > 0).astype(int)]
    w, bias = dual_descent(rows, ratios, y, bound)
    margins = np.array([(w[r] @ ratios[r]) / max(1e-12, np.sqrt((ratios[r] ** 2).sum())) + bias for r in rows])
    slope, offset = logistic(margins, y)
    # the sample may be balanced: shift the odds to the classes' shares in all labelled rows
    offset += float(np.log(n_good / n_bad) - np.log((y > 0).sum() / (y < 0).sum()))
    return Model(w * ratios, bias, slope, offset), ratios


def score(docs: DataFrame, model: Model, ratios: np.ndarray, threshold: float = 0.3, *, text: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score and predicted (1 from the threshold on), by a narrow scan; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast((model, ratios))

    def make() -> Callable[[list], list]:
        m, r = held.value

        def go(texts: list) -> list:
            s = np.array([m.score(m.margin(ids, r)) for ids in feature_lists(texts)], dtype=float)
            return [s, (s >= threshold).astype(np.int32)]

        return go

    return map_texts(docs, text, make, {score_col: ("double", pa.float64()), predicted_col: ("int", pa.int32())}, rows=256)
