"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

The features of a text are the hashed n-grams (bytes of the lower-cased text, white space as one space)
that it holds, each counted once. Every feature is scaled by r = log of the ratio of its smoothed share
among toxic and among clean training texts; a logistic regression is fitted on the scaled features that
differ significantly between the two.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import id_text, map_rows, slices

ORDERS = (3, 4, 5, 6)
BITS = 20
_SPACE = re.compile(rb"[\x00-\x20]+")


@dataclass(frozen=True)
class Settings:
    """sample: training rows of each label at most (those with the least hash of the id), the only bound.
    min_docs: training texts that a feature must be in. min_z: how many standard errors its log ratio must
    be from zero. decay: weight of the squared norm. rounds: steps of the fit."""

    sample: int = 2500
    min_docs: int = 4
    min_z: float = 4.0
    decay: float = 1e-3
    rounds: int = 200


class Grams:
    """The distinct hashed n-grams of a text; keeps one table so that no text needs sorting."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer(b" " + _SPACE.sub(b" ", (text or "").lower().encode()).strip() + b" ", np.uint8).astype(np.uint64)
        value, found = raw.copy(), []
        for n in range(2, max(ORDERS) + 1):
            if len(raw) < n:
                break
            value = (value[:-1] << np.uint64(8)) | raw[n - 1 :]
            if n in ORDERS:
                found.append((((value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
        if not found:
            return np.array([], np.int32)
        all_grams = np.concatenate(found)
        order = np.arange(len(all_grams), dtype=np.int32)
        self.last[all_grams] = order
        return all_grams[self.last[all_grams] == order]


@dataclass(frozen=True)
class Model:
    """weights: of each hashed n-gram, the ratio already in it; most are zero."""

    weights: np.ndarray
    bias: float

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[grams].sum(dtype=np.float64), -500, 500))))


def fit(texts: list[str | None], toxic: list[int], prior: float | None = None, settings: Settings = Settings()) -> Model:
    """Fit on labelled texts. prior: share of toxic rows where the model will be used, if the sample's differs.

    With one label alone, or no text, the model gives the prior's side to every text.
    """
    y = np.asarray(toxic, float)
    grams = Grams()
    rows = [grams(t) for t in texts]
    share = prior if prior is not None else (float(y.mean()) if len(y) else 0.0)
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < y.sum() < len(y):
        return Model(weights, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for row, label in zip(rows, y, strict=True):
        (p if label else q)[row] += 1
    r = np.log((p + 1) / (y.sum() + 2)) - np.log((q + 1) / (len(y) - y.sum() + 2))
    z = r / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    chosen = np.flatnonzero((p + q >= settings.min_docs) & (np.abs(z) >= settings.min_z))
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    kept = [(x := place[row])[x >= 0] for row in rows]
    column = np.concatenate(kept) if kept else np.array([], int)
    row_of = np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    value = r[chosen][column]
    w, b = np.zeros(len(chosen)), 0.0
    speed_w, speed_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(settings.rounds):  # full-batch Adagrad
        score = b + np.bincount(row_of, value * w[column], minlength=len(rows))
        off = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - y
        slope = np.bincount(column, value * off[row_of], minlength=len(chosen)) / len(rows) + settings.decay * w
        slope_b = off.mean()
        speed_w, speed_b = speed_w + slope**2, speed_b + slope_b**2
        w, b = w - 0.3 * slope / np.sqrt(speed_w), b - 0.3 * slope_b / np.sqrt(speed_b)
    weights[chosen] = w * r[chosen]
    if prior is not None and 0 < prior < 1:
        seen = y.mean()
        b += np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))
    return Model(weights, float(b))


def held_out(key: str = "doc_id"):
    """crc32(doc_id as text) mod 5 is 0; never trained on. A null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows of `labels` (doc_id, toxic) that are not held out; null labels are passed over.

    The texts of at most settings.sample rows a label meet in one task, which fits and returns the non-zero
    weights; no text reaches the driver. The share of toxic rows is counted over all rows. An id that has
    several labels counts as toxic if one says so; of several texts, the first. Without texts or with one
    label alone the model gives the labels' side to every text; without labels it calls every text clean.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else None
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = id_text(docs).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches):
        parts = [b.select(["text", "toxic"]) for b in batches]
        column = lambda name: [v for b in parts for v in b.column(name).to_pylist()]
        model = fit(column("text"), column("toxic"), prior, settings)
        at = np.flatnonzero(model.weights).astype("<i4")
        yield pa.RecordBatch.from_pydict({"at": [at.tobytes()], "value": [model.weights[at].astype("<f4").tobytes()], "bias": [model.bias]})

    fitted = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "at binary, value binary, bias double").collect()
    if not fitted:
        return fit([], [], prior, settings)
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(fitted[0]["at"], "<i4")] = np.frombuffer(fitted[0]["value"], "<f4")
    return Model(weights, fitted[0]["bias"])


def _setup(docs: DataFrame, model: Model):
    """Sends the non-zero weights to the executors; returns what makes the model there."""
    at = np.flatnonzero(model.weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.weights[at], model.bias))

    def setup() -> tuple:
        at, value, bias = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = value
        return Grams(), Model(weights, bias)

    return setup


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from the whole text alone; null and empty texts get the bias's score."""

    def of(part: pa.RecordBatch, held: tuple) -> dict:
        grams, own = held
        return {"doc_id": part.column("doc_id"), "score": [own.score(grams(t)) for t in part.column("text").to_pylist()]}

    return map_rows(id_text(docs), "text", of, "doc_id long, score double", _setup(docs, model))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5. No shuffle."""
    setup = _setup(docs, model)

    def run(batches):
        grams, own = setup()
        for part in slices(batches, text):
            yield part.filter(pa.array([own.score(grams(t)) < 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; predicted is 1 where score >= 0.5."""
    scored = score_rows(docs, train(docs, labels, settings))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
