"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares and counts taken from the line and from the lines before and after
it; two states and their transitions make the chain. The field is fitted by gradient ascent on the likelihood of
documents whose lines all carry the document's label. Forward-backward gives each line's marginal, and the marginals,
weighted by line length, add up to the document's score.

Labels come from rows of labels whose doc_id's crc32, taken of its decimal text, is not 0 modulo 5. fit_rows and
fit_lines bound the fitted sample: that many labelled documents at most, those with the smallest hashes of their ids,
one row of each, and of a longer document that many lines in a row, from a place that its hash names; their line
features, not their texts, go to the driver, at most 52 bytes a line. Every text is scored whole. Neither labels, lang,
source nor doc_id enters a score.

A null or empty text is one empty line and gets a score like any other. A document with labels that differ counts as
good if at least half of them do; null labels are ignored. Without usable labels every score is 0.5. Rows with a null
doc_id are scored and not held out. Repeated rows are scored each for itself, very long texts one batch at a time.
Empty tables give no rows. Other columns are ignored by scored and kept by keep_good, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, with_rows
from .quality_rules import SYMBOLS

THRESHOLD = 0.3
N_OWN = 13


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line, and the lines' lengths."""
    lines = (text or "").split("\n")
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n, k = len(line), len(words)
        c, w = max(n, 1), max(k, 1)
        marks = sum(map(line.count, SYMBOLS))
        solid = sum(map(len, words))
        rows.append((
            np.log1p(n), n == 0, marks / w, line.count("|") / w, line.count("!") / w, sum(map(str.isupper, words)) / w,
            sum(map(line.count, "0123456789")) / c, solid / w / 10, len(set(words)) / w, len(set(zip(words, words[1:]))) / w,
            (max(map(len, words)) if words else 0) / 20, line in seen, line.count("!!") / w))
        seen.add(line)
    return np.array(rows, np.float32), np.array([len(x) for x in lines], np.int64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each row with the rows before and after it, and a one; there are zeros beyond the ends."""
    edge = np.zeros((1, own.shape[1]), own.dtype)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1), own.dtype)])


@dataclass
class Field:
    """weights: of the features for good over bad; moves: of transitions, [from bad or good][to bad or good]."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, own: np.ndarray) -> np.ndarray:
        return with_neighbours(((own - self.mean) / self.scale).astype(np.float64)) @ self.weights

    def score(self, texts) -> np.ndarray:
        parts = [line_features(x) for x in texts]
        if not parts:
            return np.zeros(0)
        chains = [self.emissions(own) for own, _ in parts]
        marginals, _ = forward_backward(chains, self.moves)
        return np.array([float((p * (n + 1)).sum() / (n + 1).sum()) for p, (_, n) in zip(marginals, parts, strict=True)])


def forward_backward(chains: list[np.ndarray], moves: np.ndarray, pairs: bool = False):
    """Marginals of good for each chain; with pairs, the expected transition counts summed over all chains.

    Chains lie by time, longest first, so a step works on those that are that long and nothing is padded. Messages
    are odds of good over bad.
    """
    (m00, m01), (m10, m11) = np.exp(moves - moves.max())
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    size = np.array([len(chains[i]) for i in order])
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    start = np.concatenate([[0], np.cumsum(alive)])
    places = [start[:n] + k for k, n in enumerate(size)]
    e = np.empty(start[-1])
    for at, i in zip(places, order, strict=True):
        e[at] = chains[i]
    e = np.exp(np.clip(e, -30, 30))
    fwd, bwd, ahead = e.copy(), np.ones_like(e), np.ones_like(e)
    for t in range(1, len(alive)):
        n, a, b = alive[t], start[t - 1], start[t]
        f = fwd[a : a + n]
        fwd[b : b + n] *= np.clip((m01 + m11 * f) / (m00 + m10 * f), 1e-30, 1e30)
    for t in range(len(alive) - 2, -1, -1):
        n, a, b = alive[t + 1], start[t], start[t + 1]
        g = e[b : b + n] * bwd[b : b + n]
        ahead[a : a + n] = g
        bwd[a : a + n] = (m10 + m11 * g) / (m00 + m01 * g)
    odds = fwd * bwd
    odds /= 1 + odds
    marginals = [None] * len(chains)
    for at, i in zip(places, order, strict=True):
        marginals[i] = odds[at]
    counts = np.zeros((2, 2))
    if pairs and len(alive) > 1:
        on = np.concatenate([np.arange(start[t], start[t] + alive[t + 1]) for t in range(len(alive) - 1)])
        f, g = fwd[on], ahead[on]
        cells = np.stack([np.full_like(f, m00), m01 * g, m10 * f, m11 * f * g])
        counts = (cells / cells.sum(0)).sum(1).reshape(2, 2)
    return marginals, counts


def fit(docs: list[np.ndarray], good: list[int], rounds: int = 80, rate: float = 0.1, penalty: float = 1.0) -> Field | None:
    """The field of most likelihood, less a penalty on squares; docs: own features of each line."""
    if not docs:
        return None
    everything = np.vstack(docs)
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    x = [with_neighbours(((d - mean) / scale).astype(np.float64)) for d in docs]
    flat, y = np.vstack(x), np.repeat(np.array(good, np.float64), [len(d) for d in x])
    steps = np.array([len(d) - 1 for d in x], np.float64)
    true = np.zeros((2, 2))
    for c in (0, 1):
        true[c, c] = steps[np.array(good) == c].sum()
    weights, moves = np.zeros(flat.shape[1]), np.zeros((2, 2))
    ends = np.cumsum([len(d) for d in x])[:-1]
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for t in range(1, rounds + 1):
        marginals, counts = forward_backward(np.split(flat @ weights, ends), moves, True)
        grads = (flat.T @ (y - np.concatenate(marginals)) - penalty * weights, true - counts - 10 * penalty * moves)
        for k, (value, g) in enumerate(zip((weights, moves), grads, strict=True)):
            g = g / len(docs)
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            value += rate * state[2 * k] / (1 - 0.9**t) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
    return Field(weights, moves, mean, scale)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 2000, fit_lines: int = 1000) -> Field | None:
    """The field fitted to the labelled sample; null without labels of both kinds."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    # at most fit_rows rows are broadcast, and as many documents' features collected
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                x = line_features(text)[0]
                at = zlib.crc32(str(i).encode()) % max(len(x) - fit_lines + 1, 1)
                own.append(x[at : at + fit_lines].tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "good": pdf["good"], "own": own})

    found = texts.mapInPandas(with_rows(features), "doc_id long, good int, own binary")
    rows = found.groupBy("doc_id", "good").agg(F.min("own").alias("own")).collect()  # one row for each chosen document
    rows.sort(key=lambda r: r["doc_id"])
    if len({r["good"] for r in rows}) < 2:
        return None
    return fit([np.frombuffer(r["own"], np.float32).reshape(-1, N_OWN) for r in rows], [r["good"] for r in rows])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, to: str = "quality", **how) -> DataFrame:
    """docs with a struct column to: held_out, score, predicted."""
    field = learn(docs, labels, **how)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.full(len(texts), 0.5) if field is None else np.clip(field.score(texts), 0, 1))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.withColumn(to, score(F.col("text").cast("string"))).withColumn(
        to, F.struct(held.alias("held_out"), F.col(to).alias("score"), (F.col(to) >= threshold).cast("int").alias("predicted")))


def free_name(df: DataFrame, name: str) -> str:
    """name with as many marks behind as make it differ from all columns of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    c = classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, to="q")
    return c.select("doc_id", "q.held_out", "q.score", "q.predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier does not reject, with all their columns."""
    to = free_name(docs, "quality")
    return classify(docs, labels, to=to).where(F.col(f"{to}.predicted") == 1).drop(to)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
