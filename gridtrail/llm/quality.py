"""Quality of texts by Bradley-Terry ranking of pairs.

Method. A text becomes a vector of measures (shares of kinds of characters, word shapes, repeated
words and runs of words), taken by numpy over the bytes of a batch. From a bounded sample of labelled
rows, pairs of a good and a bad text are drawn; the logistic loss of the score difference, a linear
function of the feature difference, is minimised. The threshold is a quantile of the sample's scores:
``quantile``, where it is given, else the one that parts the labels best. Scores are given as the logistic of
their distance from it, in a scale that is fitted to the labels (Platt's smoothed targets).

Defined results. Null, empty and blank texts have zeros for all measures and are scored like others.
Texts of any length are measured whole. Repeated rows are all scored; columns but id and text aren't read, so
their names can't clash. An empty table gives no rows. Without labels of both classes every
score is the share of good labels (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import column, small_batches, spread

#: Labelled rows that pairs are drawn from, and pairs, at most.
SAMPLE_ROWS, PAIRS = 20_000, 60_000
#: Words of the runs whose repetition is measured.
RUN = 5
CHUNK = 1 << 20
#: Measures' names; each is in 0..1 or so.
KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "exclamation", "symbol", "pipe", "quote", "bracket", "other_ascii", "beyond_ascii")
MEASURES = (*KINDS, "word_length", "long_words", "symbol_ends", "upper_words", "pipe_words", "repeated_words", "repeated_runs", "line_length", "log_words")

_KIND = np.full(256, KINDS.index("other_ascii"), dtype=np.uint8)
for _name, _chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (32, 9, 11, 12, 13)), ("newline", (10,)), ("stop", b".;:"), ("comma", b",-"), ("exclamation", b"!?"), ("symbol", b"#*$%&<>=+^~_@"), ("pipe", b"|"), ("quote", b"\"'`"), ("bracket", b"()[]{}/\\"), ("beyond_ascii", range(128, 256))):
    _KIND[list(_chars)] = KINDS.index(_name)
_SYMBOL = np.isin(_KIND, [KINDS.index(k) for k in ("symbol", "pipe", "exclamation")])


def measures(texts: list) -> np.ndarray:
    """One row of MEASURES for each text."""
    out = np.zeros((len(texts), len(MEASURES)))
    for a, b in shingles.batches(texts, CHUNK):
        out[a:b] = _measures(texts[a:b])
    return out


def _measures(texts: list) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.cumsum(sizes + 1)
    kind = _KIND[data]
    counts = np.zeros((len(raw), len(KINDS)))
    for i, (stop, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        for at in range(stop - 1 - size, stop - 1, CHUNK):
            counts[i] += np.bincount(kind[at : min(at + CHUNK, stop - 1)], minlength=len(KINDS))
    out = np.zeros((len(raw), len(MEASURES)))
    out[:, : len(KINDS)] = counts / np.maximum(sizes, 1)[:, None]

    solid = (kind != KINDS.index("space")) & (kind != KINDS.index("newline"))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    word_owner = np.searchsorted(ends, starts, side="right")
    words = np.bincount(word_owner, minlength=len(raw))
    many = np.maximum(words, 1)
    per = lambda flags: np.bincount(word_owner, weights=flags, minlength=len(raw)) / many
    length = stops - starts
    uppers = np.add.reduceat(kind == KINDS.index("upper"), starts, dtype=np.int64) if len(starts) else starts
    at = len(KINDS)
    out[:, at] = per(length) / 20
    out[:, at + 1] = per(length > 14)
    out[:, at + 2] = per(_SYMBOL[data[stops - 1]]) if len(starts) else 0
    out[:, at + 3] = per((uppers >= 2) & (2 * uppers >= length)) if len(starts) else 0
    out[:, at + 4] = per((length == 1) & (data[starts] == ord("|"))) if len(starts) else 0

    hashes, n_words = shingles.word_hashes(texts)
    runs = hashes[: max(0, len(hashes) - RUN + 1)] * np.uint64(3)
    for k in range(1, RUN):
        runs = shingles.mix(runs + hashes[k : len(hashes) - RUN + 1 + k]) if len(runs) else runs
    first = 0
    for i, n in enumerate(n_words.tolist()):
        if n:
            out[i, at + 5] = 1 - len(np.unique(hashes[first : first + n])) / n
        if n > RUN:
            windows = runs[first : first + n - RUN + 1]
            out[i, at + 6] = 1 - len(np.unique(windows)) / len(windows)
        first += n
    lines = np.maximum(counts[:, KINDS.index("newline")], 0) + 1
    out[:, at + 7] = np.minimum(words / lines, 200) / 200
    out[:, at + 8] = np.log1p(words) / 10
    return out


class Ranker:
    """score = logistic((weights . standardised measures - threshold) / scale)."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float, scale: float):
        self.centre, self.spread, self.weights, self.threshold, self.scale = centre, spread, weights, threshold, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return basis(np.clip((x - self.centre) / self.spread, -4, 4)) @ self.weights

    def score(self, texts: list) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        z = (self.raw(measures(texts)) - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def basis(x: np.ndarray) -> np.ndarray:
    """Measures and their amounts beyond the usual on either side, so that both extremes can count."""
    return np.concatenate([x, np.maximum(x - 1, 0), np.maximum(-1 - x, 0)], axis=1)


def steepness(z: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic in z that fits the labels, whose targets are drawn in a little so that it stays finite."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    aim = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a = 1.0 / max(float(np.std(z)), 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z, -50, 50)))
        step = float(((aim - p) * z).sum() / max(float((p * (1 - p) * z * z).sum()), 1e-12))
        a = min(max(a + step, a / 4), a * 4)
        if abs(step) < 1e-6 * a:
            break
    return a


def learn(x: np.ndarray, y: np.ndarray, seed: int = 5, quantile: float | None = None) -> Ranker:
    """Fit the ranking on measures x with labels y (1: good)."""
    rng = np.random.default_rng(seed)
    centre, spread = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(len(MEASURES)), np.ones(len(MEASURES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Ranker(centre, spread, np.zeros(3 * len(MEASURES)), -np.log(share / (1 - share)), 1.0)
    b = basis(np.clip((x - centre) / spread, -4, 4))
    pairs = min(PAIRS, max(1000, 20 * len(x)))
    d = b[rng.choice(good, pairs)] - b[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    ridge = 2e-3 * pairs
    for _ in range(25):  # Newton steps of the pairs' logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = b @ w
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate(([np.sum(y == 0)], np.sum(y == 0) + np.cumsum(np.where(y[order] == 1, 1, -1))))
    least = np.flatnonzero(wrong == wrong.min())
    cut = int(least[len(least) // 2])  # rows of lower score that are judged bad: a quantile of the scores
    if quantile is not None:
        cut = round(quantile * len(s))
    low, high = s[order[max(0, cut - 1)]], s[order[min(len(s) - 1, cut)]]
    threshold = float((low + high) / 2)
    return Ranker(centre, spread, w, threshold, 1 / steepness(s - threshold, y))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", quantile: float | None = None) -> Ranker:
    """Learn from at most SAMPLE_ROWS labelled rows of docs, taken in the order of the hashed id; quantile: the share of them that is to score below 0.5."""
    rows = labels.select(column(labels, id_col).cast("long").alias("id"), column(labels, label_col).cast("int").alias("y")).where("id is not null and y is not null")
    rows = rows.orderBy(F.xxhash64("id"), "y").limit(SAMPLE_ROWS)
    sample = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text")).join(F.broadcast(rows), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measures(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    small_batches(docs.sparkSession)
    got = sample.select("y", "text").mapInArrow(run, "y int, x array<double>").toArrow()  # rows of figures, SAMPLE_ROWS at most
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(MEASURES))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same whatever order the rows came in
    return learn(x[order], y[order], quantile=quantile)


def scored(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely good) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranker.score(batch.column("text").to_pylist()))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return spread(source).mapInArrow(run, "doc_id long, score double")
