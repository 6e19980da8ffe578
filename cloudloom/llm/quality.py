"""A byte-level convolutional network for document quality, in numpy.

Bytes are embedded, learned filters of WIDTH bytes run over the whole text at every STRIDE-th byte, and their responses are
max-pooled over chunks of CHUNK bytes, each of which overlaps the next by half. The mean, maximum and minimum over all chunks
of a document, and its logarithmic length, are combined by a small dense layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .labelled import held_out, sample
from .storage import small_batches

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 6, 24, 16
CHUNK = 256
HALF = CHUNK // 2
#: Learning reads at most this many labelled documents of each class.
PER_CLASS = 1200
EPOCHS, BATCH = 6, 32
#: Halves of chunks whose windows are held at once while filters are learnt.
HALVES = 1024

Weights = dict[str, np.ndarray]


def windows(data: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """The embedded windows (n, WIDTH * EMBED), one for every STRIDE bytes; zero bytes pad the end."""
    n = -(-len(data) // STRIDE)
    padded = np.zeros(n * STRIDE + WIDTH, np.uint8)
    padded[: len(data)] = data
    e = embed[padded]
    step = e.strides[0]
    view = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * step, e.strides[1]))
    return np.ascontiguousarray(view)


def half_maxima(data: np.ndarray, w: Weights) -> np.ndarray:
    """Responses max-pooled over consecutive HALF bytes, (ceil(n / HALF), FILTERS); windows reach into the next half."""
    out = []
    for i in range(0, len(data), 512 * HALF):
        part = data[i : i + 512 * HALF + WIDTH]
        own = min(len(data) - i, 512 * HALF)
        r = windows(part, w["embed"])[: -(-own // STRIDE)] @ w["filters"]
        out.append(np.maximum.reduceat(r, np.arange(0, len(r), HALF // STRIDE)))
    return np.concatenate(out)


def pooled(data: np.ndarray, w: Weights) -> np.ndarray:
    """What the dense layer sees of one document."""
    out = np.zeros(3 * FILTERS + 1, np.float32)
    if len(data):
        h = half_maxima(data, w)
        chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        chunks = np.maximum(chunks + w["bias"], 0)
        out[:-1] = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)])
        out[-1] = np.log1p(len(data)) / 10
    return out


def probability(features: np.ndarray, w: Weights) -> np.ndarray:
    x = (features - w["mean"]) / w["scale"]
    hidden = np.tanh(x @ w["w1"] + w["b1"])
    z = hidden @ w["w2"] + w["b2"]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


class Adam:
    def __init__(self, params: Weights, rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Weights) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _halves(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All consecutive HALF bytes of the texts, each with the WIDTH bytes after it, the text of each, and how many of its windows are text."""
    counts = [-(-len(t) // HALF) for t in texts]
    out = np.zeros((sum(counts), HALF + WIDTH), np.uint8)
    own = np.zeros(len(out), np.int64)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        padded = np.zeros(n * HALF + WIDTH, np.uint8)
        padded[: len(t)] = t
        out[at : at + n] = np.lib.stride_tricks.as_strided(padded, (n, HALF + WIDTH), (HALF, 1))
        own[at : at + n] = [-(-min(HALF, len(t) - i * HALF) // STRIDE) for i in range(n)]
        at += n
    return out, np.repeat(np.arange(len(texts)), counts), own


def _learn_filters(texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Weights:
    """Embedding, filters and bias, learnt through a linear head over the mean of the whole text's max-pooled halves."""
    w = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "head": np.zeros(FILTERS, np.float32), "shift": np.zeros(1, np.float32),
    }
    adam, per = Adam(w, 0.01), HALF // STRIDE
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            crops, text, own = _halves([texts[i] for i in batch])
            n = np.maximum(np.bincount(text, minlength=len(batch)), 1)[:, None]
            best, top = np.zeros((len(crops), FILTERS), np.int64), np.zeros((len(crops), FILTERS), np.float32)
            for i in range(0, len(crops), HALVES):
                e = w["embed"][crops[i : i + HALVES]]
                view = np.lib.stride_tricks.as_strided(e, (len(e), per, WIDTH * EMBED), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))
                r = (np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED) @ w["filters"]).reshape(len(e), per, FILTERS)
                r[np.arange(per) >= own[i : i + HALVES, None]] = -np.inf  # windows that begin after the text's end
                best[i : i + HALVES] = r.argmax(axis=1)
                top[i : i + HALVES] = np.take_along_axis(r, best[i : i + HALVES, None], axis=1)[:, 0] + w["bias"]
            mean = lambda a: np.stack([np.bincount(text, a[:, f], len(batch)) for f in range(FILTERS)], axis=1) / n  # noqa: E731, B023
            features = mean(np.maximum(top, 0))
            p = 1 / (1 + np.exp(-np.clip(features @ w["head"] + w["shift"], -30, 30)))
            d = (p - y[batch]).astype(np.float32) / len(batch)
            back = ((d / n[:, 0])[text, None] * w["head"] * (top > 0)).astype(np.float32)
            g_filters, g_embed = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
            for i in range(0, len(crops), HALVES):
                part, flat = crops[i : i + HALVES], back[i : i + HALVES]
                for k in range(WIDTH):
                    byte = np.take_along_axis(part, best[i : i + HALVES] * STRIDE + k, axis=1)
                    rows = slice(k * EMBED, (k + 1) * EMBED)
                    g_filters[rows] += np.einsum("hfe,hf->ef", w["embed"][byte], flat, optimize=True)
                    shares = flat[:, :, None] * w["filters"][rows].T[None]
                    for c in range(EMBED):
                        g_embed[:, c] += np.bincount(byte.ravel(), shares[:, :, c].ravel(), 256).astype(np.float32)
            adam.step({"embed": g_embed, "filters": g_filters, "bias": back.sum(0), "head": (features.T @ d).astype(np.float32), "shift": d.sum(keepdims=True)})
    return w


def _learn_head(features: np.ndarray, y: np.ndarray, prior: float, rng: np.random.Generator) -> Weights:
    w = {"w1": rng.normal(0, 0.2, (features.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.zeros(1)}
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x, adam = (features - mean) / scale, Adam(w, 0.01)
    for _ in range(60):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            h = np.tanh(x[batch] @ w["w1"] + w["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -30, 30))) - y[batch]) / len(batch)
            dh = np.outer(d, w["w2"]) * (1 - h * h)
            adam.step({"w1": x[batch].T @ dh + 1e-4 * w["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * w["w2"], "b2": d.sum(keepdims=True)})
    # the sample's classes are drawn apart; the offset gives back the share that they have among all labels
    w["b2"] = w["b2"] + np.log(prior / (1 - prior)) - np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    return {k: v.astype(np.float32) for k, v in (w | {"mean": mean, "scale": scale}).items()}


def learn(rows: list[tuple[int, str]], prior: float, seed: int = 9) -> Weights:
    """The network's weights from (label, text) rows; with one class or none, a constant."""
    rng = np.random.default_rng(seed)
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    y = np.array([v for v, _ in rows], np.float64)
    prior = min(max(prior, 0.01), 0.99)
    if len(set(y.tolist())) < 2:
        w = {"embed": np.zeros((256, EMBED)), "filters": np.zeros((WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS)}
        w |= {"w1": np.zeros((3 * FILTERS + 1, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.log([prior / (1 - prior)])}
        w |= {"mean": np.zeros(3 * FILTERS + 1), "scale": np.ones(3 * FILTERS + 1)}
        return {k: v.astype(np.float32) for k, v in w.items()}
    w = _learn_filters(texts, y, rng)
    w = {k: w[k] for k in ("embed", "filters", "bias")}
    # short documents are rare in the sample: a short piece of each text is learnt beside the whole
    pieces = []
    for t in texts:
        n = int(np.exp(rng.uniform(np.log(24), np.log(500))))
        at = rng.integers(0, max(1, len(t) - n + 1))
        pieces.append(t[at : at + n])
    features = np.stack([pooled(t, w) for t in [*texts, *pieces]]).astype(np.float64)
    return w | _learn_head(features, np.concatenate([y, y]), prior, rng)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Weights:
    """Weights from a bounded sample of the labelled rows that are not held out; the classes' shares come from all of these."""
    used = labels.where(F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id")))
    prior = used.agg(F.avg("quality")).first()[0]
    return learn(sample(docs, labels, "quality", per_class), 0.5 if prior is None else prior)


def score(docs: DataFrame, weights: Weights, column: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row, from the whole text alone.

    Null counts as empty, and an empty text has a score; long texts are read whole. Rows are independent: repeats and ties need no rule. An
    empty table gives an empty one, and an input column named like ``column`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # some 40 KB, whatever the input
    docs = docs.drop(column)
    at, names = docs.columns.index("text"), [*docs.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(at)):
                features = np.stack([pooled(data[a:b], w) for a, b in zip(offs[:-1], offs[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(probability(features, w), pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, one for each input row, repeated ones too.

    Rows with a null doc_id are scored, and count as held out. Null labels are left out; of a doc_id that is labelled twice the larger label
    counts. Without labels every score is the same. Other columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject (a score of 0.5 or more), with all their columns, unchanged.

    Null, empty and long texts are judged as :func:`score` does, repeated rows alike. An empty table stays empty.
    """
    name = "score" if "score" not in docs.columns else "score_of_quality"
    return score(docs, train(docs, labels), name).where(F.col(name) >= 0.5).drop(name)
