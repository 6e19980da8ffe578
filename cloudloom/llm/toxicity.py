"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A document's features are its distinct lower-cased words and their beginnings (stems of inflected and compound words), and the beginnings
that two different words share, hashed to 2^20 places. One weight vector w is shared by all ordered thresholds
t1 < t2 < ...: P(grade > k) = sigmoid(w.x - t_{k+1}). The severity is the expected grade, the sum of these probabilities.

Labels that are graded (0, 1, 2, ...) are used as they are. Labels of two values are graded first: of the toxic documents, the number of
distinct words that tell the classes apart puts each into the lower, middle or upper third (grades 1 to 3).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .labelled import held_out, sample
from .storage import small_batches

BITS = 20
PLACES = 1 << BITS
#: Bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10, 12)
#: Learning reads at most this many labelled documents of each class or grade.
PER_CLASS = 1500
STEPS, PENALTY = 300, 0.001
#: Features are weighed if their share among the classes differs by this chi-squared statistic (one in ten thousand do by chance).
SIGNIFICANT = 15.14
#: What tells the classes apart less than this is penalised more, and the other way round: rare words of single documents stay small.
TELLING, POWER = 100.0, 1.0
#: A document counts as toxic from this P(grade > 0) on: a missed one costs more than a false alarm.
DECISION = 0.2

Model = dict[str, np.ndarray]


def _places(w: X.Words) -> np.ndarray:
    """Places (1 + beginnings, words) of every word and of its beginnings; -1 where it has no longer one."""
    length = pc.binary_length(w.distinct).to_numpy(zero_copy_only=False)
    place = np.empty((1 + len(BEGINNINGS), len(length)), np.int64)
    place[0] = X.word_digests(w.distinct)[:, 0] >> np.uint64(64 - BITS)
    for i, cut in enumerate(BEGINNINGS):
        place[i + 1] = X.mix(X.word_digests(w.distinct, cut)[:, 0] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BITS)
        place[i + 1, length <= cut] = -1
    return place[:, w.codes]


def features(w: X.Words, weighed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature of every row; with ``weighed``, of those places and of what two words share there."""
    place = _places(w)
    n = place.shape[0]
    row = np.tile(np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr)), n)
    word = np.tile(w.hashes, n)
    place = place.ravel()
    use = place >= 0
    if weighed is not None:
        use &= weighed[place] | weighed[shared_place(place)]
    key, word = row[use] * PLACES + place[use], word[use]
    order = np.lexsort((word, key))
    key, word = key[order], word[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    once = key[new]
    # a second, different word at the same place
    again = np.zeros(len(key), bool)
    again[1:] = ~new[1:] & (word[1:] != word[:-1])
    twice = np.unique(key[again])
    out = np.concatenate([once, twice - twice % PLACES + shared_place(twice % PLACES)])
    return np.divmod(out, PLACES)


def shared_place(place: np.ndarray) -> np.ndarray:
    return (place * 0x2545F491 + 0x1337) % PLACES


def _grades(y: np.ndarray, row: np.ndarray, place: np.ndarray, words: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen places, how well each tells the classes apart, and the grades of binary labels."""
    toxic = y > 0
    inside = np.bincount(place[toxic[row]], minlength=PLACES)
    outside = np.bincount(place[~toxic[row]], minlength=PLACES)
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    both = inside + outside
    # the square of the difference in share, by its variance
    share = both / (n1 + n0)
    apart = (inside / n1 - outside / n0) ** 2 / np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12)
    chosen = np.flatnonzero(apart > SIGNIFICANT)
    if len(np.unique(y)) > 2 or not toxic.any():
        return chosen, apart[chosen], y
    telling = np.zeros(PLACES + 1, bool)  # the last: no place
    odds = np.log((inside + 0.5) / (n1 + 1)) - np.log((outside + 0.5) / (n0 + 1))
    telling[chosen[(odds[chosen] > np.log(4)) & (apart[chosen] > 10)]] = True
    hit = telling[_places(words)].any(axis=0)
    row_of = np.repeat(np.arange(len(y)), np.diff(words.ptr))[hit]
    # distinct ones: the features are presences too, so that more of them can mean a higher grade
    hits = np.bincount(np.divmod(np.unique(row_of * PLACES + (words.hashes[hit] >> np.uint64(64 - BITS)).astype(np.int64)), PLACES)[0], minlength=len(y))
    cuts = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    return chosen, apart[chosen], np.where(toxic, 1 + np.searchsorted(cuts, hits, "left"), 0)


def learn(rows: list[tuple[int, str]], prior: float) -> Model:
    """Weights and thresholds from (label, text) rows; ``prior`` is the share of label 0 among all labels."""
    column = pa.array([t for _, t in rows], pa.string())
    data, offs = X.raw(column)
    words = X.words(data, offs, X.ALNUM, True)
    row, place = features(words)
    y = np.array([v for v, _ in rows], np.int64)
    weights = np.zeros(PLACES, np.float32)
    prior = min(max(prior, 0.01), 0.99)
    if len(np.unique(y)) < 2:
        return {"weights": weights, "thresholds": np.array([np.log(prior / (1 - prior))])}
    chosen, apart, grade = _grades(y, row, place, words)
    index = np.full(PLACES, -1)
    index[chosen] = np.arange(len(chosen))
    known = index[place] >= 0
    row, column = row[known], index[place[known]]  # the features are sparse and all ones
    top = int(grade.max())
    w = np.zeros(len(chosen))
    first, steps = np.zeros(1), np.zeros(top - 1)  # t1, and the logarithms of the steps between thresholds
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, first, steps)]
    for t in range(1, STEPS + 1):
        gaps = np.exp(steps)
        cut = first + np.concatenate([[0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(y))[:, None] - cut, -30, 30)))
        p = np.concatenate([np.ones((len(y), 1)), p, np.zeros((len(y), 1))], axis=1)
        mass = np.maximum(p[np.arange(len(y)), grade] - p[np.arange(len(y)), grade + 1], 1e-9)
        # d log P(grade) / d (w.x - t_k): the density at the upper edge counts up, at the lower edge down
        d = np.zeros((len(y), top + 2))
        s = p * (1 - p)
        d[np.arange(len(y)), grade] = s[np.arange(len(y)), grade] / mass
        d[np.arange(len(y)), grade + 1] = -s[np.arange(len(y)), grade + 1] / mass
        d = d[:, 1:-1] / len(y)
        by_cut = -d.sum(0)
        grads = (-np.bincount(column, d.sum(1)[row], len(chosen)) + PENALTY * (TELLING / apart) ** POWER * w, -by_cut.sum(keepdims=True), -np.cumsum(by_cut[::-1])[::-1][1:] * gaps)
        for (value, m, v), g in zip(state, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    # the sample's classes are drawn apart; the thresholds give back the share that label 0 has among all labels
    mine = (y == 0).mean()
    shift = np.log(prior / (1 - prior)) - np.log(mine / (1 - mine))
    weights[chosen] = w
    return {"weights": weights, "thresholds": first + np.concatenate([[0], np.cumsum(np.exp(steps))]) + shift}


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out; the classes' shares come from all of these."""
    used = labels.where(F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    prior = used.agg(F.avg(F.when(F.col("toxic") == 0, 1).otherwise(0))).first()[0]
    return learn(sample(docs, labels, "toxic", per_class, graded=True), 0.9 if prior is None else prior)


def above(w: X.Words, model: Model) -> np.ndarray:
    """P(grade > k) of every row, (rows, thresholds)."""
    row, place = features(w, model["weights"] != 0)
    value = model["weights"][place]
    z = np.bincount(row, weights=value, minlength=len(w.ptr) - 1)
    return 1 / (1 + np.exp(-np.clip(z[:, None] - model["thresholds"], -500, 500)))


NEW = [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds severity (the expected grade), grade (the likeliest) and toxic (P(grade > 0) >= DECISION) to every row.

    Whole texts are read, however long. Null counts as empty; an empty text is scored by the thresholds alone. Input columns of these names
    are replaced. Rows are independent: repeats and ties need no rule. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    docs = docs.drop(*(f.name for f in NEW))
    at, names = docs.columns.index("text"), [*docs.columns, *(f.name for f in NEW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in X.blocks(batch.column(at)):
                p = above(X.words(data, offs, X.ALNUM, True), shared.value)
                edges = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
                grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
                made = [pa.array(p.sum(axis=1), pa.float64()), pa.array(grade, pa.int32()), pa.array(p[:, 0] >= DECISION, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *made], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *NEW]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, severity, grade and toxic of every row, one for each input row, repeated ones too.

    Rows with a null doc_id are scored, and count as held out. Null and negative labels are left out; of a doc_id that is labelled twice the
    larger label counts. Without labels, or with one value only, every severity is the same. Other columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *(f.name for f in NEW))
