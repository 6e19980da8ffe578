import zlib

import numpy as np
import pytest

from cloudloom.llm import labelled, quality, toxicity
from pyspark.sql import functions as F

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_folds(docs):
    for r in docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_quality_on_held_out_rows(spark, big):
    docs, labels = big
    got = quality.judge(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    kept = np.mean([r.predicted for r in got if r.quality == 1])
    assert right > 0.97 and kept > 0.985 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_on_held_out_rows(spark, big):
    docs, labels = big
    got = toxicity.judge(docs, labels).where("held_out").join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    found = np.mean([r.toxic for r in got if r.label == 1])
    wrong = np.mean([r.toxic for r in got if r.label == 0])
    assert found > 0.8 and wrong < 0.01
    assert np.mean([r.severity for r in got if r.label == 1]) > 10 * np.mean([r.severity for r in got if r.label == 0])
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got)


def test_thresholds_are_ordered_and_grades_count():
    rows = [(g, " ".join(["plain"] * 20 + ["bad"] * (g > 0) + ["worse"] * (g > 1) + ["worst"] * (g > 2) + [f"n{i}"])) for i, g in enumerate([0, 1, 2, 3] * 40)]
    model = toxicity.learn(rows, 0.5)
    assert (np.diff(model["thresholds"]) > 0).all()
    import pyarrow as pa

    from cloudloom.llm import textops as X

    data, offs = X.raw(pa.array(["plain", "plain bad", "plain bad worse", "plain bad worse worst"]))
    severity = toxicity.above(X.words(data, offs, X.ALNUM, True), model).sum(1)
    assert (np.diff(severity) > 0).all()


def test_network_covers_every_byte():
    rng = np.random.default_rng(0)
    w = {"embed": rng.normal(size=(256, quality.EMBED)).astype("f4"), "filters": rng.normal(size=(quality.WIDTH * quality.EMBED, quality.FILTERS)).astype("f4")}
    for n in (1, 7, 128, 129, 1000, 70_000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        e = np.concatenate([w["embed"][data], np.tile(w["embed"][0], (quality.WIDTH + 1, 1))])
        plain = [np.concatenate(e[i : i + quality.WIDTH]) @ w["filters"] for i in range(0, n, quality.STRIDE)]
        half = quality.HALF // quality.STRIDE
        want = [np.max(plain[i : i + half], axis=0) for i in range(0, len(plain), half)]
        assert np.allclose(quality.half_maxima(data, w), want, atol=1e-3)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, weird, nothing, docs, labels, module, label):
    got = module.judge(weird, labels.where("doc_id > 20")).collect()
    assert len(got) == weird.count() and all(r.held_out for r in got if r.doc_id is None)
    assert module.judge(nothing, labels).count() == 0
    none = labels.where("false")
    assert module.judge(weird, none).count() == weird.count()
    odd = labels.limit(3).selectExpr("doc_id", "cast(null as int) as quality", "cast(null as int) as toxic", "'x' as text")
    assert module.judge(docs, odd).count() == docs.count()
    one = labels.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert module.judge(docs.limit(20), one.union(one)).count() == 20


def test_filter_keeps_columns(spark, docs, labels):
    got = quality.keep_good(docs.withColumn("score", F.lit("mine")), labels)
    assert got.columns == [*docs.columns, "score"] and 0 < got.count() < docs.count()


def test_every_grade_is_sampled(spark):
    """Rows of all grades are learnt from, so many of each at most; binary samples read 0 and 1 only."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 5 if i % 5 < 4 else None) for i in range(200)], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", 7, graded=True)
    assert sorted(v for v, _ in rows) == [v for v in range(4) for _ in range(7)] and all(int(t.split()[1]) % 5 == v for v, t in rows)
    assert sorted(v for v, _ in labelled.sample(docs, labels, "toxic", 7)) == [0] * 7 + [1] * 7
    assert labelled.sample(docs, labels.where("false"), "toxic", 7, graded=True) == []


def test_network_against_a_plain_one():
    """Scores of whole texts from a loop over chunks, filters and layers."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)).decode() for n in (0, 1, 5, 127, 129, 255, 257, 900, 5000)]
    w = quality.learn([(i % 2, t) for i, t in enumerate(texts)], 0.5)
    for t in texts:
        data = t.encode()
        padded = data + bytes(quality.WIDTH + quality.STRIDE)
        response = [np.concatenate([w["embed"][b] for b in padded[i : i + quality.WIDTH]]) @ w["filters"] for i in range(0, len(data), quality.STRIDE)]
        halves = [np.max(response[i : i + 64], axis=0) for i in range(0, len(response), 64)]
        chunks = [np.maximum(np.maximum(a, b) + w["bias"], 0) for a, b in zip(halves, halves[1:] if len(halves) > 1 else halves)]
        x = np.zeros(3 * quality.FILTERS + 1)
        if chunks:
            x = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), np.min(chunks, 0), [np.log1p(len(data)) / 10]])
        hidden = np.tanh((x - w["mean"]) / w["scale"] @ w["w1"] + w["b1"])
        plain = 1 / (1 + np.exp(-(hidden @ w["w2"] + w["b2"])))
        assert abs(float(quality.probability(quality.pooled(np.frombuffer(data, np.uint8), w), w)) - float(plain[0] if np.ndim(plain) else plain)) < 1e-3


def test_severity_against_a_plain_sum():
    """P(grade > k) from sets of words, beginnings and shared beginnings, one document at a time."""
    import pyarrow as pa

    from cloudloom.llm import textops as X

    rng = np.random.default_rng(2)
    model = {"weights": rng.normal(0, 1, toxicity.PLACES).astype(np.float32), "thresholds": np.array([-1.0, 0.5, 2.0])}
    texts = ["", "bad Badly badness, goodness good", "stone stones stonework stone", " ".join(f"wort{i}heit" for i in range(300)), None]
    got = toxicity.above(X.words(*X.raw(pa.array(texts)), X.ALNUM, True), model)

    def place(word, cut=None):
        h = X.word_digests(pa.array([word.encode()[:cut]], pa.large_binary()))[:, 0]
        return int((h if cut is None else X.mix(h ^ np.uint64(0x5851F42D4C957F2D)))[0] >> np.uint64(64 - toxicity.BITS))

    for row, text in zip(got, texts, strict=True):
        owners = {}
        for word in set((text or "").lower().replace(",", "").split()):
            for at in {place(word)} | {place(word, c) for c in toxicity.BEGINNINGS if len(word) > c}:
                owners.setdefault(at, set()).add(word)
        seen = set(owners) | {int(toxicity.shared_place(at)) for at, words in owners.items() if len(words) > 1}
        z = sum(float(model["weights"][at]) for at in seen)
        assert np.allclose(row, 1 / (1 + np.exp(-(z - model["thresholds"]))), atol=1e-4)
