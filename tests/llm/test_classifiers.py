"""Quality and toxicity scores: held-out accuracy, folds, odd rows, no labels."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.llm import ngrams, quality_nbsvm, toxicity
from arborspark.llm.common import least_hashed, texts_of
from arborspark.llm.ngrams import shape_ngrams, word_prefixes

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    return known, labels


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_held_out_accuracy(tables, what):
    docs, labels = tables
    rows = quality_nbsvm.score_quality(docs, labels) if what == "quality" else toxicity.score_toxicity(docs, labels)
    got = rows.join(labels, "doc_id").where("held_out").collect()
    fold, held = (5, 0) if what == "quality" else (4, 2)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % fold == held for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    up = [r["predicted"] for r in got if r[what] == 1]
    down = [r["predicted"] for r in got if r[what] == 0]
    assert np.mean(up) > 0.85 and np.mean(down) < 0.1


@pytest.mark.parametrize("score", [quality_nbsvm.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, docs, none, score):
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (None, 1, 1), (3, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(r["doc_id"] or -1 for r in docs.collect())
    assert all(r["score"] is not None for r in got)
    assert score(none, labels).count() == 0
    assert score(docs, labels.limit(0)).count() == docs.count()


def test_features_do_not_depend_on_place():
    a = set(np.concatenate([*word_prefixes("clown here", 20)]))
    b = set(np.concatenate([*word_prefixes("some words. " * 9000 + "clown here", 20)]))
    assert a <= b and not [*word_prefixes("", 20)]
    assert [*shape_ngrams("", 16)] == []


def test_descent_separates_and_calibration_orders():
    rows = [np.array([k % 2, 2 + k % 5]) for k in range(60)]
    model = quality_nbsvm.fit(rows, [k % 2 for k in range(60)])
    assert model.weights[1] > model.weights[0]


def test_non_negative_risk_finds_the_positives():
    r = np.random.default_rng(1)
    truth = r.random(600) < 0.2
    x = np.stack([truth, r.random(600) < 0.5], axis=1).astype(np.float32)
    w, b = toxicity.fit(x[truth], x, 0.2)
    assert w[0] + b > 0 > b


def test_ngrams_cross_cuts(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "B", "1", " ", "\n", "go ", "go ", "!", "é"]) for _ in range(r.randint(0, 120))) for _ in range(200)]
    whole = [set(np.concatenate([*shape_ngrams(t, 20)] or [[]])) for t in texts]
    for piece in (7, 16, 33):
        monkeypatch.setattr(ngrams, "_PIECE", piece)
        # A word is told whole, so cuts inside words longer than a piece are left out here.
        for t, want in zip(texts, whole, strict=True):
            if max(map(len, t.encode().split()), default=0) < piece:
                assert set(np.concatenate([*shape_ngrams(t, 20)] or [[]])) == want


def test_ratios_and_descent_equal_plain_sums():
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 12, 6)) for _ in range(40)]
    y = np.where(r.random(40) < 0.4, 1, -1)
    ratio = quality_nbsvm.log_count_ratio(rows, y)
    count = lambda side, f: 1 + sum(f in x for x, t in zip(rows, y, strict=True) if t == side)
    total = {s: sum(count(s, f) for f in range(1 << quality_nbsvm.BITS)) for s in (1, -1)} if quality_nbsvm.BITS < 8 else {s: (1 << quality_nbsvm.BITS) + sum(len(x) for x, t in zip(rows, y, strict=True) if t == s) for s in (1, -1)}
    for f in range(12):
        assert ratio[f] == pytest.approx(np.log(count(1, f) / total[1]) - np.log(count(-1, f) / total[-1]))
    w, b = quality_nbsvm.dual_descent(rows, y, ratio, 0.5, 3000, 1)
    share = {k: 40 / (2 * (y == k).sum()) for k in (1, -1)}
    dense = np.array([[ratio[f] if f in x else 0.0 for f in range(12)] for x in rows])

    def objective(v, c):
        slack = np.maximum(0, 1 - y * (dense @ v + c))
        return 0.5 * (v @ v + c * c) + 0.5 * sum(share[int(t)] * s for t, s in zip(y, slack, strict=True))

    at = objective(w[:12], b)
    for _ in range(300):
        assert objective(w[:12] + r.normal(0, 0.05, 12), b + r.normal(0, 0.05)) >= at - 1e-3


def test_scores_equal_plain_ones(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (7, 0, 0), (8, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    known = docs.select(docs["doc_id"].alias("id"), docs["text"])
    model = quality_nbsvm.train_model(known.na.fill(""), labels.selectExpr("doc_id as id", "quality as label"), train=F.lit(True))
    plain = lambda t: 1 / (1 + np.exp(-(model.slope * (sum(model.weights[f] for f in {int(i) for x in shape_ngrams(t, quality_nbsvm.BITS) for i in x}) + model.bias) + model.offset)))
    got = quality_nbsvm.score_quality(docs, labels, folds=1, held_fold=5).select("doc_id", "score").collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["score"] == pytest.approx(plain(text[r["doc_id"]]), abs=1e-5) for r in got)

    place = np.zeros(1 << toxicity.BITS, np.uint16)
    place[np.unique(np.concatenate([*word_prefixes("clown fool", toxicity.BITS)]))[: toxicity.FEATURES]] = np.arange(1, 1 + len(np.unique(np.concatenate([*word_prefixes("clown fool", toxicity.BITS)]))))
    weights = np.linspace(-1, 1, 3 * toxicity.FEATURES).astype(np.float32)
    tox = toxicity.Model(place, weights, -0.5)
    for t in ("", "clown", "a clown fool clown, fools clowns", "x " * 50_000 + "clown"):
        times = np.zeros(toxicity.FEATURES, int)
        for word in re.findall("[a-z\u0080-\U0010ffff]+", t.lower()):
            for x in word_prefixes(word, toxicity.BITS):
                for i in x:
                    if place[i]:
                        times[place[i] - 1] += 1
        total = -0.5 + sum(float(weights[k * toxicity.FEATURES + f]) for k, least in enumerate((1, 2, 4)) for f in range(toxicity.FEATURES) if times[f] >= least)
        assert tox.score(t) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)


def test_the_fit_lowers_the_non_negative_risk():
    r = np.random.default_rng(2)
    truth = r.random(500) < 0.3
    x = np.stack([truth, r.random(500) < 0.4, r.random(500) < 0.4], axis=1).astype(np.float32)

    def risk(w, b, prior=0.3):
        zp, zu = x[truth] @ w + b, x @ w + b
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    w, b = toxicity.fit(x[truth], x, 0.3)
    assert risk(w, b) < 0.5 * risk(np.zeros(3), np.log(0.3 / 0.7))
    features, decay = toxicity.settle({True: np.tile(x[truth], (1, toxicity.FEATURES)), False: np.tile(x, (1, toxicity.FEATURES))}, 0.3, ((4, 5e-4), (1, 5e-4)), 2, 0.3)
    assert (features, decay) in {(4, 5e-4), (1, 5e-4)}


def test_samples_are_bounded_and_few_rows_are_sorted(spark):
    rows = spark.range(20_000).selectExpr("id", "1 as label")
    got = [r["id"] for r in least_hashed(rows, 500).collect()]
    want = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(500).collect()]
    assert got == want
    hot = spark.range(3000).selectExpr("id % 4 as id", "cast(id as string) as text")
    sample = least_hashed(hot.select("id"), 100)
    assert sorted(r["id"] for r in sample.collect()) == [0, 1, 2, 3]
    assert texts_of(hot, sample.selectExpr("id", "1 as label"), "t").count() == 4
    assert least_hashed(rows.limit(0), 5).count() == 0


def test_toxic_rows_go_with_clashing_columns(spark, docs):
    df = docs.selectExpr("*", "'x' as toxicity_score", "'y' as `score`", "'z' as `a.b`")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    got = toxicity.drop_toxic(df, labels)
    assert got.columns == df.columns
    assert {(r["toxicity_score"], r["score"], r["a.b"]) for r in got.collect()} <= {("x", "y", "z")}
