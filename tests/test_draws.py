"""Draws by digest against plain Python, on clusters and values out of the ordinary."""

import hashlib
from collections import defaultdict
from math import exp, factorial

import numpy as np
import pytest

from arborspark.operators import draws, metrics
from arborspark.plans import evaluation

CLUSTERS = [None, "", "a", "é日本", "x" * 60, "x" * 48, *map(str, range(310))]


def number(draw, cluster):
    return int(hashlib.sha256(":".join(["7", str(draw), *([] if cluster is None else [cluster])]).encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"g{k % 3}", c, None if k % 7 == 0 else (k * 37 % 101) / 50 - 1) for k, c in enumerate(CLUSTERS * 2)]
    data += [(f"one{c}", c, 1.0) for c in CLUSTERS[6:]] + [("none", "a", None), (None, "a", 1.0)]
    return spark.createDataFrame(data, "g string, c string, v double"), data


def sums(data):
    out = defaultdict(lambda: defaultdict(lambda: [0.0, 0]))
    for g, c, v in data:
        if g is not None:
            out[g][c][0] += v or 0.0
            out[g][c][1] += 1
    return out


def test_numbers_are_the_digests_first_bits():
    heads = [f"7:{k}".encode() for k in range(1, 1200)]
    for tail in ("", ":1", ":" + "é" * 25, ":" + "y" * 49, ":" + "y" * 80):
        (_, got), = draws.numbers(heads, [tail.encode()])
        assert got[0].tolist() == [int.from_bytes(hashlib.sha256(h + tail.encode()).digest()[:4], "big") for h in heads]


def test_signs(rows):
    df, data = rows
    got = metrics.sign_test(df, ["g"], "c", "v", draws=30)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString(), "a cluster is not copied for each draw"
    got, want = {r["g"]: (r["mean"], r["p"]) for r in got.collect()}, sums(data)
    assert got.keys() == want.keys() and got["none"][0] is None and len(want) > draws.HELD
    for g, by in want.items():
        total, n = sum(s for s, _ in by.values()), sum(n for _, n in by.values())
        reached = sum(abs(sum(s * (1 if number(d, c) < 1 << 31 else -1) for c, (s, _) in by.items())) >= abs(total) - 1e-9 for d in range(1, 31))
        if g != "none":
            assert got[g] == pytest.approx((total / n, (reached + 1) / 31), abs=1e-6)


def test_bootstrap_weights(rows):
    df, data = rows
    got = metrics.bootstrap(df, ["g"], "c", "v", draws=30, steps=metrics.POISSON)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString(), "a cluster is not copied for each draw"
    got, want = {r["g"]: (r["mean"], r["low"], r["high"]) for r in got.collect()}, sums(data)
    assert got.keys() == want.keys() and got["none"] == (None, None, None)
    steps = np.cumsum([exp(-1) / factorial(k) for k in range(13)])
    for g, by in want.items():
        means = []
        for d in range(1, 31):
            w = {c: np.searchsorted(steps, number(d, c) / 2**32, side="right") for c in by}
            n = sum(w[c] * n for c, (_, n) in by.items())
            means += [sum(w[c] * s for c, (s, _) in by.items()) / n] if n else []
        if g != "none":
            mean = sum(s for s, _ in by.values()) / sum(n for _, n in by.values())
            assert got[g] == pytest.approx((mean, *np.quantile(means, [0.025, 0.975])), abs=1e-6)


def test_holm_takes_the_summed_draws(spark):
    plan = evaluation.holm_10k(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan, "a cluster is not copied for each draw"


def test_signs_are_bits_of_the_compiled_digest(spark):
    plan = evaluation.holm_10k(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan and "__bits" in plan, "no digest is made in Python"


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_signs_in_blocks_over_batches(rows, spark, batch):
    df, data = rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        parts = draws.signed(df, ["g"], "c", "v", draws=35, seed=7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, counted, want = defaultdict(lambda: np.zeros(36)), defaultdict(float), sums(data)
    for r in parts:
        got[r["g"]] += np.frombuffer(r["s"])
        counted[r["g"]] += np.frombuffer(r["n"])[0]
    assert got.keys() == want.keys() and len({(r["g"], r["part"]) for r in parts}) == len(parts)
    for g, by in want.items():
        assert counted[g] == sum(n for _, n in by.values())
        moved = [sum(s * (1 if number(d, c) < 1 << 31 else -1) for c, (s, _) in by.items()) for d in range(1, 36)]
        assert np.allclose(got[g], [sum(s for s, _ in by.values()), *moved], rtol=0, atol=1e-9)


def test_a_cluster_of_more_groups_than_a_task_holds(spark):
    df = spark.createDataFrame([(k, c, k + 0.5) for k in range(draws.HELD + 50) for c in ("a", "b")], "g int, c string, v double")
    got = {r["g"]: (r["mean"], r["p"]) for r in metrics.sign_test(df, ["g"], "c", "v", draws=20).collect()}
    same = sum((number(d, "a") < 1 << 31) == (number(d, "b") < 1 << 31) for d in range(1, 21))
    assert got == {k: (k + 0.5, round((same + 1) / 21, 6)) for k in range(draws.HELD + 50)}
