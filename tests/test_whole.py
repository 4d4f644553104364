"""Registered queries that do the whole job where a SQL twin stops short, against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

from arborspark.plans import evaluation, registry

SF = "/root/testdata/sf0.001"


def test_every_paragraph_is_followed(spark):
    rows = registry.QUERIES["search_barriers_all"](spark, SF).collect()
    nodes = registry.QUERIES["tree_nodes"](spark, SF).where("kind = 'paragraph'").collect()
    assert sorted((r["doc_id"], r["node_id"]) for r in rows) == sorted((r["doc_id"], r["node_id"]) for r in nodes)
    even = {tuple(r) for r in registry.QUERIES["search_barriers"](spark, SF).collect()}
    assert even == {tuple(r) for r in rows if int(r["node_id"][1:]) % 2 == 0} and len(even) < len(rows)
    targets, kept = Counter(), Counter()
    for r in rows:
        for depth in range(1, r["n_levels"] + 1):
            targets[r["doc_id"], depth] += 1
            kept[r["doc_id"], depth] += r["n_reached"] >= depth
    got = {(r["doc_id"], r["depth"]): (r["n_targets"], r["n_retained"]) for r in registry.QUERIES["evidence_by_depth_all"](spark, SF).collect()}
    assert got == {k: (n, kept[k]) for k, n in targets.items()}


def sums(df, keys, value):
    out = defaultdict(lambda: defaultdict(lambda: [0.0, 0]))
    for r in df.collect():
        at = out[tuple(r[k] for k in keys)][r["cluster"]]
        at[0] += r[value]
        at[1] += 1
    return out


def test_ten_thousand_draws(spark):
    draws = 10_000
    diffs, scores = sums(evaluation._diffs(spark, SF), ["dataset", "other"], "d"), sums(evaluation._scores(spark, SF), ["dataset", "method"], "score")
    digests = {c: [hashlib.sha256(f"7:{k}:{c}".encode()).hexdigest() for k in range(1, draws + 1)] for c in {c for by in scores.values() for c in by}}
    signs = {c: np.array([1 if d[0] < "8" else -1 for d in ds]) for c, ds in digests.items()}
    steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(13)])
    weights = {c: np.searchsorted(steps, np.array([int(d[:8], 16) for d in ds]) / 2**32, side="right") for c, ds in digests.items()}
    assert max(w.max() for w in weights.values()) > 3

    tested = {(r["dataset"], r["other"]): (r["mean"], r["p"]) for r in registry.QUERIES["sign_test_10k"](spark, SF).collect()}
    assert tested.keys() == diffs.keys()
    for key, by in diffs.items():
        total, n = sum(s for s, _ in by.values()), sum(n for _, n in by.values())
        moved = sum(signs[c] * s for c, (s, _) in by.items())
        p = (np.count_nonzero(abs(moved) >= abs(total) - 1e-9) + 1) / (draws + 1)
        assert np.allclose(tested[key], (total / n, p), rtol=0, atol=2e-6)

    order = sorted(tested, key=lambda k: (tested[k][1], k))
    want, least = {}, 0.0
    for place, key in enumerate(order):
        least = max(least, min(1.0, tested[key][1] * (len(order) - place)))
        want[key] = least
    got = {(r["dataset"], r["other"]): r["adjusted"] for r in registry.QUERIES["holm_10k"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)

    ends = {(r["dataset"], r["method"]): (r["mean"], r["low"], r["high"]) for r in registry.QUERIES["bootstrap_10k"](spark, SF).collect()}
    assert ends.keys() == scores.keys()
    for key, by in scores.items():
        means = sum(weights[c] * s for c, (s, _) in by.items()) / sum(weights[c] * n for c, (_, n) in by.items())
        mean = sum(s for s, _ in by.values()) / sum(n for _, n in by.values())
        assert np.allclose(ends[key], (mean, *np.quantile(means, [0.025, 0.975])), rtol=0, atol=2e-6)
