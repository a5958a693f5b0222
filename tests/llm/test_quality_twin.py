"""The classifier's parts against plain twins: features, ratios, the dual optimum."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import quality as Q


def texts(n, seed):
    r = random.Random(seed)
    good, bad = ["the", "river", "ran", "slowly", "past", "Town,", "and", "we", "sat."], ["BUY", "now!!!", "click", "$$$", "free", "the", "click", "win"]
    return [(" ".join(r.choice(good if i % 2 or r.random() < 0.15 else bad) for _ in range(r.randrange(1, 14))), i % 2) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    made = texts(60, 3)
    return list(Q.features(pa.array([t for t, _ in made]))), np.array([y for _, y in made])


def test_features_are_those_of_each_text_alone():
    made = [t for t, _ in texts(40, 4)] + ["", "a", "ab", "abc", "é", "one\ntwo  THREE 4"]
    together = list(Q.features(pa.array([*made, None])))
    for t, found in zip(made, together):
        alone = next(Q.features(pa.array([t])))
        assert found.tolist() == alone.tolist() == sorted(set(alone.tolist()))
    assert together[-1].tolist() == together[made.index("")].tolist() == []
    # Trigrams of bytes: as many distinct as there are, but for two that share one of 65,536 slots.
    text = "one\ntwo  THREE 4".encode()
    trigrams = {text[i : i + 3] for i in range(len(text) - 2)}
    assert len([x for x in together[made.index("one\ntwo  THREE 4")] if x < 1 << Q.BITS]) in (len(trigrams), len(trigrams) - 1)


def test_ratios_by_counting(rows):
    found, good = rows
    got = Q.log_count_ratios(found, good)
    docs = [set(x.tolist()) for x in found]
    held = lambda f, y: sum(f in d for d, label in zip(docs, good) if label == y)
    total = {y: sum(len(d) for d, label in zip(docs, good) if label == y) + Q.SIZE for y in (0, 1)}
    for f in random.Random(5).sample(sorted(set().union(*docs)), 80) + [0, Q.SIZE - 1]:
        want = math.log((held(f, 1) + 1) / total[1]) - math.log((held(f, 0) + 1) / total[0])
        assert math.isclose(got[f], want, abs_tol=1e-12)


def projected_gradient(x, y, cost, rounds=60_000):
    """max sum(a) - |sum(a y x)|^2 / 2 over the box, by small steps along the gradient."""
    kernel = (x @ x.T) * np.outer(y, y)
    a, step = np.zeros(len(y)), 1 / np.linalg.norm(kernel, 2)
    for _ in range(rounds):
        a = np.clip(a + step * (1 - kernel @ a), 0, cost)
    return a, a.sum() - a @ kernel @ a / 2


def test_dual_optimum_by_projected_gradient(rows):
    found, good = rows
    values = Q.log_count_ratios(found, good)
    y = 2.0 * good - 1
    cost = np.where(good == 1, 0.02, 0.03)
    w, bias = Q.dual_descent(found, values, y, cost, epochs=3000)
    x = np.zeros((len(found), Q.SIZE + 1))
    for i, f in enumerate(found):
        x[i, f] = values[f]
    x[:, -1] = 1.0
    a, best = projected_gradient(x, y, cost)
    whole = np.r_[w, bias]
    # Strong duality: the primal value of the descent's weights is the optimum of the dual.
    primal = whole @ whole / 2 + (cost * np.maximum(0, 1 - y * (x @ whole))).sum()
    assert 0 < best <= primal <= best * 1.01
    assert np.allclose(x @ whole, x @ (x.T @ (a * y)), atol=0.05)


def test_fit_scales_weights_by_ratios(rows):
    found, good = rows
    model = Q.fit(found, good, blend=0.25)
    aside = np.arange(len(good)) % 4 == 3
    train = [f for f, s in zip(found, aside) if not s]
    own = good[~aside]
    values = Q.log_count_ratios(train, own)
    weight = np.where(own == 1, len(own) / (2 * own.sum()), len(own) / (2 * (len(own) - own.sum())))
    w, bias = Q.dual_descent(train, values, 2.0 * own - 1, weight)
    want = (0.25 * w + 0.75 * np.abs(w).mean()) * values
    assert np.allclose(model.weights, want) and model.bias == bias
    # A logistic curve through the margins of the rows kept for it: at least as good as every neighbour.
    margin = np.array([want[f].sum() + bias for f in found])[aside]
    n1, n0 = good[aside].sum(), (1 - good[aside]).sum()
    target = np.where(good[aside] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(slope, shift):
        p = 1 / (1 + np.exp(-(margin * slope + shift)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum() + 5e-4 * (slope**2 + shift**2)

    here = loss(model.slope, model.shift)
    assert all(here <= loss(model.slope + d, model.shift + e) + 1e-6 for d in (-0.05, 0, 0.05) for e in (-0.05, 0, 0.05) if model.slope + d >= 1e-3)
    score = model.score(found[0])
    assert math.isclose(score, 1 / (1 + math.exp(-((want[found[0]].sum() + bias) * model.slope + model.shift))), rel_tol=1e-9)
