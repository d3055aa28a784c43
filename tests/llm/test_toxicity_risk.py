"""The classifiers' training against a risk written out document by document, with numeric gradients."""

import math

import numpy as np
import pytest

from corpusloom.llm import toxicity


def plain_losses(w, b, rows, positive, drawn, prior):
    """What the classifier risks on positives as positives, and on supposed negatives as negatives."""
    p = sum(positive)
    on_positive = on_negative = 0.0
    for features, is_positive, weight in zip(rows, positive, drawn):
        z = b + sum(w[i] for i in features)
        as_positive, as_negative = math.log1p(math.exp(-z)), math.log1p(math.exp(z))
        if is_positive:
            on_positive += as_positive / p
            on_negative -= prior * as_negative / p
        else:
            on_negative += weight * as_negative
    return prior * on_positive, on_negative


def plain_training(rows, positive, log_odds, prior, seed, steps):
    rng = np.random.default_rng(seed)
    unlabelled = [i for i, p in enumerate(positive) if not p]
    noise = rng.exponential(size=len(unlabelled))
    drawn = np.zeros(len(rows))
    drawn[unlabelled] = 1 + toxicity.BAG * (noise - 1)
    drawn[unlabelled] /= drawn[unlabelled].sum()
    x = np.append(toxicity.START * log_odds, math.log(prior / (1 - prior)))
    mean, power = np.zeros_like(x), np.zeros_like(x)

    def objective(x, negative):
        on_positive, on_negative = plain_losses(x[:-1], x[-1], rows, positive, drawn, prior)
        return (on_positive + on_negative if not negative else -toxicity.DISCOUNT * on_negative)

    for step in range(1, steps + 1):
        _, risk = plain_losses(x[:-1], x[-1], rows, positive, drawn, prior)
        back = risk < -toxicity.TOLERANCE * prior
        grad, h = np.zeros_like(x), 1e-6
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += h
            down[i] -= h
            grad[i] = (objective(up, back) - objective(down, back)) / (2 * h)
        grad[:-1] += toxicity.PENALTY * x[:-1]
        mean, power = 0.9 * mean + 0.1 * grad, 0.999 * power + 0.001 * grad * grad
        x = x - toxicity.RATE * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
    return x


@pytest.mark.parametrize("seed, prior, tolerance", [(0, 0.2, 1.0), (1, 0.05, 1.0), (2, 0.4, -2.0)])
def test_training_descends_the_plain_risk(monkeypatch, seed, prior, tolerance):
    monkeypatch.setattr(toxicity, "STEPS", 12)
    monkeypatch.setattr(toxicity, "TOLERANCE", tolerance)  # below -1: every step is one that goes back
    rng = np.random.default_rng(seed + 10)
    positive = np.array([True] * 8 + [False] * 20)
    chance = np.where(positive[:, None], [0.7, 0.5, 0.1, 0.3], [0.1, 0.4, 0.5, 0.3])
    rows = [np.flatnonzero(r).astype(np.int32) for r in rng.random((28, 4)) < chance]
    log_odds = np.array([2.0, 0.5, -1.0, 0.1])
    assert all(np.bincount(np.concatenate(rows), minlength=4) > 0)  # else a weight is set at the end
    weights, bias = toxicity.train(rows, positive, log_odds, prior, seed)
    want = plain_training([r.tolist() for r in rows], positive.tolist(), log_odds, prior, seed, 12)
    assert np.append(weights, bias) == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_features_no_row_holds_keep_their_part():
    rows = [np.array([0], np.int32), np.array([0, 1], np.int32), np.array([], np.int32), np.array([1], np.int32)]
    odds = np.array([3.0, 1.0, 2.0])
    weights, _ = toxicity.train(rows, np.array([True, True, False, False]), odds, 0.3, 0)
    part = (weights[:2] @ odds[:2]) / (odds[:2] @ odds[:2])
    assert weights[2] == pytest.approx(part * 2.0)


def test_features_and_log_odds_by_hand(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 60)
    monkeypatch.setattr(toxicity, "FEATURES", 5)
    rng = np.random.default_rng(4)
    n_p, n, prior = 200, 5000, 0.06
    of_positives = rng.integers(0, 80, 60).astype(float)
    of_rows = of_positives + rng.integers(0, 600, 60)
    of_rows[:3] = of_positives[:3] = 2.0
    counts = toxicity._Counts(n_p, n, of_positives, of_rows)
    judged = []
    for b in range(60):
        p, u = of_positives[b] / n_p, of_rows[b] / n
        pooled = (of_positives[b] + of_rows[b]) / (n_p + n)
        z = abs(p - u) / math.sqrt(max(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n))
        if of_rows[b] >= toxicity.LEAST_DOCUMENTS and prior * p >= toxicity.LEAST_PURITY * u and z >= toxicity.LEAST_Z:
            judged.append((-z, b))
    want = sorted(b for _, b in sorted(judged)[:5])
    got = toxicity._choose(counts, prior)
    assert got.tolist() == want and want
    for b, odds in zip(want, toxicity._log_odds(counts, got, prior)):
        p, u = of_positives[b] / n_p, of_rows[b] / n
        assert odds == pytest.approx(math.log((p + 1 / n_p) / (max(u - prior * p, 0) / (1 - prior) + 1 / n_p)))
