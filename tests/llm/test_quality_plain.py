"""The non-negative positive-unlabelled risk against a plain version: its slopes, and the least value over all rows."""

import math

import numpy as np
import pytest

from assayspark.llm import quality


def softplus(z):
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def plain_risk(outputs, marked, prior):
    """Row by row: the positives' loss, and what the unlabelled have beyond the positives among them, which can't be negative."""
    pos = [z for z, m in zip(outputs, marked, strict=True) if m]
    unl = [z for z, m in zip(outputs, marked, strict=True) if not m]
    as_positive = sum(softplus(-z) for z in pos) / len(pos)
    rest = sum(softplus(z) for z in unl) / len(unl) - prior * sum(softplus(z) for z in pos) / len(pos)
    return prior * as_positive + max(0.0, rest), rest


def test_slopes_are_those_of_the_plain_risk():
    rng = np.random.default_rng(4)
    net, prior = quality.Net(5, 4, rng), 0.4
    x, marked = rng.normal(size=(30, 5)), rng.random(30) < 0.4
    h, z = net.raw(x)
    risk, rest = plain_risk(z, marked, prior)
    assert rest > 0
    s = 1 / (1 + np.exp(-z))
    g = np.where(marked, -prior * s / marked.sum() - prior * (1 - s) / marked.sum(), s / (~marked).sum())
    for part, slope in zip(net.parts(), net.slopes(x, h, g), strict=True):
        for at in np.ndindex(part.shape):
            was = part[at]
            part[at] = was + 1e-6
            above = plain_risk(net.raw(x)[1], marked, prior)[0]
            part[at] = was - 1e-6
            below = plain_risk(net.raw(x)[1], marked, prior)[0]
            part[at] = was
            assert abs((above - below) / 2e-6 - slope[at]) < 1e-4


@pytest.mark.parametrize("prior", [0.3, 0.5])
def test_output_layer_reaches_the_least_plain_risk(spark, prior):
    rng = np.random.default_rng(6)
    n, decay = 240, 1e-2
    x = np.zeros((n, quality.N_FEATURES), dtype=np.float32)
    good = rng.random(n) < 0.5
    x[:, :4] = rng.normal(size=(n, 4)) + np.where(good, 0.8, -0.8)[:, None]
    marked = good & (rng.random(n) < 0.6)
    rows = [(int(k), False, 1 if marked[k] else None, bytearray(x[k].tobytes())) for k in range(n)]
    feats = spark.createDataFrame(rows, "doc_id long, held_out boolean, good int, x binary").repartition(3)
    model = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), quality.Net(quality.N_FEATURES, 3, np.random.default_rng(1)), prior)
    h = np.c_[model.net.raw(model.scaled(x.astype(np.float64)))[0], np.ones(n)]
    quality.fit_output(feats, model, prior, steps=30, decay=decay)
    found = np.r_[model.net.c, model.net.d]
    value = lambda w: plain_risk(h @ w, marked, prior)[0] + decay / 2 * float(w @ w)
    # Plain descent by differences from several starts, with no use of the operator's sums.
    best = math.inf
    for seed in range(3):
        w = np.random.default_rng(seed).normal(size=4)
        rate = 0.5
        for _ in range(400):
            slope = np.array([(value(w + d) - value(w - d)) / 2e-5 for d in np.eye(4) * 1e-5])
            while rate > 1e-9 and value(w - rate * slope) > value(w):
                rate /= 2
            w, rate = w - rate * slope, min(rate * 1.5, 5.0)
        best = min(best, value(w))
    assert value(found) <= best + 5e-3
    assert plain_risk(h @ found, marked, prior)[1] >= -1e-9
