"""Co-training by hand: what each view hands to the other, calibration and blend."""

import numpy as np

from tessera.llm.linear import Logistic, folds, sigmoid
from tessera.llm.quality import CoTrained


def plain_logistic(x, y, l2):
    """Regularised logistic regression on standardised columns by plain gradient descent."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -35, 35)))
        step = (z.T @ (p - y) + l2 * w) / len(y), (p - y).mean()
        w, b = w - 2.0 * step[0], b - 2.0 * step[1]
        if max(np.abs(step[0]).max(), abs(step[1])) < 1e-10:
            break
    return lambda v: ((v - mean) / scale) @ w + b


def views(rng, n):
    y = (rng.random(n) < 0.4).astype(float)
    content = np.column_stack([y * 1.5 + rng.normal(size=n), rng.normal(size=n)])
    metadata = np.column_stack([y - rng.normal(size=n), rng.normal(size=n) + 0.3 * y])
    return [content, metadata], y


def test_logistic_equals_gradient_descent():
    rng = np.random.default_rng(1)
    (x, _), y = views(rng, 300)
    for l2 in (0.1, 1.0):
        assert np.allclose(Logistic(l2=l2).fit(x, y).logit(x), plain_logistic(x, y, l2)(x), atol=1e-5)


def test_one_round_of_co_training_by_hand():
    rng = np.random.default_rng(2)
    x, y = views(rng, 240)
    pool, _ = views(rng, 150)
    sure, most = 0.8, 20
    model = CoTrained(rounds=1, per_round=most, sure=sure).fit(x, y, pool)

    held = folds(len(y), 4) == 0
    own = [plain_logistic(x[v][~held], y[~held], 1.0) for v in (0, 1)]
    rows, labels = [x[v][~held] for v in (0, 1)], [y[~held]] * 2
    rate, handed = y[~held].mean(), []
    for v in (0, 1):
        p = sigmoid(own[v](pool[v]))
        good = [k for k in sorted(range(len(p)), key=lambda k: -p[k]) if p[k] >= sure][: max(1, round(most * rate))]
        bad = [k for k in sorted(range(len(p)), key=lambda k: p[k]) if p[k] <= 1 - sure][: max(1, round(most * (1 - rate)))]
        assert good and bad
        handed.append((good, bad))
    again = []
    for v in (0, 1):
        good, bad = handed[1 - v]  # labels come from the other view, rows are this view's
        grown = np.vstack([rows[v], pool[v][good], pool[v][bad]])
        again.append(plain_logistic(grown, np.concatenate([labels[v], np.ones(len(good)), np.zeros(len(bad))]), 1.0))
    platt = [plain_logistic(again[v](x[v][held])[:, None], y[held], 0.1) for v in (0, 1)]
    calibrated = lambda v, some: platt[v](again[v](some)[:, None])
    blend = plain_logistic(np.column_stack([calibrated(v, x[v][held]) for v in (0, 1)]), y[held], 0.1)
    new, _ = views(rng, 80)
    content, metadata, both = model.predict(*new)
    assert np.allclose(content, sigmoid(calibrated(0, new[0])), atol=1e-4)
    assert np.allclose(metadata, sigmoid(calibrated(1, new[1])), atol=1e-4)
    assert np.allclose(both, sigmoid(blend(np.column_stack([calibrated(v, new[v]) for v in (0, 1)]))), atol=1e-4)
