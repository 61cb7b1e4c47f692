"""What the findings of round 3 that were left over asked for."""

import numpy as np

from wrenfold.llm import lm


def _model(seed: int, scale: float) -> lm.Model:
    rng = np.random.default_rng(seed)
    model = lm.Model(100, 20, [(f"w{k}", 1) for k in range(20)], 20, 1, np.zeros((lm.BUCKETS, 2)))
    shapes = {"r": (model.classes, lm.WIDTH), "near": (lm.WIDTH, lm.WIDTH), "far": (lm.WIDTH, lm.WIDTH), "s": (model.classes, lm.WIDTH), "b": (model.classes,)}
    model.weights = {k: (scale * rng.normal(0, 0.3, x)).astype(np.float32) for k, x in shapes.items()}
    return model


def test_normalisers_take_no_exponentials_a_context(monkeypatch):
    """All contexts of 301 classes: two exponentials a pair of classes at most, not 301 a context."""
    model = _model(1, 1.0)
    n, taken, real = model.classes, [], np.exp
    far, near = (x.ravel() for x in np.divmod(np.arange(n * n), n))
    monkeypatch.setattr(lm.np, "exp", lambda x, **kw: (taken.append(np.size(x)), real(x, **kw))[1])
    model.ready()
    model.log_probabilities(far, near, near)
    assert sum(taken) <= 2 * n * n


def test_normalisers_of_weights_far_apart():
    """Against sums in double precision, also where the far and the near token agree on no class."""
    for scale in (0.5, 2.0, 6.0):
        model = _model(2, scale)
        w = {k: v.astype(np.float64) for k, v in model.weights.items()}
        n = model.classes
        far, near = (x.ravel() for x in np.divmod(np.arange(0, n * n, 7), n))
        target = (far + near) % n
        scores = (w["r"][near] @ w["near"] + w["r"][far] @ w["far"]) @ w["s"].T + w["b"]
        top = scores.max(axis=1)
        want = (scores[np.arange(len(far)), target] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))) / np.log(10)
        got = model.log_probabilities(far, near, target)
        assert np.abs(got - want).max() < 1e-5 * max(1.0, np.abs(want).max())
        if scale == 6.0:  # factors alone would be lost here
            logs = w["r"] @ w["far"] @ w["s"].T, w["r"] @ w["near"] @ w["s"].T + w["b"]
            parts = [x - x.max(axis=1, keepdims=True) for x in logs]
            assert ((parts[0][far] + parts[1][near]).max(axis=1) < np.log(lm.LEAST_SUM)).any()
