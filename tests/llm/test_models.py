"""Learning and inference of the models against plain loops and enumeration."""

import itertools
import math
import random

import numpy as np

from siltstone.llm import language_id, line_quality


def test_follow_the_regularised_leader_step_by_step():
    r = random.Random(3)
    samples = [(np.array(sorted(r.sample(range(12), 3))), np.array([r.random() for _ in range(3)]), r.randrange(3)) for _ in range(25)]
    weights, bias = language_id.train_ftrl(samples, 3, epochs=2, alpha=0.3, beta=1.0, l1=0.02, l2=0.02)
    z, n = {}, {}

    def weight(b, c):
        zz, nn = z.get((b, c), 0.0), n.get((b, c), 0.0)
        if abs(zz) <= 0.02:
            return 0.0
        return -(zz - math.copysign(0.02, zz)) / ((1.0 + math.sqrt(nn)) / 0.3 + 0.02)

    order = np.random.RandomState(3)
    for _ in range(2):
        for i in order.permutation(len(samples)):
            buckets, values, label = samples[i]
            x = [*zip(buckets.tolist(), values.tolist()), (language_id.BUCKETS, 1.0)]
            w = {(b, c): weight(b, c) for b, _ in x for c in range(3)}
            logits = [sum(w[b, c] * v for b, v in x) for c in range(3)]
            total = sum(map(math.exp, logits))
            for c in range(3):
                error = math.exp(logits[c]) / total - (c == label)
                for b, v in x:
                    g = error * v
                    before = n.get((b, c), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / 0.3
                    z[b, c] = z.get((b, c), 0.0) + g - sigma * w[b, c]
                    n[b, c] = before + g * g
    for b in range(12):
        assert np.allclose(weights[b], [weight(b, c) for c in range(3)], atol=1e-12)
    assert np.allclose(bias, [weight(language_id.BUCKETS, c) for c in range(3)], atol=1e-12)
    assert np.count_nonzero(weights) <= 36  # the first penalty keeps all other weights at 0


def test_marginals_by_enumeration():
    r = np.random.RandomState(5)
    lengths = np.array([6, 1, 4, 3])
    unary = np.where(np.arange(6)[None, :] < lengths[:, None], r.normal(size=(4, 6)) * 2, 0)
    a = r.normal(size=(2, 2))
    odds, *_ = line_quality.marginals(unary, lengths, a)
    for i, n in enumerate(lengths):
        mass = np.zeros((n, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            score = sum(unary[i, t] * y for t, y in enumerate(labels)) + sum(a[x, y] for x, y in zip(labels, labels[1:]))
            for t, y in enumerate(labels):
                mass[t, y] += math.exp(score)
        assert np.allclose(odds[i, :n], np.log(mass[:, 1] / mass[:, 0]), atol=1e-9)
