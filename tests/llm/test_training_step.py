"""A training step: exact slopes, the same for large logits, and no memory cleared anew at every step."""

import subprocess
import sys

import numpy as np
import pytest

from paircall.llm import attention

STEPS = """
import resource
import numpy as np
from paircall.llm import attention
attention.keep_memory()
vocabulary = attention.Vocabulary(np.arange(3000.0))
learn = attention.Adam(attention.Model.fresh(vocabulary), 5e-4)
inputs, targets, starts, _ = attention.blocks([np.arange(4097, dtype=np.int32) % attention.LEAVES])
for step in range(12):
    if step == 2:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    learn(inputs, targets, starts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) // 10)
"""


def some_blocks():
    draw = np.random.default_rng(4)
    return attention.blocks([draw.integers(0, attention.LEAVES, n).astype(np.int32) for n in (5, 1, 40, 17, 2, 300)])[:3]


def fresh(scale):
    vocabulary = attention.Vocabulary(np.random.default_rng(0).integers(0, 50, 3000).astype(float))
    return attention.Model(attention.Model.fresh(vocabulary).vector.astype(np.float64) * scale)


def test_steps_reuse_memory():
    done = subprocess.run([sys.executable, "-c", STEPS], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(filter(None, sys.path))})
    assert int(done.stdout) < 200  # some 3000 pages a step without


def test_sums_by_leaf_are_exact():
    draw = np.random.default_rng(1)
    at, rows = draw.integers(0, attention.LEAVES, 500), draw.normal(size=(500, 7))
    expected = np.zeros((attention.LEAVES, 7))
    np.add.at(expected, at, rows)
    assert np.allclose(attention._summed(at, rows), expected, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("scale", [1, 4])  # 4: logits beyond LIMIT
def test_slopes_of_large_logits(scale):
    model, parts = fresh(scale), some_blocks()
    loss, slope = model.slopes(*parts)
    assert np.isfinite(loss) and np.isfinite(slope).all()
    for name in ("pair", "cluster0", "member", "member0", "cluster"):
        weights, slopes = model.parts[name], attention.Model(slope).parts[name]
        at = np.unravel_index(np.abs(slopes).argmax(), slopes.shape)
        was = weights[at]
        weights[at] = was + 1e-5
        up = model.slopes(*parts)[0]
        weights[at] = was - 1e-5
        down = model.slopes(*parts)[0]
        weights[at] = was
        assert (up - down) / 2e-5 == pytest.approx(slopes[at], rel=1e-3, abs=1e-9)


def test_loss_is_that_of_the_scores():
    model, parts = fresh(1), some_blocks()
    scores = attention.Model(model.vector.astype(np.float32)).scores(*parts)
    assert model.slopes(*parts)[0] == pytest.approx(-scores.sum() / (parts[1] >= 0).sum(), rel=1e-4)
