"""The attention of op5 without a row's largest score, its copies by pairs, and arithmetic without subnormal numbers."""

import numpy as np
import pytest


def plain(model, x, first, words, often, rest):
    """Log chances by loops in double precision."""
    from loomfuse.llm import lm_score as L

    out = np.zeros((len(x), x.shape[1] - 1 - first))
    for w in range(len(x)):
        for i in range(first, x.shape[1] - 1):
            score = [model.q[x[w, i]].astype(float) @ (model.k[x[w, j]] + model.k2[x[w, j - 1] if j else 0]) / L.KEY**0.5 + model.near[min(i - j, L.WIDE - 1)] for j in range(i + 1)]
            a = np.exp(score - np.max(score))
            a /= a.sum()
            g = a @ model.v[x[w, : i + 1]] @ model.out + model.gate[x[w, i]] + model.bias
            g = np.exp(g - g.max())
            g /= g.sum()
            copy = a @ (words[w, : i + 1] == words[w, i + 1]) + (a[0] * often[w, i - first] if words[w, 0] < 0 else 0.0)
            out[w, i - first] = np.log(g[:-2] @ model.p[x[w, i + 1]] * np.exp(float(rest[w, i - first])) + g[-2] * often[w, i - first] + g[-1] * copy)
    return out


@pytest.mark.parametrize("far", [1, 60])
def test_scores_with_and_without_the_largest_agree_with_loops(far):
    from loomfuse.llm import lm_score as L

    r = np.random.default_rng(5)
    model = L.Attention(L.Vocabulary(r.integers(1, 50, 40).astype(float), 20))
    model.q *= far  # at 60 scores leave float32's range, and gates as well
    model.out *= far
    model.ready()
    x, words = r.integers(1, 20, (4, 13)).astype(np.int32), r.integers(0, 5, (4, 13)).astype(np.int32)
    x[:2, 0], words[:2, 0] = 0, -1
    for first in (0, 6):
        often, rest = r.random((4, 12 - first)).astype(np.float32) / 9, -r.random((4, 12 - first)).astype(np.float32)
        assert np.allclose(model.forward(x, first, words, often, rest), plain(model, x, first, words, often, rest), atol=2e-4)


def test_gradients_of_parts_add_up_to_those_of_the_whole():
    from loomfuse.llm import lm_score as L

    r = np.random.default_rng(6)
    model = L.Attention(L.Vocabulary(r.integers(1, 50, 40).astype(float), 20)).ready()
    x, words, mask = r.integers(1, 20, (6, 9)).astype(np.int32), r.integers(0, 5, (6, 9)).astype(np.int32), r.random((6, 8)) < 0.7
    often, rest = r.random((6, 8)).astype(np.float32) / 9, -r.random((6, 8)).astype(np.float32)
    loss, whole = model.gradients(x, 0, words, often, rest, mask)
    some = [model.gradients(x[s], 0, words[s], often[s], rest[s], mask[s], float(mask.sum())) for s in (slice(0, 1), slice(1, 6))]
    assert abs(sum(p[0] for p in some) - loss) < 1e-5
    assert all(np.allclose(sum(p[1][k] for p in some), whole[k], atol=1e-6) for k in model.NAMES)


def test_subnormals_are_zero_within_and_come_back():
    import platform

    from loomfuse.llm.common import no_subnormals

    small = np.full(64, 1e-30, np.float32)
    product = lambda: float((small * np.float32(1e-10)).max())
    assert product() > 0
    with no_subnormals():
        assert platform.machine() != "x86_64" or platform.libc_ver()[0] != "glibc" or product() == 0
        assert float((small * np.float32(1e-7)).max()) > 0  # normal numbers stay
    assert product() > 0
    with pytest.raises(ValueError), no_subnormals():
        raise ValueError
    assert product() > 0


def test_portions_take_every_document_once():
    from loomfuse.llm import lm_score as L

    for sizes in ([0], [5], [0, 0, 900, 3, 3, 3, 40, 0], [1000, 1000], list(range(60))):
        got = L.portions(np.array(sizes), 100)
        assert np.concatenate(got).tolist() == list(range(len(sizes))) and all(len(g) for g in got)
        assert all(sum(sizes[i] + 1 for i in g[1:]) <= 100 for g in got)  # all but a long first one
