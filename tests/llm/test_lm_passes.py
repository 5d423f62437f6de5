"""The attention of op5: what a place before the text does, and one sort of the tokens a batch."""

import numpy as np


def test_gradients_sort_tokens_once_and_agree_with_differences(monkeypatch):
    from loomfuse.llm import lm_score

    r = np.random.default_rng(4)
    vocab = lm_score.Vocabulary(r.integers(1, 50, 40).astype(float), 20)
    model = lm_score.Attention(vocab).ready()
    x = r.integers(1, vocab.size, (3, 9)).astype(np.int32)
    words = r.integers(0, 6, (3, 9))
    x[:2, 0], words[:2, 0] = 0, -1  # two windows begin their text
    often, rest = r.random((3, 8)).astype(np.float32) / 9, -r.random((3, 8)).astype(np.float32)
    calls, scatter = [], lm_score.scatter
    monkeypatch.setattr(lm_score, "scatter", lambda *a: calls.append(a) or scatter(*a))
    mask = np.ones((3, 8), bool)
    _, d = model.gradients(x, 0, words, often, rest, mask)
    assert len(calls) == 3
    kept = model.forward(x, 0, words, often, rest, True)[0]
    assert np.allclose(model.forward(x, 0, words, often, rest), kept, atol=1e-5)
    for name in lm_score.Attention.NAMES:
        at = np.unravel_index(np.abs(d[name]).argmax(), d[name].shape)
        table, losses = getattr(model, name), []
        for step in (0.01, -0.02):
            table[at] += np.float32(step)
            losses.append(-float(model.ready().forward(x, 0, words, often, rest).mean()))
        table[at] += np.float32(0.01)
        assert abs((losses[0] - losses[1]) / 0.02 - d[name][at]) < 2e-3 + 0.05 * abs(d[name][at]), name
