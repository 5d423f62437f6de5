"""What a Python worker holds while it hashes texts, and the same hashes whatever the steps."""

import tracemalloc

import numpy as np


def test_hashing_takes_little_memory_and_hashes_alike_across_steps(monkeypatch):
    from loomfuse.llm import common

    monkeypatch.setattr(common, "_POW", {})
    h = np.random.default_rng(1).integers(0, 2**64, 1_200_000, dtype=np.uint64)
    data = np.random.default_rng(2).integers(97, 123, 1_200_000).astype(np.uint8)
    starts = np.arange(0, len(data), 6)
    ends = starts + 5
    tracemalloc.start()
    try:
        windows, words = common.hash_windows(h, 5), common.hash_spans(data, starts, ends)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < windows.nbytes + words.nbytes + (10 << 20)
    for at in (0, 131_000, 131_070, 262_140, 1_048_570, len(h) - 45):
        assert (windows[at : at + 41] == common.hash_windows(h[at : at + 45], 5)).all()
    for at in (0, 21_840, 43_690, 174_760, len(starts) - 41):
        part = slice(at, at + 41)
        assert (words[part] == common.hash_spans(data[starts[at] : ends[part][-1]], starts[part] - starts[at], ends[part] - starts[at])).all()
