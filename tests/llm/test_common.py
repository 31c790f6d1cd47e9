"""Common shingles are counted over all texts, copies in a task once."""

from collections import Counter

import numpy as np

from harborlight.llm import ngram_join


def test_every_text_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "DRAWN", 10, raising=False)
    texts = [f"often met words here {i} w{i % 50} x{i % 50} y{i % 50}" for i in range(400)] + ["a b c d"] * 9 + [None, ""]
    n = Counter(int(x) for t in set(texts) for x in ngram_join.shingles((t or "").encode()))
    want = sorted(x >> 24 << 24 for x, k in n.items() if k >= 4)
    got = ngram_join.common_shingles(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), 3, len(texts))
    assert len(want) > 50 and sorted(int(x) >> 24 << 24 for x in got) == want


def test_packed_and_unpacked():
    rng = np.random.default_rng(1)
    value = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    other = rng.integers(0, 9, 5000).astype(np.uint32)
    back = [ngram_join._unpacked(blob, n, np.uint32, 16) for (b, blob) in ngram_join._packed(value, other, 64, 16) for n in [int((value >> np.uint64(58) == b).sum())]]
    assert (np.concatenate([v for v, _ in back]) == value >> np.uint64(16) << np.uint64(16)).all() and (np.concatenate([o for _, o in back]) == other).all()
    assert list(ngram_join._packed(value[:0], other[:0], 64, 16)) == []
