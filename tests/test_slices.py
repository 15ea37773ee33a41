"""Sentences of a text: slices of bounded size, and the greedy pass."""

import numpy as np
import pandas as pd

from quarry.operators import summaries as SM


def test_sentences_are_encoded_in_slices(spark, monkeypatch):
    """What is encoded at once is bounded by texts, not by the Arrow batch."""
    seen = []

    def watch(predict, texts, size):
        seen.append(len(texts))
        return np.ones((len(texts), 2))

    caught = {}

    class Frame:
        dtypes = [("k", "bigint")]

        def select(self, *cols):
            return self

        def mapInPandas(self, run, schema):
            caught["run"] = run

    monkeypatch.setattr(SM, "_encode_all", watch)
    SM._per_text(Frame(), "k", "t", None, lambda text, items, vecs: [(len(items),)], "n int")
    n = 3 * SM.SLICE_TEXTS
    out = pd.concat(caught["run"]([pd.DataFrame({"k": range(n), "_text": ["One. Two."] * n})]))
    assert out["n"].tolist() == [2] * n and max(seen) == 2 * SM.SLICE_TEXTS


def test_distinct_rows_equal_the_plain_pass():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3))
    x[5] = 0.0
    kept = []
    for i, v in enumerate(x):
        cos = [round(float(x[j] @ v / (np.linalg.norm(x[j]) * np.linalg.norm(v))) if x[j].any() and v.any() else 0.0, 9) for j in kept]
        if not any(c > 0.9 for c in cos):
            kept.append(i)
    assert SM.distinct_rows(x, 0.9) == kept
    assert SM.distinct_rows(np.zeros((0, 0)), 0.9) == []
