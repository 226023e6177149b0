"""What a Python worker holds while and after it works for a stage."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from seriesloom.llm import language, tokens
from seriesloom.llm.text import slices


def test_an_encoder_goes_with_its_vocabulary():
    class Shared:
        value = tokens.Vocabulary({bytes([i]): i for i in range(256)}, r"\w+|\s")

    shared = Shared()
    held = weakref.ref(tokens._encoder(shared))
    assert tokens._encoder(shared) is held() and tokens._encoder(shared)("ab") == np.array([97, 98], "<u4").tobytes()
    del shared
    gc.collect()
    assert held() is None


def test_language_scores_hold_little_besides_the_words(monkeypatch):
    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(50), (language.TABLE, 3)))[:, :, 0].astype(np.float32)
    model = language.Model(["a", "b", "c"], table, np.ones((len(language.SCRIPTS), 3), bool))
    words = np.array(["one", "zwei", "три", "x"], object)
    texts = [" ".join(words[rng.integers(0, 4, n)]) for n in (9, 0, 60_000, 0, 1, 300_000, 0)]
    [(_, _, data, offsets)] = slices(pa.array(texts), language.TOGETHER)
    tracemalloc.start()
    got = language._scores(data, offsets, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[1].tolist() == np.cumsum([0, 9, 0, 60_000, 0, 1, 300_000, 0]).tolist()
    monkeypatch.setattr(language, "SLICE", 1 << 30)  # all texts in one run
    tracemalloc.start()
    want = language._scores(data, offsets, model)
    whole = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[0], want[0], atol=1e-4) and all(np.array_equal(a, b) for a, b in zip(got[1:], want[1:]))
    monkeypatch.setattr(language, "SLICE", 1 << 14)
    short = [t[:1000] for t in texts] * 700
    [(_, _, data, offsets)] = slices(pa.array(short), language.TOGETHER)
    tracemalloc.start()
    language._scores(data, offsets, model)
    assert tracemalloc.get_traced_memory()[1] < whole
    tracemalloc.stop()
    assert peak <= whole
