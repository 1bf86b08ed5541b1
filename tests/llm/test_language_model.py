"""What a language model costs a Python worker."""

import pickle
import random
import tracemalloc

from tallyspark.llm import language_id as g


def test_a_model_is_small():
    """200,000 words of two languages: dictionaries of them took over 100 bytes a word."""
    rng = random.Random(2)
    words = sorted({f"{rng.getrandbits(60):x}" for _ in range(200_000)})
    rows = [(lang, 0, w, 1 + k % 3, 300_000) for k, w in enumerate(words) for lang in ("a", "b")[k % 2 :][:1]]
    sent = pickle.dumps(g.Model(rows))
    tracemalloc.start()
    model = pickle.loads(sent)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 40 * len(words)
    assert model.predict(" ".join(words[0:40:2]))[0] in ("a", "b")
