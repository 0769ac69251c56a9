import random

import pytest

from trackloom.functions import similarity


@pytest.mark.parametrize("longest, n", [(3, 300), (10, 120), (40, 30)])
def test_block_compares_many_at_once(monkeypatch, longest, n):
    """The best texts come as from every pair, and no pair is compared alone unless both of its texts are long."""
    r = random.Random(longest)
    word = lambda: "".join(r.choices("abcdeé ж", k=r.choice((1, 2, 3, 5, 8))))
    text = lambda: " ".join(word() for _ in range(r.randint(0, longest)))
    texts, asked = sorted({text() for _ in range(n)}), [text() for _ in range(8)]
    want = [sorted((-similarity.weighted_ratio_number(q, t), t) for t in texts)[:20] for q in asked]
    block = similarity.WeightedBlock(texts)

    def alone(*_):
        raise AssertionError("compared alone")

    monkeypatch.setattr(similarity, "weighted_ratio_number", alone)
    if longest < 20:
        monkeypatch.setattr(similarity, "window_number", alone)
    assert [[(-s, texts[i]) for s, i in block.top(q, 20)] for q in asked] == want
