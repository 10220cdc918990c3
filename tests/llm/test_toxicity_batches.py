"""Marginals of many texts at once against a step-by-step pass over each."""

import numpy as np
import pytest

from verseloom.llm import toxicity


def _plain(model, words):
    """Forward-backward, a word at a time."""
    extra = [model.memo[w] + model.beside[x].real + model.beside[y].imag for x, w, y in zip(["", *words], words, [*words[1:], ""])]
    ahead, back, a, b = [], [], np.array([1.0, 0.0]), np.ones(2)
    for x in extra:
        a = a @ model.base * [1, np.exp(x)]
        a = a / a.sum()
        ahead.append(a)
    for x in extra[::-1]:
        back.append(b)
        b = model.base @ (b * [1, np.exp(x)])
        b = b / b.sum()
    both = np.array(ahead) * np.array(back[::-1])
    at = [k for k, x in enumerate(extra) if x]
    return at, (both[:, 1] / both.sum(1))[at] if at else []


@pytest.mark.parametrize("seed", range(4))
def test_texts_together_equal_each_alone(seed):
    rng = np.random.default_rng(seed)
    names = [f"{k}:{w}" for k in "wpn" for w in "abcd"] + ["p:", "n:"]
    model = toxicity.Model(dict(zip(names, rng.normal(0, 4, len(names)))), -3.0, ((0.2, -0.4), (0.1, 0.7)))
    texts = [list(rng.choice(list("abcdefgh"), n)) for n in (0, 1, 2, 0, 0, 700, 5, 64, 1, 3000, 0)]
    for words, (at, p) in zip(texts, model.tagged(texts)):
        want_at, want = _plain(model, words)
        assert at.tolist() == want_at and np.allclose(p, want, rtol=1e-9, atol=1e-15)
    assert [len(at) for at, _ in model.tagged([[], []])] == [0, 0] and model.tagged([]) == []


def test_extreme_weights_stay_finite():
    model = toxicity.Model({"w:up": 500.0, "w:down": -500.0, "p:up": 90.0}, -12.0)
    for word in ("up", "down"):
        _, p = model.marginals([word] * 5000)
        assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()


def test_groups_of_texts_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 5)
    texts = ["a b c", None, "", "d " * 20, "e", "f g h i", "1 2"]
    groups = list(toxicity._together(texts))
    assert [t for some, _ in groups for t in some] == [t or "" for t in texts] and len(groups) > 1
    assert [len(w) for _, words in groups for w in words] == [3, 0, 0, 20, 1, 4, 0]
