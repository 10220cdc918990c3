"""The classifier's repetition measure at every length."""

import numpy as np
import pytest

from verseloom.llm import quality_model


@pytest.mark.parametrize("distinct", [50, 200, 400, 900])
@pytest.mark.parametrize("times", [8, 20, 100])
def test_repeated_paragraph_is_bad_at_every_length(distinct, times):
    words = [f"w{k}" for k in range(distinct)] * times
    assert quality_model._distinct(words) < 0.25
    assert quality_model.votes(" ".join(words))[4] == quality_model.BAD


@pytest.mark.parametrize("n", [100, 399, 400, 401, 1000, 20_000])
def test_varied_text_is_good_at_every_length(n):
    words = [f"w{k}" for k in np.random.default_rng(1).integers(0, 600, n)]
    assert quality_model.votes(" ".join(words))[4] == quality_model.GOOD
