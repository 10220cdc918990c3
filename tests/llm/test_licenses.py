"""Notices of license scans: several in one text, and against a search of every place."""

import numpy as np
import pytest

from verseloom.llm import licenses

TEXT = {t.label: t.text for t in licenses.TEMPLATES}


def every_place(words):
    """Notices by a check of each place of a text."""
    found = set()
    for t in licenses.TEMPLATES:
        own = t.text.encode().split()
        for start in range(-len(own), len(words)):
            near = words[max(0, start - 2) : max(0, start + len(own) + 2)]
            line = b" " + b" ".join(near) + b" "
            hits = sum(w in words[max(0, start + p - 2) : max(0, start + p + 3)] for p, w in enumerate(own))
            exact = any(0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(own))
            if exact and hits >= 0.6 * len(own) and all(b" %s " % m.encode() in line for m in t.mandatory):
                found.add(t.label)
    return found


@pytest.mark.parametrize("long", ["bsd", "mit-text", "gpl-notice", "mpl-2.0"])
def test_long_notice_hides_no_other(long):
    others = ["all-rights-reserved", "mit-notice", "apache-2.0"]
    text = ". ".join([TEXT[x] for x in others] + ["some words between"] * 5 + [TEXT[long]])
    index = licenses.Index(licenses.TEMPLATES, {"all": 900, "the": 999, "license": 5, "rights": 3}, 1000)
    assert {*others, long} <= set(index.notices(licenses.words_of(text)))


def test_notices_equal_every_place():
    rng = np.random.default_rng(4)
    frequency = {w: int(rng.integers(0, 1000)) for t in TEXT.values() for w in t.split()}
    index = licenses.Index(licenses.TEMPLATES, frequency, 1000)
    vocabulary, hits = sorted(frequency), 0
    for _ in range(150):
        words = []
        for label in rng.choice(sorted(TEXT), 3):
            own = TEXT[label].split()
            for k in rng.choice(len(own), int(len(own) * rng.uniform(0, 0.5)), replace=False):
                own[k] = str(rng.choice(["x", "y", rng.choice(vocabulary)]))
            words += [*own, *map(str, rng.choice(["x", "z", rng.choice(vocabulary)], 4))]
        words = licenses.words_of(" ".join(words))
        want = every_place(words)
        assert set(index.notices(words)) == want
        hits += len(want)
    assert hits > 100
