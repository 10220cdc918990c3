"""The join by rare shingles against all pairs: a group whose texts differ from each other, sizes apart, and an empty table."""

import numpy as np

from verseloom.llm import near_copies


def test_pairs_across_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base, sets = np.arange(200), []
    for _ in range(250):
        keep = base[: int(rng.integers(120, 201))]
        keep = keep[rng.random(len(keep)) > rng.uniform(0, 0.2)]
        sets.append(np.union1d(keep, rng.integers(1000, 1300, int(rng.integers(0, 25)))))
    part = {k: k % 40 for k in range(0, len(sets), 3)}  # some are known to be linked already
    table = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sets)], "node long, set array<long>").repartition(7)
    known = spark.createDataFrame(list(part.items()), "node long, component long")
    got = {tuple(r) for r in near_copies._across(near_copies._fronts(table, known, 0.8), 0.8).select("a", "b").collect()}
    want = set()
    for b in range(len(sets)):
        for a in range(b):
            both = len(np.intersect1d(sets[a], sets[b]))
            if part.get(a, a) != part.get(b, b) and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert len(want) > 100 and want <= got
    none = near_copies._fronts(table.limit(0), known, 0.8)
    assert near_copies._across(none, 0.8).count() == 0
