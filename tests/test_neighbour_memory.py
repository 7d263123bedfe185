"""What a task holds for nearest neighbours does not grow with the bank."""

import tracemalloc

import numpy as np
import pytest

from phmspark.operators import neighbours


@pytest.mark.parametrize("classes", [1, 3])
def test_distances_are_held_a_part_at_a_time(classes):
    """2,048 queries against 6,000 rows are 98 MB of distances; a part of them is worked out at once, with the same rows found."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(6000, 8))
    bank = neighbours.Bank.of(np.arange(6000), np.array([str(k % classes) for k in range(6000)], dtype=object), m)
    tracemalloc.start()
    found = list(neighbours._best(bank, np.arange(2048), m[:2048], 3, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    got = {(int(q), c, int(r)): (int(n), d) for a in found for q, c, r, n, d in zip(a[0], [a[1]] * len(a[0]), *a[2:], strict=True)}
    assert len(got) == 2048 * classes * 3
    for q in (0, 777, 2047):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        for c in range(classes):
            own = np.arange(c, 6000, classes)
            near = own[np.argsort(d[own], kind="stable")[:3]]
            assert [got[q, str(c), k + 1] for k in range(3)] == [(int(n), d[n]) for n in near]
