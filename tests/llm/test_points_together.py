"""Points of op 1 that go down an R-tree together find what each finds alone."""

import numpy as np
import pytest

from tabkit.llm.ngram_join import FAN, TOGETHER, RTree, _needed


@pytest.mark.parametrize("top", [3, 9000, 70000])
def test_points_together(top):
    rng = np.random.default_rng(top)
    points = rng.integers(0, top, (150, 40))
    for i in range(40, 150, 3):  # like others, but for a few groups
        points[i] = points[i - 37]
        points[i, rng.integers(0, 40, 3)] = rng.integers(0, top, 3)
    points = points.astype(np.uint16 if top < 1 << 16 else np.int64)
    n = points.sum(axis=1, dtype=np.int64)
    tree = RTree(points, n)
    assert len(n) > 2 * TOGETHER > FAN
    found = [x for i in range(0, len(n), TOGETHER) for x in tree.all_before(i, min(i + TOGETHER, len(n)), 80)]
    assert len(found) == len(n) and sum(len(near) for near, _ in found) >= 37
    for q, (near, spare) in enumerate(found):
        exact = np.minimum(points[:q].astype(np.int64), points[q]).sum(axis=1) - _needed(n[q], n[:q], 80)
        ok = (exact >= 0) & (5 * n[:q] >= 4 * n[q]) & (4 * n[:q] <= 5 * n[q])
        assert near.tolist() == np.flatnonzero(ok).tolist() and (spare == exact[near]).all()
