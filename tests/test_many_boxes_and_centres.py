"""Boxes of unlike size and areas of thousands of centres: few tests per point, same result as the scan."""

import numpy as np
import pytest

from cellpulse.operators import spatial
from cellpulse.session import materialize


def test_one_huge_and_many_small_boxes(spark):
    side = 316
    small = [(n, float(n // side), n // side + 0.75, float(n % side), n % side + 0.75) for n in range(side * side)]
    boxes = spark.createDataFrame(small + [(-1, 0.0, 1e4, 0.0, 1e4), (-2, 5.0, 5.0, 5.0, 5.0)],
                                  "areaid int, x_min double, x_max double, y_min double, y_max double")
    rng = np.random.default_rng(2)
    found = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 330, (2_000, 2)))]
    found += [(9_000, 5.0, 5.0), (9_001, 5.75, 5.75), (9_002, None, 1.0), (9_003, float("nan"), 1.0), (9_004, 1e4, 1e4)]
    points = spark.createDataFrame(found, "k int, x double, y double")
    got = sorted((r.k, r.areaid) for r in spatial.assign_area(points, boxes).collect())
    want = []
    for k, x, y in found:
        if x is None or np.isnan(x):
            continue
        if 0 <= x <= 1e4 and 0 <= y <= 1e4:
            want.append((k, -1))
        if (x, y) == (5.0, 5.0):
            want.append((k, -2))
        i, j = int(np.floor(x)), int(np.floor(y))
        if 0 <= i < side and 0 <= j < side and x <= i + 0.75 and y <= j + 0.75:
            want.append((k, i * side + j))
    assert got == sorted(want)
    # The huge box and at most the four small ones around a cell corner.
    assert spatial.area_candidates(points, boxes).count() <= 6 * len(found)


def test_boxes_of_every_size_as_brute_force(spark):
    rng = np.random.default_rng(3)
    corners = rng.uniform(-100, 100, (200, 2))
    sizes = 2.0 ** rng.uniform(-6, 7, (200, 2))
    rows = [(i, float(x), float(x + w), float(y), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(corners, sizes))]
    boxes = spark.createDataFrame(rows, "areaid int, x_min double, x_max double, y_min double, y_max double")
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-120, 220, (500, 2)))]
    points = spark.createDataFrame(pts, "k int, x double, y double")
    want = sorted((k, a) for k, x, y in pts for a, x0, x1, y0, y1 in rows if x0 <= x <= x1 and y0 <= y <= y1)
    assert sorted((r.k, r.areaid) for r in spatial.assign_area(points, boxes).collect()) == want
    assert spatial.assign_area(points, boxes.limit(0)).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_thousands_of_centres_as_the_scan(spark, clustered):
    rng = np.random.default_rng(4)
    k = 2_000 if clustered else 10_000
    centres = rng.normal(0, 1, (k, 2)) if clustered else rng.uniform(0, 50, (k, 2))
    centres[17] = centres[1_900]  # a tie: the lower id wins
    low, high = centres.min() - 1, centres.max() + 1
    pts = np.concatenate([rng.uniform(low, high, (800, 2)) if not clustered else rng.normal(0, 1, (800, 2)),
                          centres[[17, 1_900, 3]], [[500.0, -500.0]]])
    frame = materialize(spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(centres)] + [(1, 3, 0.0, 0.0)],
                                              "areaid int, clusterid int, cx double, cy double"))
    points = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
                                   + [(1, -1, 7.0, 7.0), (2, -2, 1.0, 1.0), (0, -3, None, 1.0)], "areaid int, k int, x double, y double")
    got = {r.k: r.clusterid for r in spatial.nearest_of_many(points, frame).collect()}
    away = ((pts[:, None, :] - centres[None]) ** 2)
    away = away[..., 0] + away[..., 1]
    assert [got[i] for i in range(len(pts))] == away.argmin(axis=1).tolist()
    assert (got[-1], got[-2]) == (3, None)
    cells = spatial.centre_cells(frame).where("areaid = 0").selectExpr("size(_near) n", "_level", "_side / pow(2, _level) side", "_side").collect()
    assert max(c.n for c in cells) <= spatial.LEAF_TIES and len(cells) < 40_000
    assert sum(c.side ** 2 for c in cells) == pytest.approx(cells[0]._side ** 2)  # the leaves cover the square
    assert len({c._level for c in cells}) <= 16  # look-ups of a point


def test_few_centres_as_the_scan(spark):
    centres = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 2.0, 1.0), (1, 5, 3.0, 3.0)], "areaid int, clusterid int, cx double, cy double")
    points = spark.createDataFrame([(a, i, i / 4, (i * 7 % 13) / 3) for a in (0, 1, 2) for i in range(30)], "areaid int, k int, x double, y double")
    want = sorted(map(tuple, spatial.nearest_centre(points, centres).collect()), key=repr)
    assert sorted(map(tuple, spatial.nearest_of_many(points, centres).collect()), key=repr) == want
