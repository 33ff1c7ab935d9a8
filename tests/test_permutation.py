import numpy as np
import pytest

from landrank.plans import scoring


def test_matched_draws_cover_the_frame(spark):
    rng = np.random.default_rng(6)
    # 20 x 400 cells of 10 m; lowland (hand below 15) only in the upper half of the frame.
    cells = [(float(rng.uniform(0, 100)), 5.0 if r >= 200 else 30.0, 5.0 + 10 * c, 5.0 + 10 * r) for r in range(400) for c in range(20)]
    areas = [(1, 20.0, 3000.0, 100.0, 3150.0), (2, 20.0, 300.0, 100.0, 450.0), (3, 9000.0, 9000.0, 9100.0, 9100.0)]
    got = scoring.matched_draws(spark.createDataFrame(cells, "score_pct double, hand_m double, easting double, northing double"), spark.createDataFrame(areas, "aoi_id int, xmin double, ymin double, xmax double, ymax double"), 40).collect()
    boxes = {a: [r for r in got if r.aoi_id == a] for a in (1, 2, 3)}
    assert [len(boxes[a]) for a in (1, 2, 3)] == [40, 40, 0]
    c = np.array(cells)
    for r in got:
        inside = (c[:, 2] >= r.xmin) & (c[:, 2] <= r.xmax) & (c[:, 3] >= r.ymin) & (c[:, 3] <= r.ymax)
        assert r.n == inside.sum() >= 0.9 * r.own_n - 1
        assert r.pct_mean == pytest.approx(c[inside, 0].mean()) and r.lowland == pytest.approx((c[inside, 1] < 15).mean())
        assert abs(r.lowland - r.own_lowland) <= 0.15
        assert sorted((round(r.xmax - r.xmin, 6), round(r.ymax - r.ymin, 6))) == [80.0, 150.0]
    # The old draws never left the lowest 1400 m and had no lowland match.
    assert min(r.ymin for r in boxes[1]) >= 1900 and max(r.ymax for r in boxes[1]) > 3600 and max(r.ymax for r in boxes[2]) < 2100
    assert {round(r.xmax - r.xmin) for r in boxes[1]} == {80, 150}
