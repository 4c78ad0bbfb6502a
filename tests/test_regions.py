import numpy as np
import pytest

from dustline.operators import regions as R


def table(spark, mask, name="f"):
    y, x = np.indices(mask.shape)
    rows = [(name, int(a), int(b), bool(m)) for a, b, m in zip(y.ravel(), x.ravel(), mask.ravel())]
    return spark.createDataFrame(rows, "frame_id string, y int, x int, mask boolean")


@pytest.mark.parametrize("h, w, want", [(3, 3, (9, 2, "not_routed")), (1, 400, (400, 1, "area")), (9, 9, (81, 5, "chessboard_radius")), (30, 30, (900, 15, "area+chessboard_radius"))])
def test_rectangles(spark, h, w, want):
    m = np.zeros((h + 4, w + 4), bool)
    m[2 : 2 + h, 2 : 2 + w] = True
    t = table(spark, m)
    r = R.region_table(t, R.labels(t)).first()
    assert (r["area"], r["radius"], r["reason"]) == want


def test_absorbed_and_merged_regions(spark):
    m = np.zeros((50, 70), bool)
    m[10:19, 10:19] = m[10:19, 25:34] = True
    m[22:25, 14:17] = True
    out = R.route(table(spark, m), "1.0")
    regions = {r["label"]: r for r in out["regions"].collect()}
    assert sorted(r["disposition"] for r in regions.values()) == ["absorbed", "routed", "routed"]
    assert [r["absorbed_pixels"] for r in regions.values() if r["disposition"] == "absorbed"] == [3]
    assert out["finals"].count() == 1


def test_perimeter_ring_is_never_synthesised(spark):
    m = np.zeros((30, 40), bool)
    m[[0, -1]] = True
    m[:, [0, -1]] = True
    m[2:11, 15:24] = True
    out = R.route(table(spark, m), "1.0")
    assert out["census"].first()["perimeter_regions"] == 1
    assert out["census"].first()["suppressed_halo_pixels"] > 0
    assert not out["synth"].where("synth AND perimeter").count()


def test_mask_without_context_raises(spark):
    with pytest.raises(Exception, match="no context"):
        R.route(table(spark, np.ones((3, 4), bool)))["labels"].collect()


def test_budget_boundary(spark):
    m = np.zeros((10, 10), bool)
    m[0, 0] = m[5, 5] = True
    assert R.route(table(spark, m), min_area=1, margin=0)["census"].first()["within"]
    m[9, 0] = True
    assert not R.route(table(spark, m), min_area=1, margin=0)["census"].first()["within"]
