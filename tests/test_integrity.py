import threading

import numpy as np
import pytest

from dustline import profile as P
from dustline.operators import composite as C
from dustline.operators import regions as R
from dustline.operators import writer as W
from dustline.plans import receipts
from dustline.sources import integrity as I


def plane(spark, h=6, w=8):
    rows = [("f", y, x, float(P.SCORE_FLOOR) if (y, x) == (2, 3) else 1.0, (y, x) == (2, 3)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "frame_id string, y int, x int, score float, at_floor boolean")


def test_cache_is_published_once_and_verified(spark, tmp_path):
    at, bound = str(tmp_path / "cache"), I.binding("a" * 64, None, "banded", {})
    anchor = I.save_cache(plane(spark), at, bound)
    assert I.load_cache(spark, at, bound, anchor).count() == 48
    with pytest.raises(FileExistsError):
        I.save_cache(plane(spark), at, bound)
    with pytest.raises(ValueError, match="something else"):
        I.load_cache(spark, at, I.binding("b" * 64, None, "banded", {}))
    assert [p.name for p in tmp_path.iterdir()] == ["cache"]


def test_empty_cache(spark, tmp_path):
    at = str(tmp_path / "none")
    anchor = I.save_cache(plane(spark).where("false"), at, {})
    assert I.load_cache(spark, at, {}, anchor).count() == 0


def test_progress_and_cancel(spark, tmp_path):
    heard = []
    got = I.run_observed(plane(spark), str(tmp_path / "a"), {"n": __import__("pyspark.sql.functions", fromlist=["count"]).count("*")}, lambda *x: heard.append(x))
    assert got == {"n": 48} and heard
    stop = threading.Event()
    stop.set()
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda ds: (__import__("time").sleep(20) or d for d in ds), "id bigint")
    with pytest.raises(InterruptedError):
        I.run_observed(slow, str(tmp_path / "b"), {"n": __import__("pyspark.sql.functions", fromlist=["count"]).count("*")}, cancelled=stop)
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_damaged_images_are_refused(spark):
    png = bytes(I.mask_images(plane(spark).withColumnRenamed("at_floor", "mask")).first()["png"])
    m = I.read_mask(png)
    assert m.shape == (6, 8) and m.sum() == 1 and m[2, 3]
    for at in (3, 20, 50):
        with pytest.raises(Exception):
            I.read_mask(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])


def test_draws_of_one_site():
    rng = np.random.default_rng(3)
    for _ in range(200):
        k, w, c, s = rng.uniform(30_000, 65_000), np.float32(rng.uniform(30_000, 65_000)), int(rng.integers(3)), int(rng.integers(1 << 24))
        n, after = W.draw_probe(k, w, c, s)
        full = np.array([[-1.0, -1.0, -1.0]])  # other channels lie outside the bounds and draw nothing
        full[0, c] = k
        _, state, draws = W.walk(full, np.full((1, 3), w, np.float32), s, W.dither_bounds())
        assert (n, after) == (draws, state)


def test_fills_are_not_called_over_a_cap(spark, monkeypatch):
    mask = np.zeros((20, 20), bool)
    mask[5:14, 5:14] = True
    y, x = np.indices(mask.shape)
    px = spark.createDataFrame([("f", int(a), int(b), 100, 200, 300) for a, b in zip(y.ravel(), x.ravel())], "frame_id string, y int, x int, r int, g int, b int")
    m = spark.createDataFrame([("f", int(a), int(b), bool(v)) for a, b, v in zip(y.ravel(), x.ravel(), mask.ravel())], "frame_id string, y int, x int, mask boolean")
    r = R.route(m, "1.0")
    assert C.composite(px, r["synth"], r["final"], census=r["census"])["image"].count() == 400
    monkeypatch.setattr(P, "MAX_COMPONENTS", 0)
    with pytest.raises(ValueError, match="caps"):
        C.composite(px, r["synth"], r["final"])
    with pytest.raises(Exception, match="as many crops"):
        monkeypatch.undo()
        c = C.composite(px, r["synth"], r["final"])
        C.batch_filled(C.crop_rows(c["crop"], c["ranges"]), lambda crops: []).collect()


def test_receipts_that_contradict_themselves():
    sha = "a" * 64
    counts = dict.fromkeys(receipts.COUNTS, 0)
    good = {"artefacts": [{"role": r, "sha256": sha} for r in receipts.ROLES], "census": counts, "cache_manifest_sha256": sha, "composite_sha256": sha, "frame_id": "f", "limit": "0.02", "provenance": {}, "source_sha256": sha, "version": 1}
    assert receipts.problems(good) == []
    assert receipts.problems(good | {"census": counts | {"synth_pixels": 1}})
    assert receipts.problems(good | {"artefacts": good["artefacts"][1:]}) and receipts.problems(good | {"artefacts": good["artefacts"] + good["artefacts"][:1]})
    assert receipts.problems(good | {"source_sha256": "b" * 64}) and receipts.problems({k: v for k, v in good.items() if k != "limit"})


def test_job_problems():
    assert P.Job().problems() == [] and len(P.Job(scanner="x", locked=False, width=2).problems()) == 3
    with pytest.raises(ValueError, match="scanner"):
        P.Job(scanner="x").validate()
