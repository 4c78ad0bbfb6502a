import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustline.functions import pixel as X
from dustline.operators import writer as W
from dustline.profile import Job


def test_response_table_is_that_of_the_expression(spark):
    got = np.array([r[0] for r in spark.range(65536).orderBy("id").select(X.response(F.col("id"))).collect()], np.float32)
    assert (got == X.response_table()).all()


def test_generator_known_states(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int").select(X.lcg_jump(F.lit(0x3045), F.col("n")))
    assert [r[0] for r in rows.collect()] == [0x1791B2, 0x8223EB, 0x8B89C0, 0x2242C1]
    assert W.jump(0x3045, np.array([34_596_507 % (1 << 24), 36_383_248 % (1 << 24)])).tolist() == [8_880_392, 16_418_997]


def test_percentiles():
    assert X.percentile_indices(65535) == (655, 64879)


def plain_walk(k, w, state, bounds):
    low, high = bounds
    out, n = w.astype(np.float32).copy(), 0

    def draw(z, scale):
        nonlocal state, n
        v = float(np.float32(z))
        if not low < v < high:
            return 0.0
        state = (125 * state + 1) & 0xFFFFFF
        n += 1
        delta = ((high - v) * (v - low)) * (4.0 / ((high - low) * (high - low))) * (((state + 1) * X.P.LCG_UNIT - 0.5) * float(np.float32(scale * v)))
        return delta if low < v + delta < high else 0.0

    for i in range(len(k)):
        for c in range(3):
            if k[i, c] + draw(k[i, c], X.P.DITHER_SCALES[c]) > float(w[i, c]):
                out[i, c] = np.float32(k[i, c] + draw(k[i, c], X.P.DITHER_SCALES[c]))
    return out, state, n


def test_three_phase_writer_equals_the_plain_walk():
    rng = np.random.default_rng(5)
    k = rng.uniform(30_000, 66_000, (3000, 3))
    w = (k + rng.normal(0, 300, k.shape)).astype(np.float32)
    got, want = W.walk(k, w, 0x3045, X.dither_bounds()), plain_walk(k, w, 0x3045, X.dither_bounds())
    assert (got[0] == want[0]).all() and got[1:] == want[1:]


@pytest.mark.parametrize("field, value", [("scanner", "x"), ("selector", 9), ("metric", 500), ("locked", False), ("height", 4), ("width", 7), ("main_dpi", 2000)])
def test_jobs_outside_the_profile_are_refused(field, value):
    with pytest.raises(ValueError):
        Job(**{field: value}).validate()


def test_inverse_factors_are_stable(spark):
    high = np.array([r[0] for r in spark.range(256).orderBy("id").select(X.high_factor(F.col("id"))).collect()], "<u4")
    assert hashlib.sha256(high.tobytes()).hexdigest().startswith("fdc37849")
