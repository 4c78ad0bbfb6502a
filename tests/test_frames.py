import hashlib

import numpy as np
import pytest

from dustline.sources import frames as S


def test_npy_frames_round_trip(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 65536, (6, 9, 4), dtype=np.uint16)
    np.save(tmp_path / "a.npy", a)
    px = S.read_npy(spark, str(tmp_path / "a.npy"))
    got = np.array([[r[c] for c in S.SAMPLES] for r in px.orderBy("y", "x").collect()], np.uint16).reshape(6, 9, 4)
    assert (got == a).all()
    assert S.content_hash(px, S.SAMPLES).first()["sha256"] == hashlib.sha256(a.astype("<u2").tobytes()).hexdigest()
    back = S.assemble_blocks(S.split_blocks(px, 4))
    assert back.exceptAll(px).count() == 0 and back.count() == px.count()
    head = S.npy_header(spark.read.format("binaryFile").load(str(tmp_path / "a.npy"))).first()
    assert head["whole"] and head["dtype"] == "<u2" and not head["fortran"]


def test_other_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "b.npy", np.zeros((2, 2, 3), np.uint16))
    with pytest.raises(Exception, match="uint16"):
        S.read_npy(spark, str(tmp_path / "b.npy")).collect()


def test_gaps_in_blocks_raise(spark):
    px = spark.createDataFrame([("f", y, 0, 1, 2, 3, 4) for y in (0, 1, 4, 5)], S.PIXELS)
    with pytest.raises(Exception, match="gap-free"):
        S.assemble_blocks(S.split_blocks(px, 2)).collect()


def test_manifests_are_strict():
    assert S.read_manifest('{"a": 1}', {"a"}) == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"b": 1}'):
        with pytest.raises(ValueError):
            S.read_manifest(bad, {"a"})
    assert S.canonical_json({"b": 1, "a": [2]}) == b'{"a":[2],"b":1}\n'
