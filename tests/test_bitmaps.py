import numpy as np
from corpusmill.core.bitmaps import bitmap, inside


def test_a_bitmap_holds_what_went_in(spark):
    rng = np.random.default_rng(2)
    known = rng.integers(-(2**63), 2**63 - 1, 500)
    for bits in (10, 16, 20):
        filter_ = bitmap(spark.createDataFrame([(int(h),) for h in known], "h long"), "h", bits)
        assert len(filter_) == 2**bits // 8 and inside(filter_, known.view(np.uint64)).all()
    other = rng.integers(-(2**63), 2**63 - 1, 2000).view(np.uint64)
    assert inside(filter_, other).mean() < 0.01
    assert not inside(bitmap(spark.createDataFrame([], "h long"), "h", 16), other).any()
