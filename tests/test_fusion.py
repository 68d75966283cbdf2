"""Channel fusion in one pass."""

from telemill.operators import score_ops


def test_modes_share_a_pass(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (2, 5.0)], "t long, s double")
    out = score_ops.fuse_channels(df, ["t"], "s", {"mx": "max", "mean": "mean"})
    assert sorted(map(tuple, out.collect())) == [(1, 4.0, 3.0), (2, 5.0, 5.0)]
    assert sorted(map(tuple, score_ops.fuse_channels(df, ["t"], "s").collect())) == [(1, 4.0), (2, 5.0)]
