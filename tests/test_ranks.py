"""Ranks of equal scores."""

from telemill.operators import topk
from telemill.plans import q_topk


def test_equal_scores_rank_by_tgid(spark, monkeypatch):
    # both score 81 / (20 * 172800), half a unit of the ninth digit: as doubles they round apart
    a = (3 * 10**9, 40000, 0, 90000, 0, 0, 0, 10000)
    b = (8 * 10**9, 10000, 0, 80000, 0, 20000, 0, 0)
    rows = [(0, 5, 1, 1, *b, 172800.0), (0, 5, 2, 2, *a, 172800.0), (0, 5, 3, 3, 10**15, *b[1:], 172800.0)]
    cols = ", ".join(f"{c} long" for c in topk.COUNTERS)
    df = spark.createDataFrame(rows, f"host long, ts_ns long, tid long, tgid long, {cols}, window_s double")
    monkeypatch.setattr(q_topk, "deltas", lambda spark, sf: df)
    got = {r["tgid"]: (r["rank"], int(r["score"])) for r in q_topk.ranks(spark, "").collect()}
    assert {g: r for g, (r, _) in got.items()} == {3: 1, 1: 2, 2: 3}
    assert got[1][1] == got[2][1] == 81 * 2**30 * 10**9
