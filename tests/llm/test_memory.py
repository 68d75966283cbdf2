"""What bounds the memory of workers and of the last stage of line dedup."""

import pyarrow as pa

from telemill.llm import packing
from telemill.llm import text as T
from telemill.llm.line_dedup import remove_repeats


def test_another_operator_drops_the_encoder():
    packing._encoders["x"] = object()
    batch = pa.RecordBatch.from_pydict({"text": ["a b"]})
    assert len(list(T.slices(iter([batch]), "text", operator="packing"))) == 1 and packing._encoders
    assert len(list(T.slices(iter([batch]), "text"))) == 1 and not packing._encoders


def test_matches_meet_their_text_by_order(spark):
    line = "one two three four five six seven.\neight nine ten eleven twelve thirteen.\n"
    docs = spark.createDataFrame([(1, line), (2, "head\n" + line), (3, line), (3, line), (None, line)], "doc_id long, text string")
    out = remove_repeats(docs)
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, line, 2, 0), (2, "head\n", 3, 2), (3, line, 2, 0), (3, line, 2, 0), (None, line, 2, 0)], key=str)
    # one sort by id stands above the join that finds the excerpts; no list of excerpts, no join with texts
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    last = plan[: plan.index("RepartitionByExpression")]
    assert "Join" not in last and "Aggregate" not in last and "collect_list(struct(a" not in plan


def test_confirming_workers_share_no_stage_with_the_filter(spark):
    from telemill.llm.minhash import _confirmed

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string")
    out = _confirmed(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), docs, "doc_id", "text", 2, 0.8)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    last = plan[plan.index("MapInArrow") :]
    assert last.index("SortMergeJoin") < last.index("Exchange") < last.index("MapInArrow", 1)
    assert "BroadcastHashJoin" not in last[: last.index("Exchange")]
