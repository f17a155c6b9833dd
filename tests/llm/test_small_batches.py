"""Python workers take a batch in small parts."""

import pyarrow as pa
import pytest

from tallyspark.llm import common, langid, minhash


def _batch(n):
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["one two " * (i % 7) for i in range(n)], pa.string())], ["node", "text"])


def test_parts_are_small_and_hold_every_row_in_order():
    whole = [_batch(3 * common.SLICE + 5), _batch(0), _batch(1)]
    parts = list(common.small(iter(whole)))
    assert max(p.num_rows for p in parts) == common.SLICE
    assert pa.Table.from_batches(parts) == pa.Table.from_batches(whole)


@pytest.mark.parametrize("operator", ["sets", "predict"])
def test_a_large_batch_is_answered_in_parts(operator, spark, monkeypatch):
    rows, tasks = spark.createDataFrame([(1, "a")], "node long, text string"), []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: tasks.append(run))
    if operator == "sets":
        minhash._sets(rows, 2)
        names = ["node", "text"]
    else:
        grams = langid.NGrams(6, 2)
        one = langid.Model(["en"], grams, pa.array([1.0] * 64).to_numpy(), pa.array([0.5] * 64).to_numpy().reshape(64, 1),
                           pa.array([0.0]).to_numpy(), 1.0)
        langid.predict(rows, one, keep=("node",))
        names = ["text", "node"]
    n = 2 * common.SLICE + 3
    out = list(tasks[0](iter([_batch(n).select(names)])))
    assert [b.num_rows for b in out] == [common.SLICE, common.SLICE, 3]
    assert pa.Table.from_batches(out).column("node").to_pylist() == list(range(n))
