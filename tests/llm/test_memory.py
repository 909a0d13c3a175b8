"""What Python workers hold at once, and what they keep between the stages of the pipeline."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corvane.llm import packing, suffix_dedup, tokens
from corvane.llm.common import by_bytes, small_batches

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_cut_by_all_their_columns():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 40, None, "x", "x" * 300, ""]), pa.array(["", "y" * 70, "y", "y", "y" * 90]), pa.array([[1] * 10, None, [], [2] * 20, [3]], pa.list_(pa.int64()))], names=["a", "b", "h"])
    rows = lambda columns: [b.num_rows for b in by_bytes([batch, batch.slice(0, 0)], columns, 100)]
    assert rows("a") == [3, 1, 1] and rows(("a", "b")) == [1, 2, 1, 1] and rows("h") == [3, 1, 1]
    assert pa.Table.from_batches(by_bytes([batch], ("a", "b"), 100)).to_pylist() == batch.to_pylist()


def test_stages_send_small_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some text ', 1000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    for name, stage in corpus_pipeline.STAGES:
        if name != "decontamination":  # no Python there
            spark.conf.unset(LIMIT)
            stage(spark, docs, SF)
            assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 5 << 20, name
    spark.conf.set(LIMIT, "1m")
    small_batches(spark)
    assert spark.conf.get(LIMIT) == "1m"
    spark.conf.unset(LIMIT)


def test_packing_workers_forget_their_tokenizer(spark):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, len(tokens._ENCODERS)))], names=["n"])

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    assert corpus_pipeline.packing(spark, docs, SF).count() > 0
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
    spark.conf.unset(LIMIT)


def test_a_task_has_one_python_worker(spark):
    """No Python node of suffix dedup feeds another one without a shuffle between: each would hold a worker of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = suffix_dedup.dedup_text(docs)._jdf.queryExecution().executedPlan().toString().splitlines()
    nodes = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan]
    python = [i for i, (_, line) in enumerate(nodes) if "InArrow" in line]
    assert len(python) >= 4
    for i in python:
        for depth, line in nodes[i + 1 :]:
            if depth <= nodes[i][0] or "Exchange" in line:
                break
            assert "InArrow" not in line, line


def test_merging_windows_sends_no_ids(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('some text ', 1 + id % 50) as text")
    packed = packing.pack(docs.repartition(4), with_ids=True)
    groups = [line for line in packed._jdf.queryExecution().executedPlan().toString().splitlines() if "FlatMapGroupsInArrow" in line]
    assert groups and all("ids#" not in line for line in groups)
    assert packed.where("cardinality(ids) <> length").count() == 0 and packed.agg({"length": "sum"}).first()[0] == packed.selectExpr("sum(cardinality(ids))").first()[0] > 0


def test_waiting_pieces_hold_their_own_ids_only():
    ids = np.arange(5000, dtype=np.int32)
    pieces = list(packing._cut(ids, 2048))
    assert [(s, len(p)) for s, p in pieces] == [(0, 2048), (2048, 2048), (4096, 904)]
    assert pieces[-1][1].base is None and (np.concatenate([p for _, p in pieces]) == ids).all()
    assert [len(p) for _, p in packing._cut(ids[:0], 2048)] == [] and [len(p) for _, p in packing._cut(ids[:7], 2048)] == [7]
