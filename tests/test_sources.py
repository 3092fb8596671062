"""Large wrapped files, published versions, checked caches, batches judged once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanlens import sources, streaming
from spanlens.sources import wrapped


def awkward(rng, n):
    odd = ['"', "\\", "}", "{", "]", "[", ",", "\\\\", '\\"', "é", "\n", "records", '"records": [', " ", "a"]
    return [{"id": i, "text": "".join(rng.choice(odd) for _ in range(rng.randint(0, 30))), "meta": {"k": i % 7, "list": [{"x": "}"}, {"x": 'q"'}][: i % 3]}} for i in range(n)]


@pytest.mark.parametrize("name", [None, "records"])
@pytest.mark.parametrize("indent", [None, 1])
def test_one_file_read_by_many_tasks(spark, tmp_path, name, indent):
    rows = awkward(random.Random(4), 700)
    doc = rows if name is None else {"phase": 'p "{', "about": {"a": {"b": 1}}, name: rows, "tail": {"z": [1, 2]}}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    schema = "id int, text string, meta struct<k int, list array<struct<x string>>>"
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        pieces = wrapped.pieces(spark, str(path))
        assert pieces.select("block").distinct().count() > 5
        got = sorted(wrapped.records(spark, str(path), schema, name).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [(r.id, r.text, r.meta.k, [x.x for x in r.meta.list]) for r in got] == [(r["id"], r["text"], r["meta"]["k"], [x["x"] for x in r["meta"]["list"]]) for r in rows]


def test_empty_and_small_files(spark, tmp_path):
    for k, text in enumerate(("[]", '{"records": []}', "[ {} ]", '[{"id": 1}]')):
        (tmp_path / f"{k}.json").write_text(text)
    n = [wrapped.records(spark, str(tmp_path / f"{k}.json"), "id int", "records" if k == 1 else None).count() for k in range(4)]
    assert n == [0, 0, 1, 1]


def test_a_version_is_seen_whole_or_not(spark, tmp_path):
    at = str(tmp_path / "t")
    assert sources.published(spark, at) is None
    sources.publish(spark.range(5).toDF("a"), at)
    old = sources.published(spark, at)

    def dies(batch):
        raise RuntimeError("lost")
        yield batch

    with pytest.raises(Exception, match="lost"):  # noqa: B017, PT011
        sources.publish(spark.range(9).toDF("a").mapInArrow(dies, "a bigint"), at)
    assert sources.published(spark, at).count() == 5
    sources.publish(spark.range(9).toDF("a"), at)
    assert sources.published(spark, at).count() == 9 and old.count() == 5
    assert sources.manifest(spark, at).number == 2


def test_a_cache_notices_its_inputs(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.range(3).write.parquet(src)
    made = []

    def call():
        rows = spark.read.parquet(src)
        made.append(1)
        return sources.cached(rows.withColumn("made", F.lit(len(made))), at, [src])

    assert [r.made for r in call().collect()] == [1] * 3
    assert [r.made for r in call().collect()] == [1] * 3
    spark.range(2).write.mode("append").parquet(src)
    assert [r.made for r in call().collect()] == [3] * 5
    version = sources.manifest(spark, at).version
    for f in (tmp_path / "kept" / "versions" / version).iterdir():  # a table that has lost its files is made again
        os.remove(f)
    assert [r.made for r in call().collect()] == [4] * 5


def test_batches_judged_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (["a", "b"], ["b", "c"], ["a", "d"]):
        spark.createDataFrame([(x,) for x in part], "id string").coalesce(1).write.mode("append").json(src)
    asked = []

    def judge(ok):
        def run(batch):
            asked.extend(r.id for r in batch.select("id").collect())
            return batch.withColumn("label", F.when(F.col("id").isin(*ok), True))

        return run

    stream = lambda: spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).json(src)
    streaming.judge_once(stream(), "id", out, str(tmp_path / "one"), judge(["a", "c"])).awaitTermination()
    assert sorted(asked) == ["a", "b", "c", "d"]
    streaming.judge_once(stream(), "id", out, str(tmp_path / "two"), judge(["b"])).awaitTermination()
    assert sorted(asked[4:]) == ["b", "d"]  # those without a label, again
    assert {r.id: r.label for r in streaming.judged(spark, out, "id").collect()} == {"a": True, "b": True, "c": True, "d": None}
    rows = spark.createDataFrame([("z", True)], "id string, label boolean")
    for _ in range(2):  # a batch that is run again replaces itself
        streaming.write_batch(rows, out, "r", 7)
    assert spark.read.option("basePath", out).parquet(out).filter("id = 'z'").count() == 1


def test_large_wrapped_tables_are_written_row_by_row(spark, tmp_path):
    """A document for each partition, an empty one among them; null fields stay, and what a string holds is no end of a record."""
    rows = [(i, None if i % 3 == 0 else f'a "}}, {{" {i}\n') for i in range(50)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3).union(spark.createDataFrame([], "id int, text string"))
    at = str(tmp_path / "w.json")
    sources.write_wrapped_parts(df, at, "records", {"phase": "one {"})
    documents = [json.loads(f.read_text()) for f in (tmp_path / "w.json").glob("part-*")]
    assert len(documents) >= 3 and {d["phase"] for d in documents} == {"one {"}
    assert sorted((r["id"], r["text"]) for d in documents for r in d["records"]) == rows
    assert sorted(tuple(r) for r in wrapped.records(spark, at, "id int, text string", "records").collect()) == rows


def test_keys_of_earlier_runs_are_not_sent_to_the_driver(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, "a"), (2, "b")], "id int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for run in ("one", "two"):
        stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
        q = streaming.judge_once(stream, "id", out, str(tmp_path / run), lambda b: b.withColumn("label", F.when(F.col("v") == "a", True)))
        q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert sorted((r.id, r.label) for r in streaming.judged(spark, out, "id").collect()) == [(0, True), (1, True), (2, None)]
