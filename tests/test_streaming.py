from lotsman.operators.datasets import quota_fill
from lotsman.streaming.quotas import fill_from_stream


def test_stream_fills_the_same_quotas(spark, tmp_path):
    rows = [(i, "ab"[i % 2 if i % 5 else 0]) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "id long, cls string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    need = spark.createDataFrame([("a", 25), ("b", 7), ("c", 3)], "cls string, need int")
    stream = spark.readStream.schema("id long, cls string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fill_from_stream(stream, need, "cls", ["id"], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    totals = {r.cls: r.taken for r in spark.read.parquet(str(tmp_path / "out" / "_totals" / "batch=2")).collect()}
    assert totals == {"a": 25, "b": 7}
    got = sorted((r.id, r.cls) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    counts = {c: sum(x[1] == c for x in got) for c in "abc"}
    assert counts == {"a": 25, "b": 7, "c": 0} and len({x[0] for x in got}) == 32
    assert quota_fill(spark.createDataFrame(rows, "id long, cls string"), need, "cls", ["id"]).count() == 32
