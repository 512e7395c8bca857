from labelq.operators import agreement as ag
from labelq.streaming.incremental import streaming_contingency


def test_stream_gives_the_batch_table(spark, tmp_path):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), (None, "b")] * 3
    df = spark.createDataFrame(rows, "truth string, pred string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_contingency(stream, "truth", "pred").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = spark.table("live")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, ag.contingency(df).collect()))
    assert ag.element_similarity(live).first().ecs == ag.element_similarity(ag.contingency(df)).first().ecs
