from pyspark.sql import functions as F
from sensorloom.operators.resample import bucket_mean
from sensorloom.streaming.fusion import bucketed_fusion


def test_stream_equals_batch(spark, tmp_path):
    rows = [(p, f"2024-01-01 0{h}:1{m}:00", float(h * 10 + m)) for p in (1, 2) for h in range(6) for m in range(3)]
    df = spark.createDataFrame(rows, "participant_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = bucketed_fusion(stream, ["participant_id"], "value").writeStream.outputMode("complete").format("memory").queryName("fused").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.participant_id, r.ts): r.value for r in spark.table("fused").collect()}
    want = {(r.participant_id, r.ts): r.value for r in bucket_mean(df, ["participant_id"], "value", "1 hour").collect()}
    assert got == want
