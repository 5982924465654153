from pyspark.sql import functions as F

from tickloom.operators import indicators
from tickloom.sources import bars
from tickloom.streaming.bars import stream_bars, stream_ema


def run(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_streamed_bars_equal_batch_bars(spark, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(small)
    streamed = run(stream_bars(events, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1), F.col("event_id")), "streamed_bars")
    batch = bars.bars_hourly(spark, small).withColumn("ts", F.col("ts").cast("timestamp"))
    joined = streamed.alias("s").join(batch.alias("b"), ["symbol", "ts"])
    assert 0 < streamed.count() <= batch.count()
    assert joined.where("s.open = b.open and s.high = b.high and s.low = b.low and s.close = b.close and s.volume = b.volume").count() == streamed.count()


def test_streamed_ema_equals_batch_ema(spark, tmp_path):
    rows = [("A", i, 10.0 + i % 7) for i in range(40)] + [("B", i, 5.0 + i % 3) for i in range(40)]
    table = spark.createDataFrame(rows, "symbol string, i int, close double").select("symbol", F.timestamp_seconds(F.col("i") * 60).alias("ts"), "close")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = {(r.symbol, r.ts): r.ema for r in run(stream_ema(stream), "streamed_ema").collect()}
    want = {(r.symbol, r.ts): r.ema for r in indicators.compute(table, "ema").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
