"""The streaming forms give what the batch forms give."""

import numpy as np
from pyspark.sql import functions as F

from trackweave.operators import windows as W
from trackweave.streaming import windows as ST


def _streamed(spark, tmp_path, name, df, parts, order, make, mode):
    folder = tmp_path / name
    for i, part in enumerate(np.array_split(df.orderBy(order).toPandas(), parts)):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/p{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/*")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_accepted_cuts(spark, tmp_path):
    rng = np.random.default_rng(0)
    hits = spark.createDataFrame([(int(k), int(f)) for k in range(3) for f in np.unique(rng.integers(0, 300, 60))], "k int, frame long")
    want = W.refractory(hits.withColumn("s", F.lit(1.0)), ["k"], "frame", F.col("s"), 0.5, 20)
    got = _streamed(spark, tmp_path, "cuts", hits, 4, "frame", lambda s: ST.accepted_cuts(s, "k", "frame", 20), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_and_tumbling_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("user_id") % 3).alias("u"))
    for name, make in (("sessions", lambda s: ST.session_counts(s, "ts", "2 hours", ["u"])), ("hours", lambda s: ST.tumbling_counts(s, "ts", "1 hour", ["event_type"]))):
        got = _streamed(spark, tmp_path, name, events, 2, "ts", make, "complete")
        assert sorted(map(str, got.collect())) == sorted(map(str, make(events).collect()))
