"""The streaming daily aggregate equals the batch operator on the same rows."""
import os
import tempfile

from pyspark.sql import functions as F

from ripplekit.operators.events import daily_treatment
from ripplekit.sources import views as V
from ripplekit.streaming.daily import daily_treatment_stream, event_stream


def test_stream_equals_batch(spark):
    ev = V.ev(spark, "/root/testdata/sf0.001").select(
        "unit", F.col("day").cast("timestamp").alias("ts"), "actor", "size")
    src = tempfile.mkdtemp(prefix="rk-stream-src-")
    ev.where(F.year("ts") < 1998).write.mode("overwrite").parquet(os.path.join(src, "b1"))
    ev.where(F.year("ts") >= 1998).write.mode("overwrite").parquet(os.path.join(src, "b2"))
    stream = daily_treatment_stream(event_stream(spark, os.path.join(src, "*"), ev.schema), ["F", "O", "P"])
    q = stream.writeStream.format("memory").queryName("rk_daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM rk_daily")
    batch = daily_treatment(ev.withColumn("day", F.to_date("ts")), ["F", "O", "P"], notes=None)
    cols = ["unit", "day", "occ_F", "occ_O", "occ_P", "n_events"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b
