import datetime as dt

from attriva.operators.windows import first_by
from attriva.streaming import events as ev
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    batch = {tuple(r) for r in ev.tumbling(spark.read.parquet(src)).collect()}
    q = ev.tumbling(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("tumbling").collect()} == batch


def test_cache_upkeep(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, n int").coalesce(1).write.parquet(src)

    def newest(old, new):
        return first_by(old.unionByName(new), ["id"], [-F.col("n")])

    q = ev.cache_upkeep(spark.readStream.schema("id int, v string, n int").parquet(src), f"file://{tmp_path}/out", f"file://{tmp_path}/c", newest)
    assert q.awaitTermination(60)
    assert {(r.id, r.v) for r in spark.read.parquet(f"file://{tmp_path}/out/v0").collect()} == {(1, "b"), (2, "c")}
