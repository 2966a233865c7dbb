from pyspark.sql import functions as F

from loomfeed.streaming import state as S

D = "/root/testdata/sf0.001"


def test_seen_set_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet").select("user_id", "event_type")
    for i in range(3):
        events.where(F.lit(i) >= 0).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_available(S.seen_dedup(stream, ["user_id", "event_type"]), str(tmp_path / "cp"), lambda b, _: got.extend(map(tuple, b.collect())))
    assert sorted(got) == sorted(map(tuple, events.distinct().collect()))


def test_retry_queue_equals_batch(spark, tmp_path):
    o = spark.read.parquet(f"{D}/events.parquet").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") != "error").alias("ok"))
    # batches in order of time, as a queue sees them
    for i in range(3):
        lo, hi = 1704067200 + i * 10 * 86400, 1704067200 + (i + 1) * 10 * 86400
        o.where(f"at >= {lo} AND at < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = {}
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    S.run_available(S.retry_queue(stream, "user_id"), str(tmp_path / "cp"), lambda b, _: last.update({r.user_id: (r.attempts, r.due) for r in b.collect()}), "update")
    want = {r.user_id: (r.attempts, r.due) for r in S.retry_queue_batch(spark.read.parquet(str(tmp_path / "in")), "user_id").collect()}
    assert last == want
