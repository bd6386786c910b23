from lorekiln.streaming import jobs

EVENT = "event_id long, user_id long, ts timestamp"


def events(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(k, k % 3, start + timedelta(minutes=(k * 37) % 600)) for k in range(90)], EVENT)


def plain(rows, seconds):
    last, out = {}, set()
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        if r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() >= seconds:
            last[r.user_id] = r.ts
            out.add(r.event_id)
    return out


def test_throttle_in_batch_and_stream(spark, tmp_path):
    df = events(spark)
    want = plain(df.collect(), 1800)
    assert {r.event_id for r in jobs.throttled(df, "user_id", "ts", "event_id", 1800).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.throttle_stream(jobs.new_files(spark, str(tmp_path / "in"), df.schema), "user_id", "ts", 1800)
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("throttled").count() == len(want)


def test_sync_appends_what_is_new(spark, tmp_path):
    kind = "id string, content string, project string"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "1", "p"), ("b", "1", "p")], kind).coalesce(1).write.mode("append").parquet(source)
    run = lambda: jobs.append_new(jobs.new_files(spark, source, kind), store, str(tmp_path / "c")).awaitTermination(120)
    run()
    spark.createDataFrame([("a", "2", "p"), ("c", "1", "q")], kind).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.content) for r in spark.read.parquet(store).collect()) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_first_of_each_key(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.first_of_each(jobs.new_files(spark, str(tmp_path / "in"), EVENT), ["user_id"], "ts", "1 day")
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 3
    counts = jobs.windowed_counts(events(spark), "ts", "1 hour", "10 minutes", "user_id")
    assert counts.groupBy().sum("n").first()[0] == 90
