"""Streaming jobs over small folders and files, run to completion."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexspark.sources import chunk_store
from tests.measure import shuffled
from lexspark.streaming import jobs


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_files_are_ingested_once(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.txt").write_text("one two three " * 10)
    (folder / "skip.bin").write_bytes(b"\x00")
    finish(jobs.ingest(jobs.folder_stream(spark, str(folder)), store, str(tmp_path / "cp"), 20, 5))
    n = spark.read.parquet(store).count()
    (folder / "b.txt").write_text("other words here " * 10)
    finish(jobs.ingest(jobs.folder_stream(spark, str(folder)), store, str(tmp_path / "cp"), 20, 5))
    rows = spark.read.parquet(store)
    assert n > 0 and rows.count() == 2 * n and rows.select("id").distinct().count() == rows.count()


def events(spark, path, start, n):
    rows = [(str(i % 3), "view", start + timedelta(minutes=30 * i), 10.0, 20.0, 0.0, i) for i in range(n)]
    schema = "query_id string, activity_type string, timestamp timestamp, cpu_usage double, memory_usage double, error_rate double, seq long"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_windows(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = events(spark, path, datetime(2024, 1, 1), 20)
    stream = spark.readStream.schema(schema).parquet(path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    finish(jobs.counts(stream, "activity_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp))
    got = spark.read.parquet(out)
    assert got.count() > 5 and got.filter("n <> 2").count() == 0
    out2 = str(tmp_path / "out2")
    finish(jobs.rolling_health(stream).writeStream.format("parquet").option("path", out2).option("checkpointLocation", cp + "2"))
    assert spark.read.parquet(out2).filter("status <> 'healthy'").count() == 0


def parts(folder):
    return {f.name for f in folder.rglob("part-*.parquet")}


def test_query_log_upsert(spark, tmp_path):
    path, log = str(tmp_path / "events"), tmp_path / "log"
    schema = events(spark, path, datetime(2024, 1, 1), 9)
    stream = lambda: spark.readStream.schema(schema).parquet(path).withColumn("scores", F.array(F.lit(0.5)))
    run = lambda cp: finish(jobs.upsert_queries(stream(), str(log), str(tmp_path / cp)))
    now = lambda: {r["query_id"]: (r["seq"], r["timestamp"].month) for r in spark.read.parquet(str(log)).collect()}
    run("cp")
    assert now() == {"0": (6, 1), "1": (7, 1), "2": (8, 1)}
    before = {b.name: parts(b) for b in log.iterdir() if b.is_dir()}
    assert len(before) == 3
    df = spark.createDataFrame([("1", "view", datetime(2024, 5, 1), 1.0, 1.0, 0.0, 20), ("0", "view", datetime(2024, 6, 1), 1.0, 1.0, 0.0, 2)], schema)
    df.filter("seq = 20").coalesce(1).write.mode("append").parquet(path)
    run("cp")
    assert now() == {"0": (6, 1), "1": (20, 5), "2": (8, 1)}
    after = {b.name: parts(b) for b in log.iterdir() if b.is_dir()}
    assert sorted(b for b in before if before[b] == after[b]) == sorted(set(before) - {f"bucket={chunk_bucket(spark, '1')}"})
    df.filter("seq = 2").coalesce(1).write.mode("append").parquet(path)  # an older row changes nothing
    run("cp")
    want = now()
    run("fresh")  # all files again, as one batch
    assert now() == want == {"0": (6, 1), "1": (20, 5), "2": (8, 1)}


def chunk_bucket(spark, key):
    return spark.createDataFrame([(key,)], "k string").select(chunk_store.bucket_of("k", 64)).first()[0]


def test_only_admitted_buckets_are_read(spark, tmp_path):
    store = chunk_store.ChunkStore(str(tmp_path / "store"), buckets=8, bits=1 << 14)
    rows = lambda ids: spark.createDataFrame([(i, f"text {i}", n, {"k": i} if i else None) for n, i in enumerate(ids)], "id string, text string, batch int, metadata map<string,string>")
    assert store.add(rows([f"a{k}" for k in range(40)] + ["a0", None]), 0) == []
    assert store.read(spark).count() == 40
    some = rows(["b1", "b2", "a7"])
    own = {r[0] for r in some.filter("id = 'a7'").select(chunk_store.bucket_of("id", 8)).collect()}
    assert set(store.add(some, 1)) == own  # the others' filters admit nothing
    assert store.add(rows(["c1", "c2"]), 2) == []
    for _ in range(2):  # run again: the same rows
        assert set(store.add(some, 1)) == own
    kept = store.read(spark)
    assert kept.count() == kept.select("id").distinct().count() == 44 and kept.filter("batch = 1").count() == 2
    assert {r["id"] for r in store.stored(rows(["a3", "x", "b1"]))[0].collect()} == {"a3", "b1"}
    assert store.stored(rows(["a3", "x", "b1"]), before=1)[0].count() == 1
    full = chunk_store.ChunkStore(str(tmp_path / "full"), buckets=2, bits=64, hashes=1)  # filters that admit nearly all: slower, not wrong
    full.add(rows([f"a{k}" for k in range(300)]), 0)
    assert full.add(rows(["a5", "n1"]), 1) and full.read(spark).count() == 301
    assert full.add(rows([]), 2) == [] and full.read(spark).count() == 301


def test_chunks_are_shuffled_once_to_their_buckets(spark, tmp_path):
    """texts were shuffled to their ids, to the stored ids and to their buckets."""
    store = chunk_store.ChunkStore(str(tmp_path / "store"), buckets=8, bits=1 << 14)
    text = F.expr("array_join(transform(sequence(1, 40), i -> sha2(concat(id, ' ', i), 256)), ' ')").alias("text")
    rows = spark.range(0, 3000, numPartitions=4).select(F.concat(F.lit("a"), "id").alias("id"), text)
    store.add(rows.filter("id < 'a11'"), 0)
    known = store.read(spark).count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        moved = shuffled(spark, lambda: store.add(rows.unionByName(rows.filter("id > 'a99'")), 1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert store.read(spark).count() == 3000 and store.read(spark).filter("batch = 1").count() == 3000 - known
    assert moved < 8_000_000  # texts: 7.8 MB, 4.2 MB and more of it compressed


def some_events(spark, path, rows):
    df = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(minutes=m), k, 90.0 if k == "hot" else 10.0, 5.0, 0.0, f"e{i}") for m, k, i in rows], "timestamp timestamp, kind string, cpu_usage double, memory_usage double, error_rate double, id string")
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_late_rows_change_windows(spark, tmp_path):
    """Rows within the watermark are counted in their window, later ones are dropped, in counts and in rolling health."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = some_events(spark, path, [(10, "a", 1), (70, "a", 2), (130, "b", 3)])
    run = lambda f, at, key: jobs.run_available(jobs.windows_kept(f(spark.readStream.schema(df.schema).parquet(path)), at, at + "-cp"))
    count, rolling = lambda s: jobs.counts(s, "kind"), jobs.rolling_health
    got = lambda: {(r["start"].hour, r["kind"]): r["n"] for r in jobs.last_windows(spark, out, ["start", "kind"]).collect()}
    run(count, out, None)
    run(rolling, out + "2", None)
    assert got() == {(0, "a"): 1, (1, "a"): 1, (2, "b"): 1}
    some_events(spark, path, [(100, "a", 4), (5, "a", 5), (150, "hot", 6), (150, "hot", 7), (150, "hot", 8)])  # the watermark is at minute 70
    run(count, out, None)
    run(rolling, out + "2", None)
    assert got() == {(0, "a"): 1, (1, "a"): 2, (2, "b"): 1, (2, "hot"): 3}
    health = {r["until"]: (round(r["cpu"], 6), r["status"]) for r in jobs.last_windows(spark, out + "2", ["until"]).collect()}
    first, last = datetime(2024, 1, 1, 3), datetime(2024, 1, 2, 2)
    assert health[first] == (round((4 * 10 + 10 + 3 * 90) / 8, 6), "healthy") and health[last] == (round((10 + 3 * 90) / 4, 6), "healthy")
    assert len(health) == 26


def test_repeated_ids_within_and_beyond_the_watermark(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = some_events(spark, path, [(0, "a", 1), (1, "b", 1), (2, "a", 2)])
    for more in ([], [(30, "c", 1), (300, "a", 3)], [(310, "d", 1), (311, "e", 3)]):
        if more:
            some_events(spark, path, more)
        stream = jobs.once(spark.readStream.schema(df.schema).parquet(path))
        finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp"))
    rows = sorted((r["id"], r["kind"]) for r in spark.read.parquet(out).collect())
    assert [i for i, _ in rows] == ["e1", "e1", "e2", "e3"] and rows[1] == ("e1", "d")  # minute 30 repeats, minute 310 is a new row
