from pyspark.sql import functions as F

from corvane.streaming import state, windows

SF = "/root/testdata/sf0.001/events.parquet"


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    events = spark.read.parquet(SF).select("user_id", "ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), events


def test_hopping_windows_equal_batch(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    got = run(spark, windows.hopping_counts(stream, "24 hours", "12 hours"), "hop", "complete").select("start", "event_type", "n")
    want = windows.hopping_counts(events, "24 hours", "12 hours").select("start", "event_type", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_running_level(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    got = {r.user_id: (round(r.level, 6), r.n) for r in run(spark, windows.running_level(stream, 0.75), "lvl", "update").collect()}
    want = {}
    for r in sorted(events.collect(), key=lambda r: r.ts):
        level, n = want.get(r.user_id, (0.0, 0))
        want[r.user_id] = (0.75 * level + 0.25 * r.value, n + 1)
    assert got == {k: (round(v, 6), n) for k, (v, n) in want.items()}


def test_overlap_add_on_arrival(spark, tmp_path):
    rows = [(s, f"2024-01-01 00:{m:02d}:00", [1.0 * s + m] * 4) for s in (1, 2) for m in range(0, 6, 2)]
    df = spark.createDataFrame(rows, "signal_id long, ts string, x array<double>").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, state.overlap_add(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60), "ola", "complete").collect()
    want = {}
    for s, ts, x in rows:
        for i, v in enumerate(x):
            want.setdefault((s, int(ts[14:16]) + i), []).append(v)
    assert {(r.signal_id, r.at.minute): (r.total, r.cover) for r in got} == {k: (sum(v), len(v)) for k, v in want.items()}


def test_rolling_context_and_ends(spark, tmp_path):
    stream, events = source(spark, tmp_path)
    got = {r.key: (r.n, r.offset, round(r["mean"], 6)) for r in run(spark, state.rolling_context(stream.withColumnRenamed("user_id", "key"), 5), "ctx", "update").collect()}
    seen = {}
    for r in sorted(events.collect(), key=lambda r: r.ts):
        seen.setdefault(r.user_id, []).append(r.value)
    assert got == {k: (len(v[-5:]), len(v) - len(v[-5:]), round(sum(v[-5:]) / len(v[-5:]), 6)) for k, v in seen.items()}
    ended = run(spark, state.ending_streams(stream.select(F.col("user_id").alias("stream"), "ts", F.floor("value").cast("int").alias("token")), 40, 3), "ends", "update").collect()
    for r in ended:
        tokens = [int(v) for v in seen[r.stream]]
        stop = tokens.index(40) + 4 if 40 in tokens else None
        assert (r.tokens, r.done) == ((min(stop, len(tokens)), stop <= len(tokens)) if stop else (len(tokens), False))


def test_codebook_moves_with_each_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, [10 * (i % 2), 0]) for i in range(8)], "id long, vec array<bigint>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([(0, 1.0, [1.0, 1.0]), (1, 1.0, [9.0, 1.0])], "code long, size double, total array<double>")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = state.codebook_updates(stream, str(tmp_path / "book"), start, 0.5).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.code: r for r in spark.read.parquet(str(tmp_path / "book/batch=0")).collect()}
    assert got[0]["size"] == got[1]["size"] == 0.5 + 0.5 * 4 and list(got[1]["total"]) == [0.5 * 9 + 0.5 * 40, 0.5]
