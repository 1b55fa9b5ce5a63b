"""Streams replayed from files against their batch twins."""

from pyspark.sql import functions as F

from strideframe.operators.motion import carried_positions
from strideframe.operators.runs import bridged_runs
from strideframe.sources import sinks
from strideframe.streaming.bouts import live_bouts
from strideframe.streaming.ingest import finished, ingest, key_bucket
from strideframe.streaming.track_state import STORE, live_track_state


def write_parts(df, path, order, n):
    """Files in frame order, one batch each."""
    top = df.agg(F.max(order)).first()[0] + 1
    for i in range(n):
        lo, hi = top * i // n, top * (i + 1) // n
        df.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(path)


def test_live_bouts_equal_batch_segmentation(spark, tmp_path):
    d = spark.range(400).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("f"), (F.xxhash64("id") % 10 < 3).alias("on"))
    want = sorted(map(tuple, bridged_runs(d, ["k"], "f", "on").select("k", "start_frame", "end_frame", "n_frames").collect()))
    src = str(tmp_path / "in")
    write_parts(d, src, "f", 3)
    # A last far event moves the watermark past every open bout.
    spark.createDataFrame([(0, 10**6, True), (1, 10**6, True)], "k long, f long, on boolean").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("k long, f long, on boolean").option("maxFilesPerTrigger", 1).parquet(src)
    q = live_bouts(s, ["k"], "f", "on", fps=800.0, lateness="1 second").writeStream.format("memory").queryName("bouts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bouts").collect())) == want


def test_live_track_state_equals_batch_over_restarts_and_expiry(spark, tmp_path):
    """Three runs over one checkpoint; gaps longer than ``keep`` read as never seen, and their state is gone."""
    far = F.when(F.col("id") >= 90, 400).otherwise(0)
    d = spark.range(120).select(
        F.concat(F.lit("r"), F.col("id") % 2).alias("recording"), F.lit(0).alias("fly"), (F.floor(F.col("id") / 2) + far).alias("frame"),
        F.when(F.xxhash64("id") % 10 < 3, F.col("id") * 1.5).alias("pos"),
    )
    want = carried_positions(d, ["recording", "fly"], "frame", "pos", max_reuse=3)
    want = want.withColumn("age", F.when(F.col("age") < 20, F.col("age")))
    want = sorted(map(tuple, want.select("recording", "fly", "frame", "age", "carried", "source").collect()), key=repr)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = []
    for lo, hi in ((0, 20), (20, 45), (45, 10_000)):
        write_parts(d.where(f"frame >= {lo} and frame < {hi}").withColumn("frame", F.col("frame")), src, "frame", 1)
        s = spark.readStream.schema("recording string, fly int, frame long, pos double").option("maxFilesPerTrigger", 1).parquet(src)
        q = live_track_state(s, fps=800.0, max_reuse=3, keep=20, lateness="50 milliseconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=repr) == want
    assert rows[-1] is not None and rows[-1] <= 12  # a value and its timers for each of two animals


def test_ingest_resumes_and_skips_finished_keys(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "bout int, v double"
    spark.createDataFrame([(1, 1.0), (2, 2.0)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest(spark, src, schema, out, ck, ["bout"])
    spark.createDataFrame([(2, 9.0), (3, 3.0), (3, 2.5)], schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest(spark, src, schema, out, ck, ["bout"])
    assert sorted((r.bout, r.v) for r in spark.read.parquet(f"{out}/rows").collect()) == [(1, 1.0), (2, 2.0), (3, 2.5)]


def test_ingest_takes_work_whole_and_reads_its_buckets_only(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "bout int, frame int, v double"
    first = [(b, f, float(b + f)) for b in range(20) for f in range(3)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    ingest(spark, src, schema, out, ck, ["bout"], row_keys=["frame"], buckets=16)
    spark.createDataFrame([(3, 9, 0.0), (50, 1, 1.0), (50, 2, 2.0)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest(spark, src, schema, out, ck, ["bout"], row_keys=["frame"], buckets=16)
    assert sorted((r.bout, r.frame, r.v) for r in spark.read.parquet(f"{out}/rows").collect()) == sorted([*first, (50, 1, 1.0), (50, 2, 2.0)])
    b = spark.createDataFrame([(3,)], "bout int").select(key_bucket(["bout"], 16).alias("b")).first().b
    files = finished(spark, out, ["bout"], [b]).inputFiles()
    assert files and all(f"/bucket={b}/" in f for f in files)
    assert finished(spark, out, ["bout"], [b]).where("bout = 3").count() == 1


def test_a_long_clip_spans_chunks(spark):
    rows = [("a", 10 * i, float(i)) for i in range(25)] + [("b", i, None if i == 1 else 1.0) for i in range(4)]
    c = sinks.clip_chunks(spark.createDataFrame(rows, "clip string, f long, v double"), ["clip"], "f", ["v"], chunk=8)
    got = {(r.clip, r.chunk): (r.clip_length, r.n, list(r.v)) for r in c.collect()}
    assert got == {("a", k): (25, min(8, 25 - 8 * k), [float(i) for i in range(8 * k, min(8 * k + 8, 25))]) for k in range(4)} | {("b", 0): (4, 4, [1.0, None, 1.0, 1.0])}
    p = {(r.clip, r.chunk): (r.n, len(r.v), sum(x or 0 for x in r.v)) for r in sinks.padded_chunks(c, ["clip"], ["v"], chunk=8).collect()}
    assert p["b", 0] == (4, 8, 3.0) and p["b", 2] == (0, 8, 0.0) and p["b", 3] == (0, 1, 0.0) and p["a", 3] == (1, 1, 24.0) and len(p) == 8


def test_track_state_asks_the_store_little():
    """One read, one update and one timer exchanged for an animal and a batch, and the state before each row."""
    import pandas as pd

    from strideframe.streaming.track_state import TrackState

    calls, kept, timers = [], {}, set()

    class Store:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, v):
            calls.append("update")
            kept["v"] = v

        def deleteTimer(self, at):
            calls.append("delete")
            timers.remove(at)

        def registerTimer(self, at):
            calls.append("register")
            timers.add(at)

    t = TrackState(800.0, 2, 4)
    t.init(Store())
    batch = lambda f, p: [pd.DataFrame({"frame": f, "pos": p})]
    (a,) = t.handleInputRows(("r", 0), iter(batch([2, 0, 1], [None, 5.0, 6.0])), None)
    (b,) = t.handleInputRows(("r", 0), iter(batch([3, 4, 5, 6, 7], [None, None, None, 9.0, None])), None)
    plain = lambda d, c: [None if pd.isna(v) else v for v in d[c]]
    assert plain(a, "age") == [None, 0, 0] and plain(a, "carried") == [None, 5.0, 6.0] and plain(a, "source") == [None, "track", "track"]
    assert plain(b, "age") == [1, 2, 3, None, 0] and plain(b, "carried") == [6.0, None, None, None, 9.0] and plain(b, "source") == ["reused", None, None, None, "track"]
    assert calls == ["get", "update", "register", "get", "update", "delete", "register"]
    assert kept["v"] == (6, 9.0) and len(timers) == 1
