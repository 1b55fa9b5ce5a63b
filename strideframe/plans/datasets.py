"""Written data sets and the batch twins of the streaming operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from strideframe.operators.runs import bridged_runs
from strideframe.plans.registry import query
from strideframe.plans.series import _BOUTS
from strideframe.plans.tables import TRACKS_CTE, table, tracks
from strideframe.session import cut_lineage, shared_folder
from strideframe.sources import sinks
from strideframe.sources import tables as sources
from strideframe.streaming.bouts import live_bouts
from strideframe.streaming.ingest import ingest
from strideframe.streaming.track_state import STORE, live_track_state


@query(f"""WITH {TRACKS_CTE}, c AS (SELECT track, list(CAST(v AS FLOAT) ORDER BY frame) AS a, count(*) AS n FROM t GROUP BY track), m AS (SELECT max(n) AS tm FROM c)
SELECT track, n AS clip_length, i AS pos, round(CAST(CASE WHEN i < n THEN a[i + 1] ELSE 0 END AS DOUBLE), 3) AS v FROM c, m, (SELECT unnest(range(10000)) AS i) WHERE i < tm""")
def a11_padded_clips(spark, sf):
    clips = sinks.padded_clips(sinks.clip_arrays(tracks(spark, sf), ["track"], "frame", ["v"]), ["v"])
    return clips.select("track", "clip_length", F.posexplode("v").alias("pos", "x")).select("track", "clip_length", "pos", F.round(F.col("x").cast("double"), 3).alias("v"))


# Clips of about 66 frames in chunks of 16.
@query(f"""WITH {TRACKS_CTE}, c AS (SELECT track, count(*) AS n FROM t GROUP BY track), m AS (SELECT max(n) AS tm FROM c), g AS (SELECT track, n, unnest(range(tm)) AS i FROM c, m)
SELECT g.track, i // 16 AS chunk, n AS clip_length, CAST(least(greatest(n - i // 16 * 16, 0), 16) AS BIGINT) AS n, i % 16 AS pos, round(coalesce(CAST(CAST(v AS FLOAT) AS DOUBLE), 0), 3) AS v FROM g LEFT JOIN t ON t.track = g.track AND t.frame = g.i""")
def a11_chunked_clips(spark, sf):
    c = sinks.padded_chunks(sinks.clip_chunks(tracks(spark, sf), ["track"], "frame", ["v"], chunk=16), ["track"], ["v"], chunk=16)
    return c.select("track", "chunk", "clip_length", "n", F.posexplode("v").alias("pos", "x")).select("track", "chunk", "clip_length", "n", "pos", F.round(F.col("x").cast("double"), 3).alias("v"))


def _ranges(spark, sf, parts: int) -> tuple[str, str, list[Callable[[], None]]]:
    """A new folder of the shared place, its folder of files to come, and what writes the tracks there, one frame range a call."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    t = tracks(spark, sf).select(F.col("track").cast("string").alias("recording"), F.lit(0).alias("fly"), "frame", F.when(F.col("conf") >= 0.7, F.col("v")).alias("pos"))
    t = cut_lineage(t.withColumn("_p", F.floor(F.col("frame") / 16)))
    ranges = [t.where(F.col("_p") >= p if p == parts - 1 else F.col("_p") == p).drop("_p") for p in range(parts)]
    return folder, f"{folder}/in", [lambda d=d: d.write.mode("append").parquet(f"{folder}/in") for d in ranges]


def _arriving(spark, sf, parts: int) -> tuple[str, str]:
    """The tracks as files of one frame range each, in a new folder of the shared place, and the folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    t = tracks(spark, sf).select(F.col("track").cast("string").alias("recording"), F.lit(0).alias("fly"), "frame", F.when(F.col("conf") >= 0.7, F.col("v")).alias("pos"))
    t = cut_lineage(t.withColumn("_p", F.floor(F.col("frame") / 16)))
    for p in range(parts):
        last = p == parts - 1
        d = t.where(F.col("_p") >= p if last else F.col("_p") == p).drop("_p")
        d.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder, f"{folder}/in"


@query(f"""WITH {TRACKS_CTE}, l AS (SELECT *, max(CASE WHEN conf >= 0.7 THEN frame END) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM t),
 a AS (SELECT track, frame, lf, CASE WHEN frame - lf - 1 < 12 THEN frame - lf - 1 END AS age FROM l)
SELECT CAST(a.track AS VARCHAR) AS recording, 0 AS fly, a.frame, age, CASE WHEN age < 4 THEN g.v END AS carried, CASE WHEN age = 0 THEN 'track' WHEN age < 4 THEN 'reused' END AS source FROM a LEFT JOIN t g ON g.track = a.track AND g.frame = a.lf""")
def s2_live_track_state(spark, sf):
    """A replay: one batch for each range of frames, state and timers between them."""
    folder, source, arrivals = _ranges(spark, sf, 5)
    schema = "recording string, fly int, frame long, pos double"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, STORE)
    try:
        for arrive in arrivals:
            arrive()
            s = spark.readStream.schema(schema).parquet(source)
            out = live_track_state(s, fps=800.0, max_reuse=4, keep=12, lateness="100 milliseconds")
            q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/out")


@query(f"""WITH {TRACKS_CTE} SELECT CAST(track AS VARCHAR) AS recording, frame // 16 AS part, count(*) AS n, round(sum(CASE WHEN conf >= 0.7 THEN v END), 6) AS total FROM t WHERE frame < 64 GROUP BY ALL
UNION ALL SELECT CAST(track AS VARCHAR), 4, count(*), round(sum(CASE WHEN conf >= 0.7 THEN v END), 6) FROM t WHERE frame >= 64 GROUP BY track""")
def s3_resumable_ingest(spark, sf):
    """Every file arrives twice, the second time with other values; finished work stays as it was."""
    folder, source = _arriving(spark, sf, 5)
    schema = "recording string, fly int, frame long, pos double"
    part = lambda d: d.withColumn("part", F.least(F.floor(F.col("frame") / 16), F.lit(4)))
    run = lambda: ingest(spark, source, schema, f"{folder}/out", f"{folder}/ck", ["recording", "part"], row_keys=["frame"], transform=part, max_files=2, buckets=8)
    run()
    again = spark.read.schema(schema).parquet(source).withColumn("pos", F.col("pos") + 1)
    cut_lineage(again).coalesce(1).write.mode("append").parquet(source)
    run()
    return spark.read.parquet(f"{folder}/out/rows").groupBy("recording", "part").agg(F.count("*").alias("n"), F.round(F.sum("pos"), 6).alias("total"))


@query("""WITH c AS (SELECT o_orderpriority || '/' || o_orderstatus AS fly_id, count(*) AS n_clips FROM orders GROUP BY 1)
SELECT fly_id, n_clips, CAST(sum(n_clips) OVER (ORDER BY fly_id) AS BIGINT) AS clip_stop, CAST(sum(n_clips) OVER (ORDER BY fly_id) - n_clips AS BIGINT) AS clip_start, split_part(fly_id, '/', 1) AS session FROM c""")
def a14_provenance_ranges(spark, sf):
    o = table(spark, sf, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("fly_id"))
    return sinks.clip_ranges(o, "fly_id")


@query(f"{_BOUTS} SELECT track, start_frame, end_frame, n_frames FROM bouts")
def s1_session_bouts(spark, sf):
    t = tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.5)
    return live_bouts(t, ["track"], "frame", "ok", fps=800.0, max_gap=2, min_duration=3)


@query(f"{_BOUTS} SELECT CAST(track * 1000 + bout AS INT) AS idx, start_frame, end_frame, n_frames, 'gates' AS source FROM bouts")
def a4_bout_table(spark, sf):
    """Written and read again."""
    b = bridged_runs(tracks(spark, sf).withColumn("ok", F.col("conf") >= 0.5), ["track"], "frame", "ok", min_duration=3, max_gap=2)
    path = f"{shared_folder(spark)}/bouts-{uuid.uuid4().hex}"
    sources.write_bouts(b.select((F.col("track") * 1000 + F.col("bout")).cast("int").alias("idx"), "start_frame", "end_frame", "n_frames", F.lit("gates").alias("source")), path)
    return sources.read_bouts(spark, path)


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 2 AS fly, o_orderstatus, count(l_linenumber) AS n, avg(l_discount) AS m FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey AS bout, fly, CASE WHEN fly = 0 THEN 'female' ELSE 'male' END AS sex, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'excluded' END AS status, n AS n_frames, CASE WHEN o_orderstatus = 'F' THEN round(m, 6) END AS missing_fraction FROM r""")
def a12_scorecard_file(spark, sf):
    """Written and read again; columns that a row lacks read as null."""
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.select("o_orderkey", (F.col("o_custkey") % 2).alias("fly"), "o_orderstatus", "l_linenumber", "l_discount").groupBy(F.col("o_orderkey").alias("bout"), "fly", "o_orderstatus")
    done = F.col("o_orderstatus") == "F"
    rows = o.agg(F.count("l_linenumber").alias("n_frames"), F.avg("l_discount").alias("m")).select(
        "bout", "fly", F.when(F.col("fly") == 0, "female").otherwise("male").alias("sex"), F.when(done, "ok").otherwise("excluded").alias("status"), "n_frames", F.when(done, F.round("m", 6)).alias("missing_fraction")
    )
    path = f"{shared_folder(spark)}/scorecard-{uuid.uuid4().hex}"
    sinks.write_scorecard(rows, path)
    return spark.read.schema("bout long, fly long, sex string, status string, n_frames long, missing_fraction double").json(path)
