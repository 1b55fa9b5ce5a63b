"""Join, selection and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import joins as J
from strideframe.operators import select as P
from strideframe.operators.ordered import BLOCK, number_rows
from strideframe.plans.registry import query
from strideframe.plans.series import gate_bouts
from strideframe.plans.tables import TRACKS_CTE, table, tracks

# Block length of the ordered operators; tests shrink it so that tracks span several blocks.
BLK = BLOCK
KF = ["track", "frame"]
_BOUTS = f"""{TRACKS_CTE}, hit AS (SELECT track, frame, lag(frame) OVER (PARTITION BY track ORDER BY frame) AS prev FROM t WHERE conf >= 0.5),
 m AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame - prev - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS run FROM hit),
 b AS (SELECT track, run, min(frame) AS start_frame, max(frame) AS end_frame, max(frame) - min(frame) + 1 AS n_frames FROM m GROUP BY track, run),
 bouts AS (SELECT track, start_frame, end_frame, n_frames, row_number() OVER (PARTITION BY track ORDER BY run) AS bout FROM b WHERE n_frames >= 3)"""


@query(f"WITH {_BOUTS} SELECT t.track, t.frame, bout, frame - start_frame AS local_frame, v FROM t JOIN bouts ON bouts.track = t.track AND frame BETWEEN start_frame AND end_frame")
def e1_interval_join(spark, sf):
    j = J.interval_join(tracks(spark, sf), gate_bouts(spark, sf), ["track"], "frame", "start_frame", "end_frame", width=16)
    return j.select("track", "frame", "bout", (F.col("frame") - F.col("start_frame")).alias("local_frame"), "v")


@query(f"""WITH {TRACKS_CTE}, p AS (SELECT track, frame, event_id FROM t WHERE label = 'purchase'), s AS (SELECT track, frame AS sample_at, v FROM t WHERE conf >= 0.8),
 r AS (SELECT p.*, sample_at, v, row_number() OVER (PARTITION BY p.track, p.frame ORDER BY abs(sample_at - frame), sample_at) AS rn FROM p JOIN s ON s.track = p.track AND abs(sample_at - frame) <= 3)
SELECT p.track, p.frame, p.event_id, sample_at, v FROM p LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (track, frame)""")
def e3_nearest_sample(spark, sf):
    t = tracks(spark, sf)
    probes = t.where(F.col("label") == "purchase").select("track", "frame", "event_id")
    return J.nearest_sample(probes, t.where(F.col("conf") >= 0.8).select("track", "frame", "v"), ["track"], "frame", ["v"], tolerance=F.lit(3), size=BLK)


@query(f"""WITH {TRACKS_CTE} SELECT track AS camera, frame AS slot, CASE WHEN track % 3 = 0 THEN frame WHEN conf >= 0.2 THEN frame * 2 ELSE -1 END AS position FROM t
WHERE track % 3 = 0 OR track IN (SELECT track FROM t WHERE conf >= 0.2)""")
def e4_slot_positions(spark, sf):
    t = tracks(spark, sf)
    plan = t.where((F.col("track") % 3 != 0) & (F.col("conf") >= 0.2)).select(F.col("track").alias("camera"), F.col("frame").alias("slot"), (F.col("frame") * 2).alias("position"))
    return J.map_positions(t.select(F.col("track").alias("camera"), F.col("frame").alias("slot")), plan)


@query(f"WITH {TRACKS_CTE} SELECT a.track // 2 AS bout, a.frame, a.v AS v_0, b.v AS v_1 FROM t a JOIN t b ON b.track = a.track + 1 AND b.frame = a.frame WHERE a.track % 2 = 0")
def e5_pair_join(spark, sf):
    t = tracks(spark, sf).select(F.floor(F.col("track") / 2).alias("bout"), (F.col("track") % 2).alias("fly"), "frame", "v")
    return J.pair_rows(t, ["bout", "frame"], "fly", ["v"])


@query(f"""WITH {TRACKS_CTE}, l AS (SELECT track, frame, label, lead(label) OVER (PARTITION BY track ORDER BY frame) AS nxt FROM t)
SELECT track, frame AS first, frame + 1 AS second FROM l WHERE label = 'click' AND nxt = 'view'""")
def e5_consecutive_pairs(spark, sf):
    return J.consecutive_pairs(tracks(spark, sf), ["track"], "frame", "label", "click", "view", size=BLK)


@query(f"WITH {TRACKS_CTE} SELECT track, frame FROM t a WHERE track % 2 = 1 AND conf >= 0.5 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.track = a.track - 1 AND b.frame = a.frame AND b.conf >= 0.5)")
def e6_unpaired_rows(spark, sf):
    t = tracks(spark, sf).where(F.col("conf") >= 0.5).withColumn("bout", F.floor(F.col("track") / 2))
    lone = J.unpaired(t.where(F.col("track") % 2 == 1), t.where(F.col("track") % 2 == 0), ["bout", "frame"])
    return lone.select("track", "frame")


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def e7_keyed_merge(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return J.one_to_one(li, o, ["l_orderkey"])[0]


@query("SELECT l_orderkey, l_linenumber, 'left' AS side, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def e7_duplicate_keys(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    right = J.dealt(li, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return J.one_to_one(li, right, ["l_orderkey", "l_linenumber"])[1]


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def e9_missing_work(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    done = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.missing_work(o, done, ["o_orderkey"])


@query(f"""WITH {_BOUTS}, clips AS (SELECT track, frame AS clip, CAST(floor(v / 4) AS BIGINT) + 3 AS clip_len FROM t WHERE label = 'view')
SELECT c.track, c.clip, c.clip_len, count(b.bout) AS n_matches, CASE WHEN count(b.bout) = 1 THEN min(b.bout) END AS bout FROM clips c LEFT JOIN bouts b ON b.track = c.track AND abs(b.n_frames - c.clip_len) <= 1 GROUP BY ALL""")
def e13_band_match(spark, sf):
    clips = tracks(spark, sf).where(F.col("label") == "view").select("track", F.col("frame").alias("clip"), (F.floor(F.col("v") / 4) + 3).alias("clip_len"))
    return J.match_length(clips, gate_bouts(spark, sf), ["track"])


@query(f"""WITH {TRACKS_CTE}, s AS (SELECT DISTINCT track, frame FROM t WHERE conf >= 0.3)
SELECT a.track, a.frame FROM s a JOIN s b ON b.track = a.track AND b.frame = a.frame + 2 JOIN s c ON c.track = a.track AND c.frame = a.frame + 4""")
def e14_offset_windows(spark, sf):
    return J.offset_windows(tracks(spark, sf).where(F.col("conf") >= 0.3), ["track"], "frame", 3, 2)


@query(f"""WITH {TRACKS_CTE}, f AS (SELECT track, max(frame) + 1 AS len, arg_max(v, frame) - arg_min(v, frame) AS dv, count(*) FILTER (label = 'click') AS n FROM t GROUP BY track),
 s AS (SELECT track, n, sign(dv) AS sg FROM f), r AS (SELECT a.track, a.n, b.track AS cand, row_number() OVER (PARTITION BY a.track ORDER BY a.sg <> b.sg, b.n < a.n, abs(b.n - a.n), b.track) AS rn
 FROM s a, s b WHERE a.track % 2 = 0 AND b.track % 2 = 1 AND b.n > 0)
SELECT track AS id, n, cand AS match FROM r WHERE rn = 1""")
def e23_closest_reference(spark, sf):
    t = tracks(spark, sf)
    s = t.groupBy(F.col("track").alias("id")).agg(F.count_if(F.col("label") == "click").alias("n"), F.signum(F.max_by("v", "frame") - F.min_by("v", "frame")).alias("sign"))
    return J.closest_reference(s.where(F.col("id") % 2 == 0), s.where(F.col("id") % 2 == 1)).select("id", "n", "match")


_FR = f"""{TRACKS_CTE}, fr AS (SELECT track, frame, label <> 'error' AS finite, conf AS min_conf, CASE WHEN event_id % 11 <> 0 THEN v END AS scale FROM t)"""


def gated(spark, sf):
    f = tracks(spark, sf).select("track", "frame", (F.col("label") != "error").alias("finite"), F.col("conf").alias("min_conf"), F.when(F.col("event_id") % 11 != 0, F.col("v")).alias("scale"))
    return P.gate_frames(f, min_conf=0.6, mad_k=1.0)


_GT = f"""{_FR}, c AS (SELECT *, CASE WHEN NOT finite THEN 'nonfinite' WHEN min_conf < 0.6 THEN 'low_conf' END AS g0 FROM fr), md AS (SELECT median(scale) AS m FROM c WHERE g0 IS NULL),
 ad AS (SELECT median(abs(scale - m)) AS d FROM c, md WHERE g0 IS NULL),
 g AS (SELECT c.*, coalesce(g0, CASE WHEN scale IS NULL THEN 'scale_unknown' WHEN d > 0 AND abs(scale - m) > 1.4826 * d THEN 'scale_outlier' END) AS gate FROM c, md, ad)"""


@query(f"WITH {_GT} SELECT track, coalesce(gate, 'candidate') AS gate, count(*) AS n FROM g GROUP BY ALL")
def h1_sample_gates(spark, sf):
    return gated(spark, sf).groupBy("track", F.coalesce("gate", F.lit("candidate")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_GT}, r AS (SELECT track, frame, row_number() OVER (PARTITION BY track ORDER BY min_conf DESC, frame) AS rank FROM g WHERE gate IS NULL)
SELECT track, frame, rank FROM r ORDER BY rank, track LIMIT 400""")
def h1_stratified_sample(spark, sf):
    return P.round_robin_sample(gated(spark, sf).where(F.col("gate").isNull()), "track", "frame", "min_conf", 400).select("track", "frame", "rank")


@query("SELECT p.p_partkey, CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS pos, p_retailprice FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l_quantity >= 49")
def h2_ordered_selection(spark, sf):
    ids = table(spark, sf, "lineitem").where(F.col("l_quantity") >= 49).select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    rows, _ = P.pick_by_ids(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ids, "p_partkey")
    return rows.select("p_partkey", "pos", "p_retailprice")


@query("""SELECT o_orderstatus, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""")
def h3_worst_per_group(spark, sf):
    return P.worst_per_group(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"], 5).select("o_orderstatus", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY CAST(regexp_extract('bout_' || s_suppkey, '([0-9]+)$', 1) AS BIGINT)) AS pos FROM supplier""")
def h5_natural_order(spark, sf):
    from strideframe.functions.names import natural_key

    s = table(spark, sf, "supplier").select("s_suppkey", natural_key(F.concat(F.lit("bout_"), "s_suppkey")).alias("n"))
    # The number is the order, so its rank comes from blocks of the number.
    d = number_rows(s.withColumn("k", F.lit(0)), ["k"], ["n"], F.floor(F.col("n") / 64), name="pos")
    return d.select("s_suppkey", (F.col("pos") + 1).alias("pos"))


@query("""SELECT s_suppkey AS id, s_acctbal AS bal, NULL AS segment, 'supplier' AS run FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'customer' FROM customer""")
def i2_session_pooling(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.lit("supplier").alias("run"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("run"))
    return P.pool([a, b]).select("id", "bal", "segment", "run")


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25")
def i3_set_difference(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("id"))
    return a.distinct().join(li.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25)).select(F.col("l_partkey").alias("id")).distinct(), "id", "left_anti")


@query(f"""WITH {TRACKS_CTE}, c AS (SELECT track, frame // 10 AS chunk, frame, v FROM t UNION ALL SELECT track, frame // 10 - 1, frame, -v FROM t WHERE frame % 10 < 3 AND frame >= 10)
SELECT track, frame, arg_min(v, chunk) AS v FROM c GROUP BY track, frame""")
def i5_track_concatenation(spark, sf):
    t = tracks(spark, sf)
    c = F.floor(F.col("frame") / 10)
    a = t.select("track", "frame", c.alias("chunk"), "v")
    b = t.where((F.col("frame") % 10 < 3) & (F.col("frame") >= 10)).select("track", "frame", (c - 1).alias("chunk"), (-F.col("v")).alias("v"))
    return P.concat_chunks(a.unionByName(b), KF, "chunk")
