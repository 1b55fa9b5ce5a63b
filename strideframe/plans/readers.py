"""Readers: the standard tables written as lines and records of each file layout, then parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.plans.registry import query
from strideframe.plans.tables import KEYPOINTS_CTE, LANDMARKS, OBSERVATIONS_CTE, OBSERVED_CTE, keypoints, observations, observed, table
from strideframe.sources import landmark_csv as LC
from strideframe.sources import tables as ST


def _lines(head, body):
    """Head lines of every file, and its frames after them."""
    return head.select("path", F.posexplode("texts").alias("line", "text")).unionByName(body.select("path", (F.col("frame") + F.size("texts")).alias("line"), "text"))


def kp3d_lines(spark, sf):
    """One ``<track>/data3D.csv`` a track; in every fifth the coordinate header is out of order."""
    k = observed(keypoints(spark, sf)).withColumn("path", F.concat(F.lit("rec/"), "track", F.lit("/data3D.csv")))
    cell = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("x", "y", "z", "conf")])
    body = k.groupBy("path", "track", "frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", cell.alias("c")))), lambda s: s["c"]), ",").alias("text"))
    names = ",".join(n for n in LANDMARKS for _ in range(4))
    coords = F.when(F.col("track") % 5 == 3, ",".join(["y", "x", "z", "confidence"] * len(LANDMARKS))).otherwise(",".join(["x", "y", "z", "confidence"] * len(LANDMARKS)))
    texts = F.array(F.lit(names), coords).alias("texts")
    return _lines(k.select("path", texts).distinct(), body.select("path", "frame", "text", texts))


@query(f"""WITH {OBSERVED_CTE} SELECT CAST(track AS VARCHAR) AS recording, frame, pos, kp, x, y, z, conf FROM obs WHERE track % 5 <> 3""")
def a1_kp3d_landmarks(spark, sf):
    kps, _ = LC.parse_kp3d(kp3d_lines(spark, sf), LC.folder_of())
    return kps


@query(f"""WITH {KEYPOINTS_CTE} SELECT DISTINCT CAST(track AS VARCHAR) AS recording, 'coordinate_order' AS code FROM kps WHERE track % 5 = 3""")
def a1_kp3d_headers(spark, sf):
    _, findings = LC.parse_kp3d(kp3d_lines(spark, sf), LC.folder_of())
    return findings


@query(f"""WITH {OBSERVATIONS_CTE} SELECT camera || '_' || CAST(track AS VARCHAR) AS recording, frame, pos AS kid, CASE WHEN conf >= 0.2 THEN round(u, 6) END AS u, CASE WHEN conf >= 0.2 THEN round(v, 6) END AS v FROM det""")
def a2_kp2d_points(spark, sf):
    o = observations(spark, sf).select(F.concat(F.lit("det/"), "camera", F.lit("_"), F.col("track"), F.lit(".csv")).alias("path"), "frame", "pos", "conf", "u", "v")
    far = F.lit("2000000")
    cell = F.concat_ws(",", "pos", *[F.when(F.col("conf") >= 0.2, F.col(c).cast("string")).otherwise(far) for c in "uv"])
    body = o.groupBy("path", "frame").agg(F.array_sort(F.collect_list(F.struct("pos", cell.alias("c")))).alias("cs"))
    texts = F.array(F.lit("skeleton.json")).alias("texts")
    body = body.select("path", "frame", F.concat_ws(",", "frame", F.array_join(F.transform("cs", lambda s: s["c"]), ",")).alias("text"), texts)
    got = LC.parse_kp2d(_lines(o.select("path", texts).distinct(), body))
    return got.select("recording", "frame", "kid", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("""WITH b AS (SELECT o_orderkey AS idx, o_custkey AS s, o_custkey + o_orderkey % 50 AS e, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 50 + 1 END AS given FROM orders)
SELECT idx, s AS start_frame, e AS end_frame, e - s + 1 AS n_frames, 'summary' AS source, given <> e - s + 1 AND given IS NOT NULL AS bad FROM b""")
def a3_bout_summary(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    given = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.lit(0)).otherwise(k % 50 + 1)
    raw = o.select(k.cast("string").alias("Bout_Idx"), F.col("o_custkey").cast("string").alias("Start_Frame"), (F.col("o_custkey") + k % 50).cast("string").alias("END_FRAME"), given.cast("string").alias(" n_frames"))
    bouts, bad = ST.parse_bout_summary(raw)
    return bouts.join(bad.select("idx", F.lit(True).alias("bad")), "idx", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))


@query("""SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, l_orderkey * 8 + l_linenumber AS id, l_orderkey AS image_id, 'rec' || CAST(any_value(o_custkey) AS VARCHAR) AS recording,
 round(sum(l_quantity), 6) AS first_x, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber""")
def a6_labelled_annotations(spark, sf):
    """One split file an order, with one image and an annotation for each of its lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    k = F.col("l_orderkey")
    ann = F.struct((k * 8 + F.col("l_linenumber")).alias("id"), k.alias("image_id"), F.array("q").alias("keypoints"), F.col("n").cast("int").alias("num_keypoints"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    files = lines.groupBy("l_orderkey").agg(F.collect_list(ann).alias("annotations")).join(orders, "l_orderkey")
    image = F.struct(k.alias("id"), F.concat(F.lit("rec"), "o_custkey").alias("recording"))
    texts = files.select(F.when(k % 10 == 0, "val").otherwise("train").alias("split"), F.to_json(F.struct(F.array(image).alias("images"), "annotations")).alias("text"))
    t = ST.parse_instances(texts)
    images = t["images"].select("split", F.col("id").alias("image_id"), "recording")
    a = t["annotations"].select("split", "id", "image_id", F.round(F.element_at("keypoints", 1), 6).alias("first_x"), F.col("num_keypoints").alias("n"))
    return a.join(images, ["split", "image_id"]).select("split", "id", "image_id", "recording", "first_x", "n")


@query("""SELECT 's' || CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 6 = 0 THEN 'odd' WHEN c_custkey % 6 = 1 THEN NULL WHEN c_custkey % 2 = 0 THEN 'human' ELSE 'pseudo' END AS kind,
 CASE WHEN c_custkey % 6 < 2 THEN NULL WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_custkey / 4.0 END AS weight, c_custkey % 6 >= 2 AS valid FROM customer""")
def a7_manifest_sources(spark, sf):
    """One manifest a customer."""
    k = F.col("c_custkey")
    kind = F.when(k % 6 == 0, "odd").when(k % 6 == 1, F.lit(None)).when(k % 2 == 0, "human").otherwise("pseudo")
    v = F.struct(kind.alias("kind"), F.when(k % 3 != 0, k / 4).alias("weight"))
    m = ST.parse_manifest(table(spark, sf, "customer").select(F.to_json(F.struct(F.create_map(F.concat(F.lit("s"), k), v).alias("sources"))).alias("text")))
    bad = m["invalid"].select("source_id", "kind", F.lit(None).cast("double").alias("weight"), F.lit(False).alias("valid"))
    return m["sources"].select("source_id", "kind", "weight", F.lit(True).alias("valid")).unionByName(bad)


@query("""WITH f AS (SELECT 'g' || CAST(c_nationkey AS VARCHAR) AS calib_group, 'Cam' || CAST(c_custkey AS VARCHAR) AS camera, c_custkey AS k, c_acctbal AS b FROM customer)
SELECT calib_group, camera, CASE WHEN k % 5 = 0 THEN 'calibration_unreadable' END AS code, CASE WHEN k % 5 <> 0 THEN round(b, 6) END AS p1, CASE WHEN k % 5 <> 0 THEN round(k * 0.001, 6) END AS p12 FROM f""")
def a8_calibration_files(spark, sf):
    k = F.col("c_custkey")
    first = [F.col("c_acctbal").cast("string")] + [F.lit(f"{i}.5e0") for i in range(10)]
    data = F.when(k % 5 == 0, F.lit("1, 2.")).otherwise(F.concat_ws(",\n ", *first, (k * 0.001).cast("double").cast("string")))
    text = F.concat(F.lit("%YAML:1.0\nintrinsicMatrix: {data: [9, 9]}\nprojectionMatrix: !!opencv-matrix\n  rows: 3\n  cols: 4\n  data: [ "), data, F.lit(" ]\n"))
    path = F.concat(F.lit("calib/g"), "c_nationkey", F.lit("/Cam"), k, F.lit(".yaml"))
    ok, bad = ST.parse_calibrations(table(spark, sf, "customer").select(path.alias("path"), text.alias("text")))
    none = F.lit(None).cast("double")
    good = ok.select("calib_group", "camera", F.lit(None).cast("string").alias("code"), F.round(F.element_at("p", 1), 6).alias("p1"), F.round(F.element_at("p", 12), 6).alias("p12"))
    return good.unionByName(bad.select("calib_group", "camera", "code", none.alias("p1"), none.alias("p12")))


@query("""WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END AS sex, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS recording, coalesce(sex, 'unknown') AS sex FROM customer LEFT JOIN o ON o_custkey = c_custkey AND r = 1""")
def a10_cohort_sex(spark, sf):
    """Orders as index rows: the customer names the recording, the status gives the label or none."""
    name = F.concat(F.lit("c"), "o_custkey")
    raw = table(spark, sf, "orders").select("o_orderkey", name.alias("_c0"), F.when(F.col("o_orderstatus") == "F", " F ").when(F.col("o_orderstatus") == "O", "Male").otherwise("?").alias("Sex"))
    recordings = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("recording"))
    return ST.sex_of_first_row(raw, F.col("o_orderkey"), ["_c0", "Sex"], recordings)
