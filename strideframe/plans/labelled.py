"""Labelled-set queries: names and ids of merged sets, findings, export, evaluation, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import names as N
from strideframe.operators import curate as C
from strideframe.operators import evaluation as E
from strideframe.operators import geometry as G
from strideframe.operators import select as P
from strideframe.plans.registry import query
from strideframe.plans.statistics import _hash_sql
from strideframe.plans.tables import BONES, BONES_CTE, KEYPOINTS_CTE, TRACKS_CTE, keypoints, pairs_of_names, table, tracks

SPLITS = ["train", "val"]

# documents as images of a tier (source) and split (language).
IMG = """img AS (SELECT source AS tier, CASE WHEN lang IN ('en', 'de') THEN 'train' ELSE 'val' END AS split, doc_id AS id, n_chars,
  'rec' || (doc_id % 5) || '/Cam0' || (doc_id % 3) || '/Frame_' || (doc_id // 2) || '.jpg' AS file_name FROM documents),
 ann AS (SELECT tier, split, id * 4 + k AS id, id AS image_id, k, n_chars FROM img, (SELECT unnest(range(3)) AS k) WHERE k < n_chars % 4),
 fs AS (SELECT tier, split, 'rec' || (id // 12 % 5) || '/Frame_' || (id // 12) || '/fly0' AS key, 'rec' || (id // 12 % 5) AS recording, id // 12 AS seq, list(id ORDER BY id) AS frames,
   list(CASE WHEN n_chars % 4 > 0 THEN id * 4 END ORDER BY id) AS ann_ids, CASE WHEN min(n_chars) < 60 THEN -1 ELSE 0 END AS fly_id FROM img GROUP BY ALL),
 tiers AS (SELECT tier, row_number() OVER (ORDER BY tier) AS tier_pos FROM (SELECT DISTINCT tier FROM img)),
 sources AS (SELECT tier, CASE tier_pos % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'pseudo' WHEN 2 THEN 'negative' ELSE 'singlefly' END AS kind, CASE WHEN tier_pos % 3 > 0 THEN tier_pos / 4.0 END AS dw FROM tiers)"""


def images(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("source").alias("tier"), F.when(F.col("lang").isin("en", "de"), "train").otherwise("val").alias("split"), F.col("doc_id").alias("id"), "n_chars",
        F.concat(F.lit("rec"), F.col("doc_id") % 5, F.lit("/Cam0"), F.col("doc_id") % 3, F.lit("/Frame_"), F.floor(F.col("doc_id") / 2), F.lit(".jpg")).alias("file_name"),
    )


def annotations(spark, sf):
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    return images(spark, sf).select("tier", "split", F.col("id").alias("image_id"), "n_chars", k).where(F.col("k") < F.col("n_chars") % 4).withColumn("id", F.col("image_id") * 4 + F.col("k"))


def framesets(spark, sf):
    seq = F.floor(F.col("id") / 12)
    d = images(spark, sf).withColumn("seq", seq).withColumn("recording", F.concat(F.lit("rec"), seq % 5)).withColumn("key", F.concat("recording", F.lit("/Frame_"), seq, F.lit("/fly0")))
    g = d.groupBy("tier", "split", "key", "recording", "seq").agg(
        F.array_sort(F.collect_list(F.struct("id", F.when(F.col("n_chars") % 4 > 0, F.col("id") * 4).alias("a")))).alias("x"), F.when(F.min("n_chars") < 60, -1).otherwise(0).alias("fly_id")
    )
    return g.select("tier", "split", "key", "recording", "seq", F.transform("x", lambda s: s["id"]).alias("frames"), F.transform("x", lambda s: s["a"]).alias("ann_ids"), "fly_id")


def tier_table(spark, sf):
    from pyspark.sql import Window

    t = images(spark, sf).select("tier").distinct()
    return t.withColumn("tier_pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("tier")))


def source_table(spark, sf):
    p = F.col("tier_pos")
    kind = F.when(p % 4 == 0, "human").when(p % 4 == 1, "pseudo").when(p % 4 == 2, "negative").otherwise("singlefly")
    return tier_table(spark, sf).select("tier", kind.alias("kind"), F.when(p % 3 > 0, p / 4.0).alias("default_weight"))


_NEW = """imap AS (SELECT i.tier, split, id, row_number() OVER (ORDER BY split, tier_pos, id) AS new_id FROM img i JOIN tiers USING (tier)),
 amap AS (SELECT a.tier, split, id, row_number() OVER (ORDER BY split, tier_pos, id) AS new_id FROM ann a JOIN tiers USING (tier))"""


@query(f"WITH {IMG}, {_NEW} SELECT 'image' AS what, tier, split, id, new_id FROM imap UNION ALL SELECT 'annotation', tier, split, id, new_id FROM amap")
def i1_merged_ids(spark, sf):
    t = tier_table(spark, sf)
    a = C.dense_ids(images(spark, sf).select("tier", "split", "id"), t, SPLITS, "id").withColumn("what", F.lit("image"))
    b = C.dense_ids(annotations(spark, sf).select("tier", "split", "id"), t, SPLITS, "id").withColumn("what", F.lit("annotation"))
    return a.unionByName(b).select("what", "tier", "split", "id", "new_id")


@query(f"""WITH {IMG}, {_NEW}, x AS (SELECT fs.tier, fs.split, fs.key, unnest(range(len(frames))) AS p, frames, ann_ids FROM fs), m AS (SELECT x.tier, x.split, x.key, p, i.new_id AS ni, a.new_id AS na FROM x
  JOIN imap i ON i.tier = x.tier AND i.split = x.split AND i.id = frames[p + 1] LEFT JOIN amap a ON a.tier = x.tier AND a.split = x.split AND a.id = ann_ids[p + 1])
SELECT m.tier || '/' || m.key AS new_key, m.split, array_to_string(list(CAST(ni AS VARCHAR) ORDER BY p), ',') AS frames, array_to_string(list(coalesce(CAST(na AS VARCHAR), '-') ORDER BY p), ',') AS ann_ids,
 any_value(kind) AS source, round(any_value(coalesce(dw, 1.0)), 6) AS weight FROM m JOIN sources USING (tier) GROUP BY m.tier, m.split, m.key""")
def i1_merged_framesets(spark, sf):
    t = tier_table(spark, sf)
    im = C.dense_ids(images(spark, sf).select("tier", "split", "id"), t, SPLITS, "id")
    am = C.dense_ids(annotations(spark, sf).select("tier", "split", "id"), t, SPLITS, "id")
    fs = framesets(spark, sf).withColumn("source", F.lit(None).cast("string")).withColumn("weight", F.lit(None).cast("double"))
    m = C.remap_framesets(fs, im, am, source_table(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias(c)
    return m.select("new_key", "split", text("frames"), text("ann_ids"), "source", F.round("weight", 6).alias("weight"))


@query(f"""WITH {IMG}, {_NEW}, mk AS (SELECT tier, 'Frame_' || id AS stem, id * 4 + k AS ann_id FROM img, (SELECT unnest(range(2)) AS k)), ow AS (SELECT tier, 'Frame_' || id AS stem, split FROM img WHERE n_chars >= 100)
SELECT mk.tier, mk.stem, mk.ann_id, a.new_id AS new_ann FROM mk LEFT JOIN ow USING (tier, stem) LEFT JOIN amap a ON a.tier = mk.tier AND a.split = ow.split AND a.id = mk.ann_id""")
def e10_mask_remap(spark, sf):
    am = C.dense_ids(annotations(spark, sf).select("tier", "split", "id"), tier_table(spark, sf), SPLITS, "id")
    im = images(spark, sf).withColumn("stem", F.concat(F.lit("Frame_"), "id"))
    mk = im.select("tier", "stem", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("tier", "stem", (F.col("id") * 4 + F.col("k")).alias("ann_id"))
    return C.remap_masks(mk, im.where(F.col("n_chars") >= 100), am).select("tier", "stem", "ann_id", "new_ann")


@query(f"WITH {IMG} SELECT * FROM (SELECT tier, split, key, unnest(frames) AS image_id, unnest(ann_ids) AS ann_id FROM fs) WHERE ann_id IS NOT NULL")
def d17_resolved_slots(spark, sf):
    return C.resolved_slots(framesets(spark, sf), ["tier", "split", "key"])


# A root with gaps: short documents have no image row, long ones no annotation row.
_ROOT = f"""{IMG}, ri AS (SELECT * FROM img WHERE n_chars >= 80), ra AS (SELECT * FROM ann WHERE n_chars < 3000),
 rf AS (SELECT *, tier || ':' || split AS sp, tier || ':' || split || '/' || key AS sub FROM fs), u AS (SELECT sub, tier, split, unnest(frames) AS i, unnest(ann_ids) AS a FROM rf)"""


@query(f"""WITH {_ROOT} SELECT 'error' AS level, 'frameset_image_missing' AS code, sub AS subject, CAST(count(*) AS VARCHAR) AS detail FROM u WHERE NOT EXISTS (SELECT 1 FROM ri WHERE ri.tier = u.tier AND ri.split = u.split AND ri.id = u.i) GROUP BY sub
UNION ALL SELECT 'error', 'frameset_ann_missing', sub, CAST(count(*) AS VARCHAR) FROM u WHERE a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ra WHERE ra.tier = u.tier AND ra.split = u.split AND ra.id = u.a) GROUP BY sub
UNION ALL SELECT 'error', 'too_few_cameras', sub, CAST(len(list_filter(ann_ids, lambda e: e IS NOT NULL)) AS VARCHAR) FROM rf WHERE len(list_filter(ann_ids, lambda e: e IS NOT NULL)) < 3
UNION ALL SELECT 'error', 'negative_without_center3d', sub, '' FROM rf WHERE fly_id < 0
UNION ALL SELECT 'error', 'unknown_source_id', sub, tier FROM rf WHERE tier IN ('src3', 'src11')
UNION ALL SELECT 'error', 'frameset_calib_unresolvable', sub, '' FROM rf WHERE recording = 'rec4'""")
def e11_frameset_findings(spark, sf):
    sp = F.concat_ws(":", "tier", "split")
    fs = framesets(spark, sf).withColumn("split", sp).withColumn("source_id", F.col("tier")).withColumn("center3d", F.lit(None).cast("double")).withColumn("calib_group", F.lit(None).cast("string"))
    im = images(spark, sf).where(F.col("n_chars") >= 80).withColumn("split", sp)
    an = annotations(spark, sf).where(F.col("n_chars") < 3000).withColumn("split", sp)
    src = source_table(spark, sf).where(~F.col("tier").isin("src3", "src11")).select(F.col("tier").alias("source_id"))
    rec = framesets(spark, sf).select("recording").distinct().withColumn("rec_calib", F.when(F.col("recording") != "rec4", "A"))
    return C.frameset_findings(fs, im, an, src, rec)


_PROFILE = f"""{IMG}, per AS (SELECT i.split, i.tier, i.id, count(a.id) AS k FROM img i LEFT JOIN ann a ON a.image_id = i.id AND a.split = i.split GROUP BY ALL),
 fd AS (SELECT 'warning' AS level, 'duplicate_file_name' AS code, split || '/' || file_name AS subject, CAST(count(*) AS VARCHAR) AS detail FROM img GROUP BY split, file_name HAVING count(*) > 1
 UNION ALL SELECT 'info', 'zero_annotation_images', split, CAST(count(*) AS VARCHAR) FROM per WHERE k = 0 GROUP BY split
 UNION ALL SELECT 'info', 'two_fly_fraction', split, count(*) FILTER (k >= 2) || '/' || count(*) FROM per GROUP BY split
 UNION ALL SELECT 'error', 'image_missing', split || '/' || min(file_name), CAST(count(*) AS VARCHAR) FROM img WHERE file_name NOT IN (SELECT file_name FROM img WHERE n_chars >= 60) GROUP BY split)"""


def image_report(spark, sf):
    im = images(spark, sf)
    return C.image_findings(im, annotations(spark, sf), im.where(F.col("n_chars") >= 60).select("file_name").distinct())


@query(f"WITH {_PROFILE} SELECT * FROM fd")
def f41_dataset_profile(spark, sf):
    return image_report(spark, sf)


@query(f"WITH {_PROFILE} SELECT level, count(*) AS n FROM fd GROUP BY level")
def h4_findings_counts(spark, sf):
    return P.level_counts(image_report(spark, sf))


@query(f"WITH {_PROFILE} SELECT level, code, subject, detail, CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS level_rank FROM fd")
def h4_findings_order(spark, sf):
    return P.report_order(image_report(spark, sf))


@query(f"""WITH {IMG}, p AS (SELECT tier || ':' || split AS sp, frames, ann_ids, row_number() OVER (PARTITION BY tier, split ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY tier, split) AS n FROM fs),
 s AS (SELECT * FROM p WHERE pos % greatest(n // 200, 1) = 0 AND pos // greatest(n // 200, 1) < 200), u AS (SELECT sp, unnest(frames) AS i, unnest(ann_ids) AS a FROM s),
 mk AS (SELECT id AS i, id * 4 + n_chars % 2 AS a FROM img WHERE n_chars < 2000)
SELECT u.sp AS split, count(*) AS checked, count(*) FILTER (m.a IS NULL) AS unresolved FROM u JOIN (SELECT DISTINCT i FROM mk) f ON f.i = u.i LEFT JOIN mk m ON m.i = u.i AND m.a = u.a WHERE u.a IS NOT NULL GROUP BY u.sp""")
def e12_sampled_masks(spark, sf):
    fs = framesets(spark, sf).withColumn("split", F.concat_ws(":", "tier", "split"))
    s = C.evenly_spaced(fs, sample=200)
    mk = images(spark, sf).where(F.col("n_chars") < 2000).select(F.col("id").alias("image_id"), (F.col("id") * 4 + F.col("n_chars") % 2).alias("ann_id"))
    return C.unresolved_masks(C.resolved_slots(s, ["split"]), mk)


@query(f"""WITH {IMG}, k AS (SELECT fs.* FROM fs JOIN sources USING (tier) WHERE kind = 'human'), u AS (SELECT DISTINCT tier, split, unnest(frames) AS id FROM k)
SELECT d.source || '/' || d.doc_id AS name, sha256(d.text) AS sha256 FROM documents d JOIN u ON u.id = d.doc_id""")
def a13_tiered_export(spark, sf):
    src = source_table(spark, sf).select(F.col("tier").alias("source_id"), "kind")
    fs = framesets(spark, sf).withColumn("source_id", F.col("tier"))
    _, im = C.export_subset(fs, images(spark, sf), src, tier="human")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("name"), "text")
    return C.checksums(d.join(im.select("id"), "id"), "name", "text")


@query("""SELECT d.doc_id, coalesce(CASE WHEN n_chars % 5 = 0 THEN 'fs' END, CASE WHEN quality = 1 THEN 'rec' END, CASE WHEN lang = 'en' THEN 'root' END, 'default') AS field,
 coalesce(nullif(CASE n_chars % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'male' END, 'unknown'), CASE WHEN toxic = 1 THEN 'female' END, nullif(CASE WHEN quality = 1 THEN 'male' ELSE 'unknown' END, 'unknown'), 'unknown') AS sex
FROM documents d LEFT JOIN labels USING (doc_id)""")
def b3_b4_layered_fields(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    field = N.layered(F.when(F.col("n_chars") % 5 == 0, "fs"), F.when(F.col("quality") == 1, "rec"), F.when(F.col("lang") == "en", "root"), F.lit("default"))
    ann = F.when(F.col("n_chars") % 3 == 0, "unknown").when(F.col("n_chars") % 3 == 1, "male")
    rec = F.when(F.col("quality") == 1, "male").otherwise("unknown")
    return d.select("doc_id", field.alias("field"), N.sex_chain(ann, F.when(F.col("toxic") == 1, "female"), rec).alias("sex"))


_MAT = """mat AS (SELECT s_suppkey AS recording, 'Cam0' || c AS camera, list_transform(range(12), lambda k: CASE WHEN k IN (8, 9, 10) THEN 0.0 WHEN k = 11 THEN 1.0 ELSE (s_nationkey % 7 + c * 3 + k) / 7.0 END) AS p FROM supplier, (SELECT unnest(range(3)) AS c)),
 tx AS (SELECT recording, camera, list_transform(p, lambda v: CAST(round_even(v * 1000000, 0) / 1000000 AS VARCHAR)) AS p FROM mat),
 ln AS (SELECT recording, camera, '[' || array_to_string(list_transform([0, 4, 8], lambda r: '[' || array_to_string(p[r + 1:r + 4], ', ') || ']'), ', ') || ']' AS m FROM tx),
 pr AS (SELECT recording, substr(sha256('[' || string_agg(m, ', ' ORDER BY camera) || ']'), 1, 16) AS fingerprint FROM ln GROUP BY recording)"""


def calibrations(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("recording"), (F.col("s_nationkey") % 7).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    vals = [F.lit(0.0) if k in (8, 9, 10) else F.lit(1.0) if k == 11 else (F.col("m") + F.col("c") * 3 + k) / 7.0 for k in range(12)]
    return s.select("recording", F.concat(F.lit("Cam0"), "c").alias("camera"), F.array(*vals).alias("p"))


@query(f"WITH {_MAT} SELECT recording, fingerprint FROM pr")
def b9_calibration_fingerprint(spark, sf):
    return C.fingerprint(calibrations(spark, sf), ["recording"]).select("recording", "fingerprint")


@query(f"""WITH {_MAT}, g AS (SELECT fingerprint, count(*) AS n, min(recording) AS f FROM pr GROUP BY 1), r AS (SELECT fingerprint, chr(CAST(64 + row_number() OVER (ORDER BY n DESC, f) AS INT)) AS "group" FROM g) SELECT recording, "group" FROM pr JOIN r USING (fingerprint)""")
def f40_calibration_groups(spark, sf):
    return C.group_calibrations(C.fingerprint(calibrations(spark, sf), ["recording"]), "recording").select("recording", "group")


@query(f"""WITH {_MAT}, m AS (SELECT recording, camera, CASE WHEN recording % 9 = 0 THEN 0.5 ELSE 0 END AS r2 FROM mat WHERE NOT (recording % 10 = 0 AND camera = 'Cam02'))
SELECT 'error' AS level, 'calibration_not_affine' AS code, recording || '/' || camera AS subject, '' AS detail FROM m WHERE r2 > 0
UNION ALL SELECT 'error', 'camera_names_differ', CAST(recording AS VARCHAR), string_agg(camera, ',' ORDER BY camera) FROM m GROUP BY recording
UNION ALL SELECT 'error', 'calib_group_missing', CAST(c_custkey AS VARCHAR), '' FROM customer WHERE c_custkey NOT IN (SELECT recording FROM m)""")
def e11_calibration_findings(spark, sf):
    m = calibrations(spark, sf).where(~((F.col("recording") % 10 == 0) & (F.col("camera") == "Cam02")))
    bent = F.transform("p", lambda v, i: F.when(i == 8, v + 0.5).otherwise(v))
    m = m.withColumn("p", F.when(F.col("recording") % 9 == 0, bent).otherwise(F.col("p"))).withColumnRenamed("recording", "calib_group")
    ref = table(spark, sf, "customer").select(F.col("c_custkey").alias("calib_group"))
    return C.calibration_findings(m, ref)


@query(f"""WITH {TRACKS_CTE}, s AS (SELECT track, frame % 7 AS fly, CASE WHEN label = 'click' THEN 'female' WHEN label = 'view' THEN 'male' ELSE 'unknown' END AS sex FROM t)
SELECT track, fly, count(*) FILTER (sex = 'female') AS n_female, count(*) FILTER (sex = 'male') AS n_male FROM s GROUP BY ALL HAVING count(*) FILTER (sex = 'female') > 0 AND count(*) FILTER (sex = 'male') > 0""")
def f41_sex_disagreements(spark, sf):
    sex = F.when(F.col("label") == "click", "female").when(F.col("label") == "view", "male").otherwise("unknown")
    return C.sex_disagreements(tracks(spark, sf).select("track", (F.col("frame") % 7).alias("fly"), sex.alias("sex")), ["track", "fly"])


_NEG = f"""{TRACKS_CTE}, n AS (SELECT track, frame, CASE WHEN conf < 0.5 THEN frame + 2 ELSE frame - 1 END AS pf FROM t WHERE label IN ('click', 'view', 'signup'))"""


def negatives(spark, sf):
    pf = F.when(F.col("conf") < 0.5, F.col("frame") + 2).otherwise(F.col("frame") - 1)
    return tracks(spark, sf).where(F.col("label").isin("click", "view", "signup")).select("track", "frame", F.create_map(F.lit("2"), pf).alias("partners"))


@query(f"""WITH {_NEG}, w AS (SELECT DISTINCT track, least(frame, pf) AS start, 2 AS delta FROM n WHERE abs(pf - frame) = 2)
SELECT w.track, start, delta FROM w WHERE EXISTS (SELECT 1 FROM n WHERE n.track = w.track AND n.frame = start) AND EXISTS (SELECT 1 FROM n WHERE n.track = w.track AND n.frame = start + 2)""")
def e15_partner_windows(spark, sf):
    return C.partner_windows(negatives(spark, sf), ["track"], "frame", [2])[0]


@query(f"WITH {_NEG} SELECT track, frame, 2 AS delta, pf AS partner FROM n WHERE abs(pf - frame) <> 2")
def e15_broken_partners(spark, sf):
    return C.partner_windows(negatives(spark, sf), ["track"], "frame", [2])[1]


@query(f"""WITH {TRACKS_CTE}, f AS (SELECT track // 4 AS rec, frame, CAST(track % 4 AS INT) - 1 AS fly FROM t), o AS (SELECT h.rec, h.frame, h.fly, min(k.fly) AS other FROM f h JOIN f k ON k.rec = h.rec AND k.frame = h.frame AND k.fly <> h.fly AND k.fly >= 0 WHERE h.fly >= 0 GROUP BY ALL)
SELECT f.rec, f.frame, f.fly, f.fly || coalesce(',' || other, '') AS flies FROM f LEFT JOIN o USING (rec, frame, fly) WHERE f.fly >= 0""")
def e16_co_labelled(spark, sf):
    f = tracks(spark, sf).select(F.floor(F.col("track") / 4).alias("rec"), "frame", (F.col("track") % 4 - 1).cast("int").alias("fly"))
    return C.co_labelled(f, f, ["rec"], "frame", "fly", max_flies=2).withColumn("flies", F.array_join("flies", ","))


@query(f"""WITH {IMG}, w AS (SELECT id, tier AS calib, n_chars % 2 AS sex, row_number() OVER (PARTITION BY tier, n_chars % 2 ORDER BY {_hash_sql("'0'", 'id')}, id) - 1 AS i, count(*) OVER (PARTITION BY tier, n_chars % 2) AS n FROM img WHERE n_chars >= 100)
SELECT a.id, a.calib, a.sex, b.id AS donor FROM w a JOIN w b ON b.calib = a.calib AND b.sex = a.sex AND b.i = (a.i + 1) % a.n WHERE a.id <> b.id""")
def e17_donor_pool(spark, sf):
    w = images(spark, sf).select("id", F.col("tier").alias("calib"), (F.col("n_chars") % 2).alias("sex"), (F.col("n_chars") < 100).alias("negative"))
    return C.donors(w, ["calib", "sex"], "id").select("id", "calib", "sex", "donor")


_WIN = """win AS (SELECT d.doc_id AS "window", source AS calib_group, quality = 1 AS female, 1 + toxic AS n_flies, n_chars, n_chars % 40 AS cx0, n_chars % 17 AS cy0, 0 AS cz0, n_chars % 23 AS cx1, n_chars % 29 AS cy1, n_chars % 13 AS cz1 FROM documents d JOIN labels USING (doc_id)),
 coh AS (SELECT "window", 'female' AS cohort FROM win WHERE female UNION ALL SELECT "window", 'two_fly' FROM win WHERE n_flies > 1 UNION ALL SELECT "window", 'single_fly' FROM win WHERE n_flies = 1
  UNION ALL SELECT "window", 'group_' || calib_group FROM win UNION ALL SELECT "window", 'contact_pair' FROM win WHERE n_flies >= 2 AND sqrt((cx0 - cx1) ** 2 + (cy0 - cy1) ** 2 + (cz0 - cz1) ** 2) < 30),
 pred AS (SELECT "window", s AS slot, (("window" * 7 + s * 31 + n_chars) % 100) / 100.0 AS exist_prob, ((n_chars + s * 13) % 53) / 10.0 AS err, 3 + n_chars % 5 AS n, (("window" * 3 + s * 17) % 41) AS "offset" FROM win, (SELECT unnest(range(4)) AS s))"""


def windows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    return d.select(
        F.col("doc_id").alias("window"), F.col("source").alias("calib_group"), (F.col("quality") == 1).alias("female"), (1 + F.col("toxic")).alias("n_flies"), "n_chars",
        *[(n % m).alias(c) for c, m in (("cx0", 40), ("cy0", 17), ("cx1", 23), ("cy1", 29), ("cz1", 13))], F.lit(0).alias("cz0"),
    )


def predictions(spark, sf):
    w, n, s = F.col("window"), F.col("n_chars"), F.col("slot")
    d = windows(spark, sf).select("window", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot"))
    return d.select("window", "slot", ((w * 7 + s * 31 + n) % 100 / 100.0).alias("exist_prob"), ((n + s * 13) % 53 / 10.0).alias("err"), (3 + n % 5).alias("n"), ((w * 3 + s * 17) % 41).alias("offset"))


@query(f'WITH {_WIN} SELECT cohort, count(*) AS n FROM coh GROUP BY cohort')
def f17_cohorts(spark, sf):
    return E.cohorts(windows(spark, sf)).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_WIN}, o AS (SELECT "window", min(err) AS oe, max(n) AS n FROM pred GROUP BY 1), p AS (SELECT "window", arg_min(err, ("offset", slot)) AS pe FROM pred WHERE exist_prob >= 0.5 AND slot > 0 GROUP BY 1),
 s AS (SELECT o."window", oe, pe, n FROM o LEFT JOIN p USING ("window")), c AS (SELECT * FROM coh UNION ALL SELECT "window", 'all' FROM win)
SELECT cohort, round(sum(oe * n) / sum(n), 6) AS mpjpe, round(sum(pe * n) / sum(n) FILTER (pe IS NOT NULL), 6) AS mpjpe_policy, round(avg(CASE WHEN pe IS NULL THEN 1.0 ELSE 0.0 END), 6) AS miss_fraction, count(*) AS n_windows FROM c JOIN s USING ("window") GROUP BY cohort""")
def f18_prediction_errors(spark, sf):
    r = E.summarise(E.score_windows(predictions(spark, sf)), E.cohorts(windows(spark, sf)))
    return r.select("cohort", *[F.round(c, 6).alias(c) for c in ("mpjpe", "mpjpe_policy", "miss_fraction")], "n_windows")


@query(f"""WITH {_WIN}, j AS (SELECT p.*, exist_prob >= 0.5 AS e, slot = CASE WHEN female THEN 1 ELSE 2 END AS t, (n_flies > 1 AND slot IN (2, 3)) AS ign FROM pred p JOIN win USING ("window"))
SELECT slot, count(*) FILTER (e AND t) AS tp, count(*) FILTER (e AND NOT t) AS fp, count(*) FILTER (NOT e AND t) AS fn, round(count(*) FILTER (e AND t) / greatest(count(*) FILTER (e), 1), 6) AS precision,
 round(count(*) FILTER (e AND t) / nullif(count(*) FILTER (t), 0), 6) AS recall FROM j WHERE t OR NOT ign GROUP BY slot""")
def f18_slot_quality(spark, sf):
    p = predictions(spark, sf)
    w = windows(spark, sf).select("window", "female", "n_flies")
    unl = F.when(F.col("n_flies") > 1, E.SEX_MALE).otherwise(E.SEX_UNKNOWN)
    t = p.select("window", "slot").join(w, "window").select("window", "slot", (F.col("slot") == F.when(F.col("female"), E.SLOT_FEMALE).otherwise(E.SLOT_MALE)).alias("target"), E.slot_ignored(unl, F.col("slot")).alias("ignore"))
    q = E.slot_quality(p, t)
    return q.select("slot", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_WIN}, p AS (SELECT calib_group, abs(cx0 - cx1) AS own, cy1 AS other FROM win) SELECT calib_group, round(avg(CASE WHEN own > other THEN 1.0 ELSE 0.0 END), 6) AS cross_fraction, count(*) AS n_points FROM p GROUP BY 1""")
def f18_cross_animal(spark, sf):
    p = windows(spark, sf).select("calib_group", F.abs(F.col("cx0") - F.col("cx1")).alias("d_own"), F.col("cy1").alias("d_other"))
    c = E.cross_animal(p, ["calib_group"])
    return c.withColumn("cross_fraction", F.round("cross_fraction", 6))


@query(f"""WITH {_WIN}, f AS (SELECT "window", CASE WHEN female THEN 0 ELSE 1 END AS s0, CASE n_chars % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS s1, n_chars % 11 > 0 AS v0, n_flies > 1 AS v1, n_chars % 4 = 0 AS pon FROM win),
 h AS (SELECT *, CASE WHEN NOT v0 THEN -1 WHEN pon THEN 0 WHEN s0 = 0 THEN 1 ELSE 2 END AS slot0, CASE s1 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w1 FROM f)
SELECT "window", slot0, CASE WHEN NOT v1 THEN -1 WHEN w1 <> slot0 THEN w1 WHEN slot0 <> 3 THEN 3 ELSE -1 END AS slot1 FROM h""")
def f19_slot_assignment(spark, sf):
    return E.assign_slots(slot_animals(windows(spark, sf)))


def slot_animals(w):
    """Host and companion of every window with sex, validity and prompt."""
    n = F.col("n_chars")
    a = w.select("window", F.lit(0).alias("fly"), F.when(F.col("female"), 0).otherwise(1).alias("sex"), (n % 11 > 0).alias("valid"), (n % 4 == 0).alias("prompt_on"))
    b = w.select("window", F.lit(1).alias("fly"), F.when(n % 3 == 0, 0).when(n % 3 == 1, 1).otherwise(-1).alias("sex"), (F.col("n_flies") > 1).alias("valid"), (n % 4 == 0).alias("prompt_on"))
    return a.unionByName(b)


# Slots and logits of the animals of a window.
_FLIES = """f AS (SELECT "window", CASE WHEN female THEN 0 ELSE 1 END AS s0, CASE n_chars % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS s1, n_chars % 11 > 0 AS v0, n_flies > 1 AS v1, n_chars % 4 = 0 AS pon FROM win),
 h AS (SELECT *, CASE WHEN NOT v0 THEN -1 WHEN pon THEN 0 WHEN s0 = 0 THEN 1 ELSE 2 END AS slot0, CASE s1 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w1 FROM f),
 a AS (SELECT *, CASE WHEN NOT v1 THEN -1 WHEN w1 <> slot0 THEN w1 WHEN slot0 <> 3 THEN 3 ELSE -1 END AS slot1 FROM h),
 lg AS (SELECT "window", slot, (("window" * 11 + slot * 17 + n_chars) % 21) - 10 AS z FROM win, (SELECT unnest(range(4)) AS slot)),
 j AS (SELECT "window", slot0 AS slot, s0 AS sex FROM a WHERE v0 AND slot0 >= 0 UNION ALL SELECT "window", slot1, s1 FROM a WHERE v1 AND s1 >= 0 AND slot1 >= 0),
 ht AS (SELECT "window", (z > 0) = (sex = 0) AS hit FROM j JOIN lg USING ("window", slot))"""


@query(f"""WITH {_WIN}, {_FLIES}, c AS (SELECT * FROM coh UNION ALL SELECT DISTINCT "window", 'all' FROM ht)
SELECT cohort, round(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END), 6) AS sex_acc, count(hit) AS n_judged FROM c LEFT JOIN ht USING ("window") GROUP BY cohort""")
def f18_sex_accuracy(spark, sf):
    w, n = windows(spark, sf), F.col("n_chars")
    logit = predictions(spark, sf).join(w.select("window", "n_chars"), "window").select("window", "slot", ((F.col("window") * 11 + F.col("slot") * 17 + n) % 21 - 10).alias("sex_logit"))
    flies = slot_animals(w)
    r = E.sex_accuracy(E.sex_hits(flies, E.assign_slots(flies), logit), E.cohorts(w))
    return r.select("cohort", F.round("sex_acc", 6).alias("sex_acc"), "n_judged")


@query(f"""WITH {KEYPOINTS_CTE}, {BONES_CTE}, k AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 1.1 * x ELSE x END AS px FROM kps),
 l AS (SELECT a, b, least(p.conf, r.conf) >= 0.3 AS labelled, sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) AS gt, sqrt((p.px - r.px) ** 2 + (p.y - r.y) ** 2 + (p.z - r.z) ** 2) AS pr
  FROM bones JOIN k p ON p.kp = a JOIN k r ON r.kp = b AND r.track = p.track AND r.frame = p.frame)
SELECT a, b, round(stddev_pop(pr), 6) AS spread, round(avg(pr) FILTER (labelled) / avg(gt) FILTER (labelled), 6) AS length_ratio FROM l GROUP BY a, b""")
def f18_rigid_quality(spark, sf):
    k, bones, at = keypoints(spark, sf), pairs_of_names(spark, BONES), ["track", "frame"]
    pred = G.segment_lengths(k.withColumn("x", F.when(F.col("pos") % 2 == 0, F.col("x") * 1.1).otherwise(F.col("x"))), at, bones)
    gt = G.segment_lengths(k.where(F.col("conf") >= 0.3), at, bones).withColumnRenamed("length", "length_gt")
    r = E.rigid_quality(pred.join(gt, [*at, "a", "b"], "left"))
    return r.select("a", "b", F.round("spread", 6).alias("spread"), F.round("length_ratio", 6).alias("length_ratio"))


def _grid_sql(k: int) -> str:
    """The grid of one round, its losses, and the best point with its neighbours."""
    at = f"lo + (hi - lo) * i / 40.0 AS p FROM r{k}, (SELECT unnest(range(41)) AS i)"
    loss = "greatest(z, 0.0) - z * t + ln(1 + exp(-abs(z)))"
    return f"""g{k} AS (SELECT i, {at}), n{k} AS (SELECT i, any_value(p) AS p, sum(w * ({loss})) / sum(w) AS nll FROM (SELECT i, p, l / exp(p) AS z, t, w FROM g{k}, d) GROUP BY i),
 b{k} AS (SELECT arg_min(i, (nll, i)) AS i FROM n{k}), r{k + 1} AS (SELECT max(p) FILTER (n.i = greatest(b.i - 1, 0)) AS lo, max(p) FILTER (n.i = least(b.i + 1, 40)) AS hi, max(p) FILTER (n.i = b.i) AS best, max(nll) FILTER (n.i = b.i) AS nll FROM n{k} n, b{k} b)"""


@query(f"""WITH {_WIN}, d AS (SELECT (n_chars % 41 - 20) / 4.0 + CASE WHEN female THEN 1.5 ELSE -1.5 END AS l, CAST(female AS INT) AS t, count(*) AS w FROM win GROUP BY ALL),
 r0 AS (SELECT -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi), {', '.join(map(_grid_sql, range(5)))}
SELECT round(exp(best), 3) AS temperature, round(nll, 6) AS nll, abs(best + 5) < 0.5 OR abs(best - 5) < 0.5 AS saturated FROM r5""")
def f20_temperature(spark, sf):
    w = windows(spark, sf).select(((F.col("n_chars") % 41 - 20) / 4.0 + F.when(F.col("female"), 1.5).otherwise(-1.5)).alias("logit"), F.col("female").cast("int").alias("target"))
    r = E.fit_temperature(w, "logit", "target")
    return r.select(F.round("temperature", 3).alias("temperature"), F.round("nll", 6).alias("nll"), "saturated")


_MIX = f"""{IMG}, w AS (SELECT id, tier AS source_id, split AS behavior, n_chars % 3 = 0 AS f FROM img), c0 AS (SELECT source_id, behavior, f, count(*) AS c FROM w GROUP BY ALL), c AS (SELECT *, pow(1.0 / c, 0.5) * CASE WHEN f THEN 2.0 ELSE 1.0 END AS w FROM c0),
 t AS (SELECT source_id, sum(w * c) AS sw, sum(CASE WHEN f THEN w * c ELSE 0 END) AS fw, sum(c) AS n, sum(CASE WHEN f THEN c ELSE 0 END) AS nf FROM c GROUP BY 1),
 m AS (SELECT t.*, kind, CASE WHEN nf = 0 OR nf = n THEN 1.0 ELSE 0.4 * (1 - fw / sw) / (0.6 * fw / sw) END AS mult FROM t JOIN sources ON tier = source_id),
 g AS (SELECT count(*) FILTER (kind = 'negative') AS k, sum(n) FILTER (kind <> 'negative') AS np FROM m),
 q AS (SELECT m.*, CASE WHEN kind = 'negative' THEN 0.1 / k ELSE 0.9 * n / np END AS mass FROM m, g),
 wt AS (SELECT c.*, c.w * CASE WHEN f THEN mult ELSE 1 END / (sw + fw * (mult - 1)) * mass AS weight FROM c JOIN q USING (source_id))"""


def mixed(spark, sf):
    w = images(spark, sf).select("id", F.col("tier").alias("source_id"), F.col("split").alias("behavior"), (F.col("n_chars") % 3 == 0).alias("is_female"))
    src = source_table(spark, sf).select(F.col("tier").alias("source_id"), "kind")
    return E.mix_weights(w, src, alpha=0.5, female_weight=2.0, female_target=0.4, negatives_fraction=0.1)


@query(f"WITH {_MIX} SELECT id, round(weight * 1000, 6) AS weight_permille FROM w JOIN wt USING (source_id, behavior, f)")
def f21_mix_weights(spark, sf):
    return mixed(spark, sf).select("id", F.round(F.col("weight") * 1000, 6).alias("weight_permille"))


@query(f"""WITH {_MIX}, x AS (SELECT id, w.source_id, weight, sum(weight) OVER (ORDER BY id) AS hi, sum(weight) OVER () AS tot FROM w JOIN wt USING (source_id, behavior, f)), iv AS (SELECT id, source_id, (hi - weight) / tot AS a, hi / tot AS b FROM x),
 d AS (SELECT i AS draw, {_hash_sql("'3'", 'i')} AS u FROM (SELECT unnest(range(2000)) AS i)) SELECT iv.source_id, count(*) AS n FROM d JOIN iv ON u >= a AND u < b GROUP BY 1""")
def f22_realised_mix(spark, sf):
    m = mixed(spark, sf)
    return E.weighted_draw(m, "id", "weight", 2000, seed=3).join(m.select("id", "source_id"), "id").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type <> 'error' AS costs_finite, '{"exist":' || CAST(regexp_extract(props, '[0-9]+') AS INT) || ',"step":' || (event_id % 5) || ',"window":"' || event_type || '"}' AS gates, CASE WHEN event_type = 'view' THEN 'unknown' WHEN user_id % 2 = 1 THEN 'male' ELSE 'female' END AS sex FROM events""")
def b10_json_attributes(spark, sf):
    from strideframe.functions import attributes as A

    e = table(spark, sf, "events")
    cost = F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("value").cast("string"))
    summary = F.concat(F.lit('{"pose_cost": '), cost, F.lit(', "frames": 3, "Cost_total": 1.5}'))
    sex_doc = F.when(F.col("event_type") == "view", F.lit('{"identity": "none"}')).otherwise(F.lit('{"identity": "sex", "male_fly": 1}'))
    gates = A.gate_text(step=F.col("event_id") % 5, exist=F.get_json_object("props", "$.k").cast("int"), window=F.col("event_type"))
    return e.select("event_id", A.costs_finite(summary).alias("costs_finite"), gates.alias("gates"), A.fly_sex(sex_doc, (F.col("user_id") % 2).cast("int")).alias("sex"))
