"""Labelled-set operators: names, ids, merges, findings, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import names as N
from strideframe.operators.ordered import number_rows
from strideframe.operators.quantiles import attach
from strideframe.operators.select import hash_uniform
from strideframe.session import cut_lineage


def mirror_table(names: DataFrame, name: str = "kp") -> DataFrame:
    """Each landmark with its left/right counterpart; a name whose counterpart is absent maps
    to itself."""
    m = names.select(F.col(name), N.mirror_name(F.col(name)).alias("mirror"))
    have = names.select(F.col(name).alias("mirror")).withColumn("_has", F.lit(True))
    return m.join(have, "mirror", "left").select(name, F.when(F.col("_has"), F.col("mirror")).otherwise(F.col(name)).alias("mirror"))


def mirror_findings(names: DataFrame, table: DataFrame, name: str = "kp") -> DataFrame:
    """Sided names that the table does not pair with their counterpart, or pairs one way only."""
    back = table.select(F.col(name).alias("mirror"), F.col("mirror").alias("_back"))
    j = names.select(F.col(name)).join(table, name, "left").join(back, "mirror", "left")
    want = N.mirror_name(F.col(name))
    bad = (want != F.col(name)) & (F.col("mirror").isNull() | (F.col("mirror") != want))
    return j.where(bad | (F.col("_back") != F.col(name))).select(name)

# Source kinds, export tiers, fewest cameras of a labelled animal.
SOURCE_KINDS = ("human", "pseudo", "negative", "singlefly")
EXPORT_TIERS = ("human", "all", "masks")
MIN_CAMS = 3


def six_decimals(v: Column) -> Column:
    """A finite number rounded half to even to six decimals, in its shortest text: ``1.0``, ``-0.25``, ``1.2e-05``."""
    x = F.rint(v * 1e6) / F.lit(1e6)
    micro = F.rint(F.abs(x) * 1e6).cast("long")
    tenth = F.floor(micro / 10)
    tiny = F.when(micro < 10, F.concat(micro.cast("string"), F.lit("e-06"))).when(micro % 10 == 0, F.concat(tenth.cast("string"), F.lit("e-05"))).otherwise(
        F.concat(tenth.cast("string"), F.lit("."), (micro % 10).cast("string"), F.lit("e-05"))
    )
    plain = F.regexp_replace(F.format_string("%.6f", x), r"(\.\d+?)0*$", "$1")
    return F.when((micro > 0) & (micro < 100), F.concat(F.when(x < 0, "-").otherwise(""), tiny)).otherwise(plain)


def fingerprint(matrices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Digest of a calibration: the nested list of its 3x4 camera matrices, row by row, rounded to six decimals.

    ``matrices`` has one row per camera (``camera``, 12 numbers ``p``), so a calibration's list is as long as its
    rig. Cameras stand by ``position`` where there is such a column, by name otherwise.
    """
    line = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.slice("p", 4 * r + 1, 4), six_decimals), ", "), F.lit("]"))
    row = F.concat(F.lit("["), F.concat_ws(", ", *[line(r) for r in range(3)]), F.lit("]"))
    at = F.col("position") if "position" in matrices.columns else F.col("camera")
    rig = F.array_sort(F.collect_list(F.struct(at.alias("at"), "camera", row.alias("r"))))
    d = matrices.groupBy(*keys).agg(rig.alias("_rig"))
    payload = F.concat(F.lit("["), F.array_join(F.transform("_rig", lambda c: c["r"]), ", "), F.lit("]"))
    return d.select(*keys, N.digest16(payload).alias("fingerprint"), F.array_join(F.transform("_rig", lambda c: c["camera"]), ",").alias("cameras"))


def group_calibrations(prints: DataFrame, recording: str) -> DataFrame:
    """Group number of every recording's calibration: the most common one first, then by the
    first recording.  (Group 0 is "A", and labels go on in code-point order; as many rows are ranked here as there are distinct rigs.)"""
    sizes = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min(recording).alias("first"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "first"))
    groups = sizes.select("fingerprint", (rank - 1).alias("group_no"))
    return prints.join(groups, "fingerprint").withColumn("group", F.decode(F.unhex(F.lpad(F.hex(F.col("group_no") + 65), 8, "0")), "UTF-32"))


def dense_ids(items: DataFrame, tiers: DataFrame, splits: Sequence[str], id_col: str, *, block: int = 4096, start: int = 1) -> DataFrame:
    """New ids over all splits and tiers: split by split, tier by tier in the tiers' order, old
    ids in order inside a tier's split.

    Positions inside a split come from blocks of the old id and the offsets from one row per
    (split, tier), so there is no global sort.  ``tiers(tier, tier_pos)``.
    """
    d = number_rows(items, ["tier", "split"], [id_col], F.floor(F.col(id_col) / block), name="_pos")
    split_pos = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    sizes = items.groupBy("tier", "split").agg(F.count(F.lit(1)).alias("_n")).join(tiers, "tier").withColumn("_sp", split_pos)
    w = Window.partitionBy(F.lit(1)).orderBy("_sp", "tier_pos").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("tier", "split", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return attach(d, offs, ["tier", "split"], "inner").withColumn("new_id", F.col("_pos") + F.col("_off") + start).drop("_pos", "_off")


def tier_findings(tiers: DataFrame, keypoint_sets: DataFrame, images: DataFrame) -> DataFrame:
    """Why tiers cannot be merged: repeated tier, differing landmark names, image in two splits."""
    dup = tiers.groupBy("tier").count().where(F.col("count") > 1).select(F.lit("duplicate_tier").alias("code"), F.col("tier").alias("subject"))
    first = tiers.agg(F.min_by("tier", "tier_pos").alias("tier")).join(keypoint_sets, "tier").select(F.col("names").alias("_names"))
    kp = keypoint_sets.crossJoin(F.broadcast(first)).where(~F.col("names").eqNullSafe(F.col("_names"))).select(F.lit("keypoints_differ").alias("code"), F.col("tier").alias("subject"))
    stems = images.groupBy("tier", N.image_stem(F.col("file_name")).alias("_stem"), F.regexp_replace("file_name", r"/[^/]*$", "").alias("_dir"))
    two = stems.agg(F.count_distinct("split").alias("_k")).where(F.col("_k") > 1).select(F.lit("image_in_two_splits").alias("code"), F.concat_ws("/", "tier", "_dir", "_stem").alias("subject"))
    return dup.unionByName(kp).unionByName(two)


def remap_framesets(framesets: DataFrame, image_map: DataFrame, ann_map: DataFrame, sources: DataFrame) -> DataFrame:
    """Framesets in the merged id space: arrays remapped element by element in position order
    (missing annotations stay null), provenance filled from the source where absent."""
    k = ["tier", "split", "key"]
    flat = framesets.select(*k, F.posexplode(F.arrays_zip("frames", "ann_ids")).alias("pos", "s")).select(*k, "pos", F.col("s.frames").alias("img"), F.col("s.ann_ids").alias("ann"))
    im = image_map.select("tier", "split", F.col("id").alias("img"), F.col("new_id").alias("new_img"))
    am = ann_map.select("tier", "split", F.col("id").alias("ann"), F.col("new_id").alias("new_ann"))
    j = flat.join(im, ["tier", "split", "img"]).join(am, ["tier", "split", "ann"], "left")
    packed = j.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("pos", "new_img", "new_ann"))).alias("a"))
    out = framesets.drop("frames", "ann_ids").join(packed, k).join(sources, "tier")
    return out.select(
        *k, F.concat_ws("/", "tier", "key").alias("new_key"), "recording", F.transform("a", lambda s: s["new_img"]).alias("frames"), F.transform("a", lambda s: s["new_ann"]).alias("ann_ids"),
        F.coalesce("source", "kind").alias("source"), F.coalesce("weight", "default_weight", F.lit(1.0)).alias("weight"),
    )


def remap_masks(mask_rows: DataFrame, images: DataFrame, ann_map: DataFrame) -> DataFrame:
    """Mask rows with their merged annotation id, or null where the row is dropped.

    A mask's id belongs to the split that owns its image; an image in no split drops it.
    """
    owner = images.select("tier", "stem", "split").distinct()
    j = mask_rows.join(owner, ["tier", "stem"], "left")
    return j.join(ann_map.select("tier", "split", F.col("id").alias("ann_id"), F.col("new_id").alias("new_ann")), ["tier", "split", "ann_id"], "left")


def resolved_slots(framesets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(image, annotation) pairs of cameras that saw the animal."""
    z = framesets.select(*keys, F.explode(F.arrays_zip("frames", "ann_ids")).alias("s"))
    return z.where(F.col("s.ann_ids").isNotNull()).select(*keys, F.col("s.frames").alias("image_id"), F.col("s.ann_ids").alias("ann_id"))


def _finding(df: DataFrame, level: str, code: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def frameset_findings(framesets: DataFrame, images: DataFrame, annotations: DataFrame, sources: DataFrame, recordings: DataFrame) -> DataFrame:
    """Broken references and incomplete framesets of one root (``split`` is part of every key)."""
    fs = framesets.withColumn("_sub", F.concat_ws("/", "split", "key"))
    uneven = F.size("frames") != F.size("ann_ids")
    out = _finding(fs.where(uneven), "error", "ann_ids_length", F.col("_sub"), F.concat_ws(" vs ", F.size("frames"), F.size("ann_ids")))
    ok = fs.where(~uneven)

    def unknown(col: str, have: DataFrame, code: str) -> DataFrame:
        ids = ok.select("_sub", "split", F.explode(col).alias("id")).where(F.col("id").isNotNull())
        miss = ids.join(have.select("split", "id").distinct(), ["split", "id"], "left_anti").groupBy("_sub").agg(F.count(F.lit(1)).alias("n"))
        return _finding(miss, "error", code, F.col("_sub"), F.col("n"))

    seen = F.size(F.filter("ann_ids", lambda a: a.isNotNull()))
    parts = [
        unknown("frames", images, "frameset_image_missing"),
        unknown("ann_ids", annotations, "frameset_ann_missing"),
        _finding(ok.where(seen < MIN_CAMS), "error", "too_few_cameras", F.col("_sub"), seen),
        _finding(ok.where((F.col("fly_id") < 0) & F.col("center3d").isNull()), "error", "negative_without_center3d", F.col("_sub")),
        _finding(ok.where(F.col("source_id").isNotNull()).join(sources.select("source_id"), "source_id", "left_anti"), "error", "unknown_source_id", F.col("_sub"), F.col("source_id")),
        _finding(
            ok.where(F.col("calib_group").isNull()).join(recordings.where(F.col("rec_calib").isNotNull()).select("recording"), "recording", "left_anti"),
            "error", "frameset_calib_unresolvable", F.col("_sub"),
        ),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out


def image_findings(images: DataFrame, annotations: DataFrame, files: DataFrame | None, *, n_keypoints: int | None = None) -> DataFrame:
    """Missing files, wrong landmark counts, and the profile of a split's images."""
    dup = images.groupBy("split", "file_name").count().where(F.col("count") > 1)
    out = _finding(dup, "warning", "duplicate_file_name", F.concat_ws("/", "split", "file_name"), F.col("count"))
    per = images.select("split", "id").join(annotations.groupBy("split", F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("_k")), ["split", "id"], "left")
    prof = per.groupBy("split").agg(F.count_if(F.col("_k").isNull()).alias("_zero"), F.count_if(F.col("_k") >= 2).alias("_two"), F.count(F.lit(1)).alias("_n"))
    out = out.unionByName(_finding(prof.where(F.col("_zero") > 0), "info", "zero_annotation_images", F.col("split"), F.col("_zero")))
    out = out.unionByName(_finding(prof, "info", "two_fly_fraction", F.col("split"), F.concat_ws("/", "_two", "_n")))
    if files is not None:
        lost = images.join(files.select("file_name"), "file_name", "left_anti").groupBy("split").agg(F.count(F.lit(1)).alias("_m"), F.min("file_name").alias("_f"))
        out = out.unionByName(_finding(lost, "error", "image_missing", F.concat_ws("/", "split", "_f"), F.col("_m")))
    if n_keypoints is not None:
        bad = annotations.where(F.col("n_values") != 3 * n_keypoints).groupBy("split").agg(F.count(F.lit(1)).alias("_m"), F.min("id").alias("_i"))
        out = out.unionByName(_finding(bad, "error", "keypoints_length", F.concat_ws("/", "split", "_i"), F.col("_m")))
    return out


def calibration_findings(matrices: DataFrame, referenced: DataFrame) -> DataFrame:
    """Matrices that are not affine, groups that disagree on camera names, groups without files."""
    last = [F.element_at("p", i) for i in (9, 10, 11, 12)]
    affine = F.greatest(F.abs(last[0]), F.abs(last[1]), F.abs(last[2]), F.abs(last[3] - 1)) <= 1e-8
    out = _finding(matrices.where(~affine), "error", "calibration_not_affine", F.concat_ws("/", "calib_group", "camera"))
    names = matrices.groupBy("calib_group").agg(F.array_join(F.array_sort(F.collect_set("camera")), ",").alias("_c"))
    many = names.agg(F.count_distinct("_c").alias("_k"))
    out = out.unionByName(_finding(names.crossJoin(F.broadcast(many)).where(F.col("_k") > 1), "error", "camera_names_differ", F.col("calib_group"), F.col("_c")))
    lost = referenced.select("calib_group").where(F.col("calib_group").isNotNull()).distinct().join(names, "calib_group", "left_anti")
    return out.unionByName(_finding(lost, "error", "calib_group_missing", F.col("calib_group")))


def evenly_spaced(framesets: DataFrame, *, sample: int = 200, block: int = 4096) -> DataFrame:
    """At most ``sample`` framesets per split, evenly spaced in key order.

    ``seq`` is the frameset's numeric position key in its file.
    """
    d = number_rows(framesets, ["split"], ["seq"], F.floor(F.col("seq") / block), name="_pos")
    n = framesets.groupBy("split").agg(F.count(F.lit(1)).alias("_n"))
    d = attach(d, n, ["split"])
    step = F.greatest(F.floor(F.col("_n") / sample), F.lit(1))
    return d.where((F.pmod(F.col("_pos"), step) == 0) & (F.floor(F.col("_pos") / step) < sample)).drop("_pos", "_n")


def unresolved_masks(slots: DataFrame, mask_rows: DataFrame) -> DataFrame:
    """Per split: sampled slots whose image has a mask file, and those whose annotation it lacks."""
    have = mask_rows.select("image_id").distinct().withColumn("_file", F.lit(True))
    rows = mask_rows.select("image_id", "ann_id").distinct().withColumn("_row", F.lit(True))
    j = slots.join(have, "image_id").join(rows, ["image_id", "ann_id"], "left")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_row").isNull()).alias("unresolved"))


def export_subset(framesets: DataFrame, images: DataFrame, sources: DataFrame, *, tier: str = "all") -> tuple[DataFrame, DataFrame]:
    """Framesets of the exported sources and the images they reference."""
    if tier not in EXPORT_TIERS:
        raise ValueError(f"tier {tier!r} is not one of {EXPORT_TIERS}")
    keep = sources if tier == "all" else sources.where(F.col("kind") == "human")
    fs = framesets.join(keep.select("source_id"), "source_id", "left_semi")
    used = fs.select("split", F.explode("frames").alias("id")).distinct()
    return fs, images.join(used, ["split", "id"], "left_semi")


def checksums(members: DataFrame, name: str, content: str) -> DataFrame:
    """sha256 of every member, to be written sorted by name."""
    return members.select(F.col(name).alias("name"), F.sha2(content, 256).alias("sha256"))


def sex_disagreements(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Animals whose annotations name more than one sex, with the counts."""
    known = rows.where(F.col("sex").isNotNull() & (F.col("sex") != "unknown"))
    c = known.groupBy(*keys).agg(F.count_if(F.col("sex") == "female").alias("n_female"), F.count_if(F.col("sex") == "male").alias("n_male"))
    return c.where((F.col("n_female") > 0) & (F.col("n_male") > 0))


def partner_windows(framesets: DataFrame, keys: Sequence[str], frame: str, deltas: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Two-frame windows of negatives from their own partner maps, and broken partner links.

    ``partners`` maps a spacing to the partner's frame; a link named from both ends is one window.
    """
    p = framesets.select(*keys, frame, F.explode("partners").alias("_d", "_pf")).withColumn("delta", F.col("_d").cast("long"))
    p = p.where(F.col("delta").isin(*[int(d) for d in deltas]))
    bad = p.where(F.abs(F.col("_pf") - F.col(frame)) != F.col("delta")).select(*keys, frame, "delta", F.col("_pf").alias("partner"))
    good = p.where(F.abs(F.col("_pf") - F.col(frame)) == F.col("delta")).select(*keys, F.least(F.col(frame), F.col("_pf")).alias("start"), "delta").distinct()
    have = framesets.select(*keys, F.col(frame).alias("start")).distinct()
    good = good.join(have, [*keys, "start"], "left_semi")
    end = have.select(*keys, F.col("start").alias("_e"))
    return good.withColumn("_e", F.col("start") + F.col("delta")).join(end, [*keys, "_e"], "left_semi").drop("_e"), bad


def co_labelled(framesets: DataFrame, host: DataFrame, keys: Sequence[str], frame: str, fly: str, *, max_flies: int | None = None) -> DataFrame:
    """Host first, then the other labelled animals of its frames, lowest id first; at most ``max_flies`` if given.

    An image set holds a handful of animals, so the set per window is small.
    """
    others = framesets.where(F.col(fly) >= 0).select(*keys, frame, F.col(fly).alias("_other")).distinct()
    j = host.where(F.col(fly) >= 0).join(others, [*keys, frame], "left").where(F.col("_other") != F.col(fly))
    per = j.groupBy(*keys, frame, fly).agg(F.array_sort(F.collect_set("_other")).alias("_o"))
    d = host.where(F.col(fly) >= 0).join(per, [*keys, frame, fly], "left")
    rest = F.coalesce("_o", F.array().cast("array<int>"))
    return d.withColumn("flies", F.concat(F.array(fly), rest if max_flies is None else F.slice(rest, 1, max_flies - 1))).drop("_o")


def donors(windows: DataFrame, group: Sequence[str], ident: str, *, seed: int = 0, block: int = 1024) -> DataFrame:
    """A donor for every non-negative window from its own (calibration, sex, spacing) pool.

    Windows stand in hash order in their pool and each takes the next one (the last takes the
    first), so every window gets a repeatable donor without forming pairs.
    """
    d = windows.where(~F.col("negative")).withColumn("_u", hash_uniform(seed, F.col(ident)))
    d = number_rows(d, group, ["_u", ident], F.floor(F.col("_u") * block), name="_i")
    d = cut_lineage(d.drop("_u"))
    n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    d = attach(d, n, group)
    nxt = d.select(*group, F.col("_i").alias("_j"), F.col(ident).alias("donor"))
    d = d.withColumn("_j", F.pmod(F.col("_i") + 1, F.col("_n")))
    return d.join(nxt, [*group, "_j"]).where(F.col("donor") != F.col(ident)).drop("_i", "_j", "_n")
