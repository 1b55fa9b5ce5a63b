"""Joins on ranges, nearest rows and keys, without all-pairs intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.ordered import BLOCK, scan


def interval_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, *, width: int = 4096, how: str = "inner"
) -> DataFrame:
    """Rows of ``points`` with the spans (inclusive) that contain them.

    Both sides meet in buckets of ``width`` units: a span is copied to every bucket it
    touches, a point has one bucket, so the join stays an equi-join on ``(keys, bucket)``
    and a long key is spread over its buckets.
    """
    s = spans.withColumn(
        "_bk",
        F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)).cast("long"), F.floor(F.col(end) / F.lit(width)).cast("long"))),
    )
    p = points.withColumn("_bk", F.floor(F.col(at) / F.lit(width)).cast("long"))
    cond: Column = F.col("p._bk") == F.col("s._bk")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    cond = cond & F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    j = p.alias("p").join(s.alias("s"), cond, how)
    keep = [F.col(f"p.{c}") for c in points.columns] + [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return j.select(*keep)


def nearest_sample(
    probes: DataFrame, samples: DataFrame, keys: Sequence[str], at: str, cols: Sequence[str], *, tolerance: Column, size: int = BLOCK
) -> DataFrame:
    """For each probe the nearest sample in either direction within ``tolerance``.

    ``samples`` must hold one row per (keys, at) and only usable rows; a tie goes to the
    earlier sample.  Probes and samples are merged on the order axis and the neighbours
    come from carried values, so there is no range join.
    """
    probe_ids = [c for c in probes.columns if c not in keys and c != at]
    both = samples.select(*keys, at, F.struct(F.col(at).alias("_at"), *cols).alias("_s")).join(
        probes.select(*keys, at).distinct().withColumn("_probe", F.lit(True)), [*keys, at], "full"
    )
    d = scan(both, keys, at, last={"_a": F.col("_s")}, next={"_b": F.col("_s")}, size=size).where(F.col("_probe"))
    da, db = F.col(at) - F.col("_a._at"), F.col("_b._at") - F.col(at)
    use_a = F.coalesce(da <= db, da.isNotNull())
    best = F.when(use_a, F.col("_a")).otherwise(F.col("_b"))
    dist = F.when(use_a, da).otherwise(db)
    d = d.withColumn("_best", F.when(dist <= tolerance, best)).select(
        *keys, at, F.when(F.col("_best").isNotNull(), F.col("_best._at")).alias("sample_at"), *[F.col(f"_best.{c}").alias(c) for c in cols]
    )
    return probes.join(d, [*keys, at]).select(*keys, at, *probe_ids, "sample_at", *cols)


def offset_windows(df: DataFrame, keys: Sequence[str], order: str, T: int, delta: int) -> DataFrame:
    """Starts ``f`` whose rows ``f, f + delta, ... f + (T-1) delta`` all exist (keys distinct)."""
    base = df.select(*keys, order).distinct()
    out = base
    for k in range(1, T):
        out = out.join(base.withColumn(order, F.col(order) - k * delta), [*keys, order], "left_semi")
    return out


def missing_work(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without output."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def map_positions(slots: DataFrame, plan: DataFrame, camera: str = "camera", slot: str = "slot") -> DataFrame:
    """Camera frame position of each slot: the slot itself for a camera without a plan, -1 where
    the plan has no position."""
    planned = plan.select(camera).distinct().withColumn("_planned", F.lit(True))
    d = slots.join(plan.select(camera, slot, "position"), [camera, slot], "left").join(planned, camera, "left")
    return d.withColumn("position", F.when(F.col("_planned").isNull(), F.col(slot)).otherwise(F.coalesce("position", F.lit(-1)))).drop("_planned")


def pair_rows(df: DataFrame, bout: Sequence[str], fly: str, cols: Sequence[str]) -> DataFrame:
    """Both animals of a bout side by side (``_0`` and ``_1`` columns)."""
    a, b = (df.where(F.col(fly) == i).select(*bout, *[F.col(c).alias(f"{c}_{i}") for c in cols]) for i in (0, 1))
    return a.join(b, list(bout))


def consecutive_pairs(df: DataFrame, keys: Sequence[str], order: str, kind: str, first: str, second: str, *, size: int = BLOCK) -> DataFrame:
    """Rows of kind ``first`` whose next row along a dense order is of kind ``second``."""
    from strideframe.operators.ordered import lag_lead

    d = lag_lead(df, keys, order, leads={"_k": kind}, size=size)
    return d.where((F.col(kind) == first) & (F.col("_k") == second)).select(*keys, F.col(order).alias("first"), (F.col(order) + 1).alias("second"))


def unpaired(rows: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(pairs.select(*keys).distinct(), list(keys), "left_anti")


#: rows that one task groups
ROWS_PER_TASK = 1 << 20


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Rows dealt by key to as many tasks as the table asks for, so that grouping them afterwards takes bounded memory.

    Nearly every key is its own group: adding up before the exchange would hold a whole split in memory for nothing.
    """
    n = -(-(df.count() if rows is None else rows) // ROWS_PER_TASK)
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left join on keys that must be unique on both sides, and the keys that are not."""

    def repeated(d: DataFrame, side: str) -> DataFrame:
        return dealt(d.select(*keys), keys).groupBy(*keys).count().where(F.col("count") > 1).select(*keys, F.lit(side).alias("side"), "count")

    return left.join(right, list(keys), "left"), repeated(left, "left").unionByName(repeated(right, "right"))


def match_length(clips: DataFrame, bouts: DataFrame, keys: Sequence[str], *, tolerance: int = 1) -> DataFrame:
    """Bouts of the same recording whose length is within ``tolerance`` of a clip's: the match
    when there is exactly one, otherwise how many there were."""
    near = clips.withColumn("_len", F.explode(F.sequence(F.col("clip_len") - tolerance, F.col("clip_len") + tolerance)))
    hits = near.join(bouts.select(*keys, "bout", F.col("n_frames").alias("_len")), [*keys, "_len"])
    per = hits.groupBy(*keys, "clip").agg(F.count(F.lit(1)).alias("n_matches"), F.min("bout").alias("_b"))
    out = clips.join(per, [*keys, "clip"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return out.withColumn("bout", F.when(F.col("n_matches") == 1, F.col("_b"))).drop("_b")


def closest_reference(targets: DataFrame, candidates: DataFrame, *, size: int = BLOCK) -> DataFrame:
    """For every target (``n``, ``sign``) the candidate going the same way with the best count.

    That is the next count at or above the one asked for, else the highest; the lowest id on
    ties.  Without a candidate going the same way the rule applies to all; without any, or with
    a null count, there is no match.  Equal counts are one row, and the next one is looked up
    along the counts of a way, so no target meets all candidates.
    """
    have = candidates.where(F.col("n") > 0)
    way, ways = F.when(F.col("sign") > 0, "up").when(F.col("sign") < 0, "down").when(F.col("sign") == 0, "flat"), F.lit("any")
    pooled = have.select(F.explode(F.array(way, ways)).alias("_way"), "n", "id").where("_way is not null").groupBy("_way", "n").agg(F.min("id").alias("id"))
    top = pooled.groupBy("_way").agg(F.max_by("id", "n").alias("_top"))
    asked = targets.where("n is not null").select("sign", "n").distinct().withColumn("_own", way)
    asked = asked.join(top.select(F.col("_way").alias("_own"), F.lit(True).alias("_has")), "_own", "left")
    asked = asked.select("sign", "n", F.when(F.col("_has"), F.col("_own")).otherwise(ways).alias("_way"))
    steps = pooled.unionByName(asked.select("_way", "n", F.lit(None).cast(pooled.schema["id"].dataType).alias("id"))).groupBy("_way", "n").agg(F.min("id").alias("id"))
    up = scan(steps, ["_way"], "n", next={"_up": F.col("id")}, size=size)
    best = asked.join(up.select("_way", "n", "_up"), ["_way", "n"]).join(top, "_way", "left").select(F.col("sign").alias("_sign"), F.col("n").alias("_n"), F.coalesce("_up", "_top").alias("match"))
    return targets.join(best, F.col("n").eqNullSafe(F.col("_n")) & F.col("sign").eqNullSafe(F.col("_sign")), "left").select(*targets.columns, "match")
