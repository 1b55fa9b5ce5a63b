"""Caliper matching and lifted centres, with SQL twins that choose one at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import lifting as L
from strideframe.operators.matching import caliper_match
from strideframe.plans.quality import _A, _C11, _C11_SQL, _RHS, _det
from strideframe.plans.registry import query
from strideframe.plans.tables import OBSERVATIONS_CTE, observations, table


def _match_sql(value: str, caliper: float) -> str:
    return f"""t AS (SELECT c_nationkey % 5 AS grp, c_custkey AS id, {value.format('c_acctbal')} AS v FROM customer), r AS MATERIALIZED (SELECT s_nationkey % 5 AS grp, s_suppkey AS id, {value.format('s_acctbal')} AS v, row_number() OVER (ORDER BY {value.format('s_acctbal')}, s_suppkey) AS n FROM supplier),
 s AS (SELECT t.grp, t.id, t.v, count(r.id) AS supply FROM t LEFT JOIN r ON r.grp = t.grp AND r.v BETWEEN t.v - {caliper} AND t.v + {caliper} GROUP BY t.grp, t.id, t.v),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY supply, v, id) AS k FROM s WHERE supply > 0),
 m AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS tid, CAST(NULL AS BIGINT) AS rid FROM o UNION ALL
  SELECT grp, k, CASE WHEN rid IS NULL THEN used ELSE list_append(used, rid) END, id, rid FROM (SELECT m.grp, o.k, m.used, o.id, arg_min(r.id, round(abs(r.v - o.v), 6) * 1000000 + r.n) AS rid
   FROM m JOIN o ON o.grp = m.grp AND o.k = m.k + 1 LEFT JOIN r ON r.grp = o.grp AND r.v BETWEEN o.v - {caliper} AND o.v + {caliper} AND NOT list_contains(m.used, r.id) GROUP BY m.grp, o.k, m.used, o.id))
SELECT m.grp, m.tid AS treated, m.rid AS reference, t.v AS treated_value, r.v AS reference_value FROM m JOIN t ON t.id = m.tid JOIN r ON r.id = m.rid"""


def _matched(spark, sf, value, caliper):
    t = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("grp"), F.col("c_custkey").alias("id"), value(F.col("c_acctbal")).alias("v"))
    r = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("grp"), F.col("s_suppkey").alias("id"), value(F.col("s_acctbal")).alias("v"))
    return caliper_match(t, r, "v", "id", caliper=caliper, keys=["grp"])


# Values in hundreds: long runs of equal values on both sides.
@query("WITH RECURSIVE " + _match_sql("CAST(floor({} / 100) * 100 AS DOUBLE)", 300.0))
def e18_caliper_match(spark, sf):
    return _matched(spark, sf, lambda c: (F.floor(c / 100) * 100).cast("double"), 300.0)


@query("WITH RECURSIVE " + _match_sql("CAST({} AS DOUBLE)", 150.0))
def e18_caliper_match_fine(spark, sf):
    return _matched(spark, sf, lambda c: c.cast("double"), 150.0)


# Peaks without identity: landmarks 3 and 7 of a frame stand for two animals, slots swap by camera.
def _peaks(spark, sf):
    o = observations(spark, sf).where(F.col("pos").isin(3, 7))
    cam = F.substring("camera", 5, 1).cast("long")
    slot = ((F.col("pos") - 3) / 4 + cam) % 2
    return o.select("track", "frame", "camera", slot.cast("int").alias("slot"), "u", F.when(F.col("conf") >= 0.05, F.col("v")).alias("v"), F.col("conf").alias("score"))


_REACH = 12.0


def _normal(rows: str, group: str) -> str:
    neq = ", ".join(f"sum({_A[0][i]} * {_A[0][k]} + {_A[1][i]} * {_A[1][k]}) AS n{i}{k}" for i in range(3) for k in range(i, 3))
    nrh = ", ".join(f"sum({_A[0][i]} * {_RHS[0]} + {_A[1][i]} * {_RHS[1]}) AS b{i}" for i in range(3))
    n = [[f"n{min(i, k)}{max(i, k)}" for i in range(3)] for k in range(3)]
    xyz = ", ".join(f"{_det([['b0', 'b1', 'b2'] if k == i else n[k] for k in range(3)])} / nullif({_det(n)}, 0) AS {'xyz'[i]}" for i in range(3))
    return f"SELECT {group}, {xyz} FROM (SELECT {group}, {neq}, {nrh} FROM {rows} GROUP BY {group})"


def _round_sql(r: int) -> str:
    src = f"k{r}"
    proj = [f"(c[{4 * i + 1}] * x + c[{4 * i + 2}] * y + c[{4 * i + 3}] * z{f' + c[{4 * i + 4}]' if i < 2 else ' + 1.0'})" for i in range(3)]
    return f"""pr{r} AS (SELECT a.track, a.frame, a.camera AS ca, b.camera AS cb, a.slot AS sa, b.slot AS sb, unnest([a.camera, b.camera]) AS camera, unnest([a.u, b.u]) AS u, unnest([a.v, b.v]) AS v, unnest([a.c, b.c]) AS c
  FROM {src} a JOIN {src} b ON b.track = a.track AND b.frame = a.frame AND b.camera > a.camera),
 pt{r} AS MATERIALIZED ({_normal(f"pr{r}", "track, frame, ca, cb, sa, sb")}),
 ds{r} AS (SELECT p.track, p.frame, ca, cb, sa, sb, k.camera, arg_min(k.slot, d * 1000 + k.slot) AS slot, arg_min(k.score, d * 1000 + k.slot) AS score, min(d) AS d FROM (SELECT p.*, k.camera, k.slot, k.score, sqrt(pow(k.u - {proj[0]} / {proj[2]}, 2) + pow(k.v - {proj[1]} / {proj[2]}, 2)) AS d
   FROM pt{r} p JOIN {src} k ON k.track = p.track AND k.frame = p.frame WHERE p.x IS NOT NULL) p, (SELECT 1) WHERE true GROUP BY ALL)""".replace("k.camera, arg_min(k.slot, d * 1000 + k.slot) AS slot, arg_min(k.score, d * 1000 + k.slot) AS score", "camera, arg_min(slot, d * 1000 + slot) AS slot, arg_min(score, d * 1000 + slot) AS score") + f""",
 ag{r} AS MATERIALIZED (SELECT * FROM ds{r} WHERE d <= {_REACH}),
 cn{r} AS (SELECT track, frame, ca, cb, sa, sb, count(*) AS n, sum(score) AS s FROM ag{r} GROUP BY ALL),
 be{r} AS (SELECT * FROM cn{r} QUALIFY row_number() OVER (PARTITION BY track, frame ORDER BY n DESC, round(s, 9) DESC, ca, cb, sa, sb) = 1 AND n >= 3),
 by{r} AS MATERIALIZED (SELECT k.*, be.n, be.s FROM be{r} be JOIN ag{r} ag USING (track, frame, ca, cb, sa, sb) JOIN {src} k ON k.track = ag.track AND k.frame = ag.frame AND k.camera = ag.camera AND k.slot = ag.slot),
 ce{r} AS (SELECT q.*, n.n, n.s FROM ({_normal(f"by{r}", "track, frame")}) q JOIN be{r} n USING (track, frame)),
 k{r + 1} AS MATERIALIZED (SELECT k.* FROM {src} k JOIN be{r} USING (track, frame) ANTI JOIN by{r} b ON b.track = k.track AND b.frame = k.frame AND b.camera = k.camera AND b.slot = k.slot)"""


_CENTRES = f"""WITH {OBSERVATIONS_CTE}, {_C11_SQL}, k0 AS MATERIALIZED (SELECT track, frame, camera, CAST(((pos - 3) / 4 + CAST(camera[5] AS BIGINT)) % 2 AS INT) AS slot, u, v, conf AS score, c FROM det JOIN dlt USING (camera) WHERE pos IN (3, 7) AND conf >= 0.05),
 {_round_sql(0)}, {_round_sql(1)}, cents AS (SELECT 0 AS rank, * FROM ce0 UNION ALL SELECT 1, * FROM ce1)"""


def _lifted(spark, sf):
    rows = ", ".join(f"('{c}', array({', '.join(f'{v!r}D' for v in vals)}))" for c, vals in _C11.items())
    return L.lift_centres(_peaks(spark, sf), spark.sql(f"SELECT * FROM VALUES {rows} AS t(camera, c)"), ["track", "frame"], reach=_REACH)


@query(f"{_CENTRES} SELECT track, frame, rank, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, n AS n_views, round(s, 6) AS score FROM cents")
def e22_lifted_centres(spark, sf):
    c = _lifted(spark, sf)
    return c.select("track", "frame", "rank", *[F.round(a, 5).alias(a) for a in "xyz"], "n_views", F.round("score", 6).alias("score"))
