"""One-to-one matching of two tables on one axis within a caliper.

The rule is serial: treated rows choose in the order of how few reference rows stand within the
caliper (ties: the smaller value, then the smaller id), each takes the closest free reference row
(ties: the smaller value, then the smaller id), and none is used twice.

Rows of equal value are alike but for their id, so both sides are collapsed to (value, count) runs, and
a stratum that holds a third of the rows is one run. All reference runs rank the treated runs in the
same way, so the serial result is the only stable one, and proposals reach it in any order: a treated run
asks for room at the closest reference run that doesn't prefer others, a reference run keeps
the best of those who ask and sends the rest on. Refusals are final, since who is kept only gets better.

The axis is cut into blocks, and a round settles each block on its own: whoever asks for or holds room there is served in the
rule's order, and goes on past full runs until it is placed, has nothing left in reach, or its next choice
stands in another block, where it asks in the next round. Every other round the borders lie in the middle of the former blocks, so a
chain of displacements costs a round only where it leaves a block. Ids come in at the end, by rank inside a run.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators.ordered import lag_lead, number_rows, scan
from strideframe.operators.quantiles import balanced_blocks
from strideframe.session import cut_lineage

#: numbers of the axis (reference runs, and three probes for each treated run) that a round looks at as one block
LOOK = 1 << 18


def _ranked(df: DataFrame, keys: Sequence[str], value: str, ident: str) -> DataFrame:
    """Rows with their rank by id inside their value."""
    b = balanced_blocks(df.select(*keys, F.col(value).cast("double").alias("_v"), ident).where("_v is not null"), ident, "_ib")
    return number_rows(b, [*keys, "_v"], [ident], F.col("_ib"), "_rank").drop("_ib")


def _axis(treated: DataFrame, reference: DataFrame, keys: Sequence[str], caliper: float) -> tuple[DataFrame, DataFrame]:
    """Reference runs (keys, ``idx``, ``_v``, ``_k``, place ``_n``) numbered along the axis, and treated runs with the numbers around them.

    Probes at a treated value and at both ends of its caliper are sorted in among the reference runs; running
    counts give the numbers of the runs inside and how many rows they hold.
    """
    t = treated.groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    r = reference.groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    none = F.lit(0).cast("long")
    probe = lambda at, kind, order: t.select(*keys, at.alias("_at"), F.lit(order).alias("_o"), F.lit(kind).alias("_kind"), "_v", "_k", none.alias("_one"), none.alias("_units"))
    v = F.col("_v")
    events = probe(v - caliper, "low", 0).unionByName(r.select(*keys, v.alias("_at"), F.lit(1).alias("_o"), F.lit("run").alias("_kind"), "_v", "_k", F.lit(1).cast("long").alias("_one"), F.col("_k").alias("_units")))
    events = events.unionByName(probe(v, "at", 2)).unionByName(probe(v + caliper, "high", 2))
    events = balanced_blocks(cut_lineage(events), "_at", "_b")
    e = number_rows(events, keys, ["_at", "_o", "_kind", "_v"], F.col("_b"), "_n").drop("_b")
    e = cut_lineage(scan(e, keys, "_n", sums={"_runs": F.col("_one"), "_rows": F.col("_units")}))
    runs = e.where("_kind = 'run'").select(*keys, (F.col("_runs") - 1).alias("idx"), "_v", "_k", "_n")
    of = lambda kind, c: F.max(F.when(F.col("_kind") == kind, F.col(c)))
    around = e.where("_kind <> 'run'").groupBy(*keys, "_v").agg(
        F.max("_k").alias("_k"), of("low", "_runs").alias("_i0"), (of("high", "_runs") - 1).alias("_i1"), (of("at", "_runs") - 1).alias("_lo"), (of("high", "_rows") - of("low", "_rows")).alias("_supply")
    )
    return runs, around.withColumn("_hi", F.col("_lo") + 1)


_SIDES = ["_lo", "_lov", "_lon", "_hi", "_hiv", "_hin"]
_PARCEL = ["_supply", "_v", "_q", "_i0", "_i1", *_SIDES, "idx", "_n"]


def _settled(asked: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Parcels of a block after it has served all of them in the rule's order.

    ``_lo`` and ``_hi`` are the next choices on either side, ``idx`` is the one that holds the parcel or is asked
    next; a parcel that has nothing left in reach is dropped. The borders' neighbours come with the runs, so a next
    choice outside is known by its value and place.
    """
    runs = runs.sort_values("idx")
    base, m = int(runs["idx"].iloc[0]), len(runs)
    values = [runs["_before"].iloc[0], *runs["_rv"], runs["_after"].iloc[-1]]
    places = [runs["_nbefore"].iloc[0], *runs["_rn"], runs["_nafter"].iloc[-1]]
    room = [0, *(int(x) for x in runs["_size"]), 0]
    # the closest run with room at or before and at or after a place; 0 and m + 1 lie past the borders
    down, up = list(range(m + 2)), list(range(m + 2))

    def find(way: list[int], i: int) -> int:
        end = i
        while way[end] != end:
            end = way[end]
        while way[i] != end:
            way[i], i = end, way[i]
        return end

    out = []
    asked = asked.sort_values(["_supply", "_v"])
    for supply, v, q, i0, i1, lo, lov, lon, hi, hiv, hin in asked[_PARCEL[:-2]].itertuples(index=False, name=None):
        while q > 0:
            if lo >= i0 and base <= lo < base + m:
                p = find(down, lo - base + 1)
                lo, lov, lon = base + p - 1, values[p], places[p]
            if hi <= i1 and base <= hi < base + m:
                p = find(up, hi - base + 1)
                hi, hiv, hin = base + p - 1, values[p], places[p]
            if lo < i0 and hi > i1:
                break
            left = lo >= i0 and (hi > i1 or v - lov <= hiv - v)
            at, place = (lo, lon) if left else (hi, hin)
            p = at - base + 1
            inside = 1 <= p <= m
            take = min(q, room[p]) if inside else q
            out.append((supply, v, take, i0, i1, lo, lov, lon, hi, hiv, hin, at, place, not inside))
            q -= take
            if inside:
                room[p] -= take
                if not room[p]:
                    down[p], up[p] = p - 1, p + 1
    return pd.DataFrame(out, columns=[*_PARCEL, "_open"])


def caliper_match(treated: DataFrame, reference: DataFrame, value: str, ident: str, *, caliper: float, keys: Sequence[str] = (), rounds: list | None = None) -> DataFrame:
    """Pairs ``(keys, treated, reference, treated_value, reference_value)``; null values don't match.

    ``ident`` must be an integer and unique on either side; only rows with equal ``keys`` match. The number of rounds, the
    first choices being one, is added to ``rounds`` if given.
    """
    if not keys:
        treated, reference = (d.withColumn("_all", F.lit(1)) for d in (treated, reference))
    names = list(keys) or ["_all"]
    t_rows, r_rows = cut_lineage(_ranked(treated, names, value, ident)), cut_lineage(_ranked(reference, names, value, ident))
    runs, around = _axis(t_rows, r_rows, names, caliper)
    prio = F.struct("_supply", "_v")
    by = [*names, "_v"]
    runs = lag_lead(runs.select(*names, "idx", F.col("_v").alias("_rv"), F.col("_k").alias("_size"), F.col("_n").alias("_rn")), names, "idx", lags={"_before": "_rv", "_nbefore": "_rn"}, leads={"_after": "_rv", "_nafter": "_rn"})
    runs = cut_lineage(runs)
    side = lambda c: runs.select(*names, F.col("idx").alias(c), F.col("_rv").alias(f"{c}v"), F.col("_rn").alias(f"{c}n"))
    state = around.where("_supply > 0").join(side("_lo"), [*names, "_lo"], "left").join(side("_hi"), [*names, "_hi"], "left")
    first = (F.col("_lo") >= F.col("_i0")) & ((F.col("_hi") > F.col("_i1")) | (F.col("_v") - F.col("_lov") <= F.col("_hiv") - F.col("_v")))
    state = cut_lineage(state.select(
        *names, "_supply", "_v", F.col("_k").alias("_q"), "_i0", "_i1", *_SIDES, F.when(first, F.col("_lo")).otherwise(F.col("_hi")).alias("idx"),
        F.when(first, F.col("_lon")).otherwise(F.col("_hin")).alias("_n"), F.lit(True).alias("_open"),
    ))
    n = 1  # the first round is everyone's choice of the closest run
    # a side that is used up may have no value: its place is not looked at, so any number does
    filled = {"_lov": 0.0, "_hiv": 0.0, "_lon": -1, "_hin": -1}
    inner = {"_before": 0.0, "_after": 0.0, "_nbefore": -1, "_nafter": -1}
    schema = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in [*names, *_PARCEL, "_open"])

    def settle(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({c: [] for c in [*names, *_PARCEL, "_open"]})
        got = _settled(asked, block)
        for c in reversed(names):
            got.insert(0, c, asked[c].iloc[0])
        return got

    while state.where("_open").limit(1).count():
        block = lambda c: F.floor((F.col(c) + (LOOK // 2 if n % 2 else 0)) / LOOK).alias("_blk")  # noqa: B023, E731
        asked, held_by = state.fillna(filled).select("*", block("_n")), runs.fillna(inner).select("*", block("_rn"))
        state = cut_lineage(asked.groupBy(*names, "_blk").cogroup(held_by.groupBy(*names, "_blk")).applyInPandas(settle, schema))
        n += 1
    if rounds is not None:
        rounds.append(n)
    out = [*keys, "treated", "reference", "treated_value", "reference_value"]
    held = state.groupBy(*by, "_supply", "idx").agg(F.sum("_q").alias("_q")).join(runs.select(*names, "idx", "_rv"), [*names, "idx"]).withColumn("_prio", prio)
    # units: a reference run gives its smallest ids to the first in order, a treated run's smallest ids take the closest
    earlier = Window.partitionBy(*names, "idx").orderBy("_prio").rowsBetween(Window.unboundedPreceding, -1)
    closer = Window.partitionBy(*by).orderBy(F.abs(F.col("_rv") - F.col("_v")), "_rv").rowsBetween(Window.unboundedPreceding, -1)
    u = held.withColumn("_ra", F.coalesce(F.sum("_q").over(earlier), F.lit(0))).withColumn("_ta", F.coalesce(F.sum("_q").over(closer), F.lit(0)))
    u = u.select(*by, "_rv", "_ra", "_ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)).alias("_j"))
    u = u.select(*by, "_rv", (F.col("_ta") + F.col("_j")).alias("_rank"), (F.col("_ra") + F.col("_j")).alias("_rrank"))
    u = u.join(t_rows.withColumnRenamed(ident, "treated"), [*by, "_rank"])
    u = u.join(r_rows.select(*names, F.col("_v").alias("_rv"), F.col(ident).alias("reference"), F.col("_rank").alias("_rrank")), [*names, "_rv", "_rrank"])
    return u.select(*names, "treated", "reference", F.col("_v").alias("treated_value"), F.col("_rv").alias("reference_value")).select(*out)
