"""Nested JSON attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def costs_finite(summary: Column) -> Column:
    """Every ``*cost*`` entry of a JSON summary is a finite number (true when there is none)."""
    m = F.from_json(summary, "map<string,double>", {"allowNonNumericNumbers": "true"})
    costs = F.map_values(F.map_filter(m, lambda k, v: F.lower(k).contains("cost")))
    return F.forall(costs, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def gate_text(**settings: Column) -> Column:
    """Settings as JSON with sorted keys; absent settings are left out."""
    return F.to_json(F.struct(*[settings[k].alias(k) for k in sorted(settings)]))


def fly_sex(sex_doc: Column, fly: Column) -> Column:
    """Sex of one animal from a sex document: the per-animal table, else the male's number."""
    doc = F.from_json(sex_doc, "identity string, sex_by_fly map<string,string>, male_fly int")
    named = doc["sex_by_fly"][fly.cast("string")]
    by_table = F.when(named.isin("male", "female"), named).otherwise("unknown")
    by_male = F.when(doc["male_fly"].isNull(), "unknown").when(doc["male_fly"] == fly, "male").otherwise("female")
    return F.when(~F.coalesce(doc["identity"] == "sex", F.lit(False)), "unknown").when(doc["sex_by_fly"].isNotNull(), by_table).otherwise(by_male)
