"""Landmark names, ids and keys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest16(text: Column) -> Column:
    """First 16 hex digits of the sha256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def order_digest(names: Column) -> Column:
    """Digest of an ordered array of names."""
    return digest16(F.array_join(names, "\n"))


def name_findings(present: Column, expected: Column) -> tuple[Column, Column]:
    """Sorted ``(missing, extra)`` names of a set against the expected set."""
    return F.array_sort(F.array_except(expected, present)), F.array_sort(F.array_except(present, expected))


def first_difference(a: Column, b: Column) -> Column:
    """0-based first position where two orders differ, null when equal."""
    spots = F.transform(F.arrays_zip(a.alias("p"), b.alias("q")), lambda s, i: F.when(~s["p"].eqNullSafe(s["q"]), i))
    return F.array_min(spots)


def contains_any(name: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.contains(p)
    return out


def glob_any(name: Column, patterns: Sequence[str]) -> Column:
    """Shell-style patterns (``*`` and ``?``), whole name."""
    out = F.lit(False)
    for p in patterns:
        rx = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in p)
        out = out | name.rlike(f"^{rx}$")
    return out


def body_part(name: Column) -> Column:
    """Body part of a landmark from its prefix."""
    return (
        F.when(name.startswith("Antenna") | name.startswith("Eye"), "head")
        .when(name.startswith("Scut"), "thorax")
        .when(name.startswith("Abd"), "abdomen")
        .when(name.startswith("Wing"), "wing")
        .when(name.rlike("^T[123][LR]"), "leg")
        .otherwise("other")
    )


def mirror_name(name: Column) -> Column:
    """Left/right counterpart: the side letter ends the part before the first underscore;
    midline names map to themselves."""
    head = F.substring_index(name, "_", 1)
    rest = F.substring(name, F.length(head) + 1, F.length(name))
    stem = F.substring(head, F.lit(1), F.length(head) - 1)
    return (
        F.when(head.endswith("L"), F.concat(stem, F.lit("R"), rest)).when(head.endswith("R"), F.concat(stem, F.lit("L"), rest)).otherwise(name)
    )


def session_matches(fly_id: Column, tag: str) -> Column:
    """``tag`` starts at a ``/`` boundary of the id and ends at ``_``, ``/`` or the end."""
    return fly_id.rlike(f"(^|/){re.escape(tag)}($|_|/)")


def recording_base(fly_id: Column) -> Column:
    """Last path component."""
    return F.element_at(F.split(fly_id, "/"), -1)


def natural_key(key: Column) -> Column:
    """Number at the end of a key, for ordering ``bout_2`` before ``bout_10``."""
    return F.regexp_extract(key, r"(\d+)$", 1).try_cast("long")


def frameset_parts(key: Column) -> tuple[Column, Column, Column]:
    """``<recording>/Frame_<n>/fly<id>`` -> recording, frame, fly."""
    rx = r"^(.*)/Frame_(\d+)/fly(\d+)$"
    return F.regexp_extract(key, rx, 1), F.regexp_extract(key, rx, 2).try_cast("long"), F.regexp_extract(key, rx, 3).try_cast("int")


def image_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def sex_chain(*candidates: Column) -> Column:
    """First known value; ``unknown`` counts as missing."""
    return F.coalesce(*[F.nullif(c, F.lit("unknown")) for c in candidates], F.lit("unknown"))


def layered(*values: Column) -> Column:
    """Most specific present value of a layered field."""
    return F.coalesce(*values)
