"""Semantic versions and ranges as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(version: Column) -> Column:
    """Major, minor and patch as longs; missing or odd parts are 0; what follows a hyphen is left out."""
    clean = F.regexp_replace(F.regexp_replace(version, r"^[^0-9]*", ""), r"-.*$", "")
    parts = F.split(clean, r"\.")
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^\d{1,18}", 0), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))
    return F.array(part(0), part(1), part(2))


def stated(version: Column) -> Column:
    """How many parts a version states."""
    return F.size(F.split(F.regexp_replace(F.regexp_replace(version, r"^[^0-9]*", ""), r"-.*$", ""), r"\."))


def _one(version: Column, rng: Column) -> Column:
    """A single comparison: ^ ~ >= > <= < = or a version in part."""
    v, r, n = numbers(version), numbers(rng), stated(rng)
    major, minor, patch = v[0] == r[0], v[1] == r[1], v[2] >= r[2]
    after = v >= r  # arrays compare part by part
    caret = F.when((r[0] == 0) & (r[1] == 0) & (n > 2), major & minor & patch).when((r[0] == 0) & (n > 1), major & minor & patch).otherwise(major & after)
    tilde = F.when(n > 1, major & minor & patch).otherwise(major)
    exact = major & ((n < 2) | minor) & ((n < 3) | (v[2] == r[2]))
    return (
        F.when(rng.isin("*", "", "x", "latest"), True)
        .when(rng.startswith("^"), caret).when(rng.startswith("~"), tilde)
        .when(rng.startswith(">="), after).when(rng.startswith(">"), v > r)
        .when(rng.startswith("<="), v <= r).when(rng.startswith("<"), v < r)
        .otherwise(exact)
    )


def satisfies(version: Column, rng: Column) -> Column:
    """F-19: whether a version lies in a range: alternatives by ``||``, all of several comparisons,
    and hyphen ranges. Prereleases count as their release."""
    hyphen = r"^\s*(\S+)\s+-\s+(\S+)\s*$"

    def alternative(part: Column) -> Column:
        t = F.trim(part)
        low, high = F.regexp_extract(t, hyphen, 1), F.regexp_extract(t, hyphen, 2)
        every = F.forall(F.split(t, r"\s+"), lambda c: _one(version, c))
        return F.when(t.rlike(hyphen), (numbers(version) >= numbers(low)) & (numbers(version) <= numbers(high))).otherwise(every)

    return F.exists(F.split(rng, r"\|\|"), alternative)


def specificity(rng: Column) -> Column:
    """J-17: 3 for an exact version, 2 for ~, 1 for ^, 0 for what is wider."""
    return F.when(rng.rlike(r"^=?\d+\.\d+\.\d+$"), 3).when(rng.startswith("~"), 2).when(rng.startswith("^"), 1).otherwise(0)


def is_prerelease(version: Column) -> Column:
    return version.contains("-")
