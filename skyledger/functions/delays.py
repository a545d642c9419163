"""Delay tiers and the three notions of a late flight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier labels by upper bound in minutes, and the open last tier.
TIERS = [(0, "No Delay"), (15, "Minor"), (60, "Major")]
LAST_TIER = "Severe"
CATEGORIES = ["No Delay", "Minor", "Major", "Severe"]

# The same tiers under the labels of the data profile.
PROFILE_LABELS = {
    "No Delay": "No Delay",
    "Minor": "Minor (1-15 dk)",
    "Major": "Major (16-60 dk)",
    "Severe": "Severe (60+ dk)",
}
UNKNOWN = "Unknown"
PROFILE_ORDER = [*PROFILE_LABELS.values(), UNKNOWN]

# Fixed value: minutes after which a flight counts as late.
LATE_AFTER = 15


def delay_category(
    minutes: Column, null_as: str | None = LAST_TIER, labels: dict[str, str] | None = None
) -> Column:
    """Tier of an arrival delay.

    ``null_as`` is the answer for a missing delay (cancelled and diverted
    flights): ``"Severe"`` as the silver table has it, ``None`` as the text
    path has it, ``"Unknown"`` as the data profile has it.
    """
    names = labels or {}
    tier = F.when(minutes.isNull(), F.lit(null_as).cast("string"))
    for bound, label in TIERS:
        tier = tier.when(minutes <= bound, F.lit(names.get(label, label)))
    return tier.otherwise(F.lit(names.get(LAST_TIER, LAST_TIER)))


def is_delayed(minutes: Column) -> Column:
    """More than 15 minutes late. A missing delay is not late."""
    return F.coalesce(minutes > LATE_AFTER, F.lit(False))


def arrived_late(minutes: Column) -> Column:
    """Any positive arrival delay, the filter of the root-cause figures."""
    return minutes > 0
