"""Listing-age buckets. Two vocabularies share the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper edges in hours, and the labels of the marts and of the analyses.
EDGES = (24, 72, 168, 720)
MART = ("0_24h", "24_72h", "3_7d", "8_30d", "gt_30d")
USER = ("0_24h", "1_3d", "3_7d", "7_30d", "gt_30d")


def bucket(hours: Column, labels: Sequence[str] = MART) -> Column:
    out = F.when(hours.isNull(), "unknown")
    for edge, label in zip(EDGES, labels, strict=False):
        out = out.when(hours < edge, label)
    return out.otherwise(labels[-1])


def ordinal(label: Column, labels: Sequence[str] = USER) -> Column:
    """1.. in order of age; 99 for unknown."""
    at = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(at > 0, at.cast("int")).otherwise(99)
