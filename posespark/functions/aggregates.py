"""Aggregates that pass over missing numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import nan


def known(value: Column) -> Column:
    """The value, null where it is NaN."""
    return F.when(~F.isnan(value), value)


def nan_mean(value: Column) -> Column:
    return F.coalesce(F.avg(known(value)), nan())


def nan_max(value: Column) -> Column:
    return F.coalesce(F.max(known(value)), nan())
