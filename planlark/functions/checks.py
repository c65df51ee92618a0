"""Errors that must be loud: a value that raises where a condition fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(value: Column, ok: Column, message: str) -> Column:
    """The value; an error where ``ok`` is false. A null condition passes: missing operands are dealt with elsewhere."""
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)))
