"""Distances between two vector columns of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_sq(left: Column, right: Column) -> Column:
    """Squared Euclidean distance, summed in double precision.

    Vectors of different length raise an error instead of being padded.
    """
    total = F.aggregate(
        F.zip_with(_double(left), _double(right), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(left) == F.size(right), total).otherwise(
        F.raise_error(F.lit("vectors differ in dimension")).cast("double")
    )


def l2(left: Column, right: Column) -> Column:
    return F.sqrt(l2_sq(left, right))
