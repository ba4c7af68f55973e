"""Slice geometry as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross(a: Column, b: Column) -> Column:
    term = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(term(1, 2), term(2, 0), term(0, 1))


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def slice_normal(orientation: Column) -> Column:
    """Unit normal of the row and column cosines; (0, 0, 1) where there are not six or they do not span a plane."""
    n = cross(F.slice(orientation, 1, 3), F.slice(orientation, 4, 3))
    length = F.sqrt(dot(n, n))
    flat = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return F.when((F.size(orientation) == 6) & (length > 1e-6), F.transform(n, lambda x: x / length)).otherwise(flat)


def slice_position(position: Column, orientation: Column) -> Column:
    return dot(position, slice_normal(orientation))


def plane(orientation: Column) -> Column:
    """By the largest absolute component of the normal, the first of equals."""
    a = F.transform(slice_normal(orientation), lambda x: F.abs(x))
    return F.when((a[0] >= a[1]) & (a[0] >= a[2]), "Sagittal").when(a[1] >= a[2], "Coronal").otherwise("Axial")
