"""Threshold labels as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds and labels of each scale.
COHENS_D = ((0.2, "Negligible effect"), (0.5, "Small effect"), (0.8, "Medium effect"), (None, "Large effect"))
ETA_SQUARED = ((0.01, "Negligible effect"), (0.06, "Small effect"), (0.14, "Medium effect"), (None, "Large effect"))
CRAMERS_V = (
    (0.1, "Negligible association"),
    (0.3, "Weak association"),
    (0.5, "Moderate association"),
    (None, "Strong association"),
)
GRADES = ((60.0, "F"), (70.0, "D"), (80.0, "C"), (90.0, "B"), (None, "A"))


def ladder(value: Column, steps) -> Column:
    """First label whose upper bound is above the value; NULL stays NULL."""
    out = None
    for bound, label in steps:
        if bound is None:
            out = out.when(value.isNotNull(), F.lit(label))
        elif out is None:
            out = F.when(value < bound, F.lit(label))
        else:
            out = out.when(value < bound, F.lit(label))
    return out


def cohens_d_label(d: Column) -> Column:
    return ladder(F.abs(d), COHENS_D)


def eta_squared_label(e: Column) -> Column:
    return ladder(e, ETA_SQUARED)


def cramers_v_label(v: Column) -> Column:
    return ladder(v, CRAMERS_V)


def quality_grade(score: Column) -> Column:
    return ladder(score, GRADES)


def skewness_label(s: Column) -> Column:
    return (
        F.when(F.abs(s) < 0.5, F.lit("Approximately symmetric"))
        .when(s >= 1, F.lit("Highly right-skewed"))
        .when(s > 0, F.lit("Right-skewed (positive skew)"))
        .when(s <= -1, F.lit("Highly left-skewed"))
        .when(s.isNotNull(), F.lit("Left-skewed (negative skew)"))
    )


def kurtosis_label(k: Column) -> Column:
    return (
        F.when(F.abs(k) < 0.5, F.lit("Mesokurtic (normal-like tails)"))
        .when(k > 0, F.lit("Leptokurtic (heavy tails, more outliers)"))
        .when(k.isNotNull(), F.lit("Platykurtic (light tails, fewer outliers)"))
    )


def distribution_shape(skew: Column) -> Column:
    return (
        F.when(F.abs(skew) < 0.5, F.lit("Symmetric"))
        .when(skew > 0, F.lit("Right-skewed"))
        .otherwise(F.lit("Left-skewed"))
    )


def cardinality_class(unique_count: Column, unique_pct: Column) -> Column:
    return (
        F.when(unique_count <= 5, F.lit("Very Low"))
        .when(unique_count <= 20, F.lit("Low"))
        .when(unique_pct < 50, F.lit("Medium"))
        .otherwise(F.lit("High"))
    )


def correlation_strength(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, F.lit("strong")).when(F.abs(r) > 0.3, F.lit("moderate")).otherwise(F.lit("weak"))


def correlation_direction(r: Column) -> Column:
    return F.when(r > 0, F.lit("positive")).otherwise(F.lit("negative"))
