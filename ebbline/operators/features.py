"""Derived features of a cleaned customer table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.config import ROLES, ColumnRoles
from ebbline.functions.scalars import count_yes, cut

# Band edges (right-closed) and band names.
TENURE_BANDS = ((0, 12, 24, 48, math.inf), ("0-1yr", "1-2yr", "2-4yr", "4+yr"))
TENURE_BANDS_REPORT = ((0, 12, 24, 60, 100), ("0-1yr", "1-2yr", "2-5yr", "5+yr"))


def tenure_band(column: str = "tenure"):
    return cut(column, *TENURE_BANDS)


def tenure_band_report(column: str = "tenure"):
    return cut(column, *TENURE_BANDS_REPORT)


def charge_tenure_ratio():
    return F.try_divide(F.col("TotalCharges"), F.col("tenure") + 1)


def monthly_to_total_ratio():
    return F.try_divide(F.col("MonthlyCharges"), F.col("TotalCharges") + 1)


def engineer(df: DataFrame, roles: ColumnRoles = ROLES) -> DataFrame:
    """Add every derived feature whose inputs are present; narrow, no shuffle."""
    have = set(df.columns)
    new = {}
    if "tenure" in have:
        new["tenure_group"] = tenure_band()
    if {"MonthlyCharges", "TotalCharges", "tenure"} <= have:
        new["charge_tenure_ratio"] = charge_tenure_ratio()
        new["monthly_to_total_ratio"] = monthly_to_total_ratio()
    services = [c for c in roles.services if c in have]
    if services:
        new["total_services"] = count_yes(services)
    return df.withColumns(new) if new else df
