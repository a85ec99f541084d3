"""Cleaning of the raw customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.config import ROLES, ColumnRoles
from ebbline.functions.scalars import binary_outcome, text_to_number


def clean(df: DataFrame, roles: ColumnRoles = ROLES) -> DataFrame:
    """Numbers out of text, blanks to 0, flags to text, label to 0/1 - one narrow projection.

    The key stays in the row (it is never a feature). A missing ``TotalCharges`` becomes 0; no
    other column is filled. Columns that are absent are skipped, so an upload without a label
    can be cleaned too.
    """
    changes = {}
    if "TotalCharges" in df.columns:
        is_text = isinstance(df.schema["TotalCharges"].dataType, T.StringType)
        total = text_to_number("TotalCharges") if is_text else F.nanvl(
            F.col("TotalCharges").cast("double"), F.lit(None)
        )
        changes["TotalCharges"] = F.coalesce(total, F.lit(0.0))
    if "SeniorCitizen" in df.columns:
        changes["SeniorCitizen"] = F.col("SeniorCitizen").cast("string")
    if roles.target in df.columns:
        changes[roles.target] = binary_outcome(df, roles.target)
    return df.withColumns(changes)


def feature_columns(df: DataFrame, roles: ColumnRoles = ROLES) -> list[str]:
    """Columns that may enter a model: everything but the key and the label."""
    return [c for c in df.columns if c not in (roles.key, roles.target)]


def separate(df: DataFrame, roles: ColumnRoles = ROLES) -> tuple[DataFrame, DataFrame]:
    """Features and label as two projections; both keep the key, so they can be joined again."""
    return df.select(roles.key, *feature_columns(df, roles)), df.select(roles.key, roles.target)


def drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all named columns are present (NaN counts as missing)."""
    return df.dropna(subset=list(columns))


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Names of the numeric and the text columns, from the schema alone."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return {"numeric": numeric, "text": text}
