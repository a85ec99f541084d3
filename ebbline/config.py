"""Declared column roles, the raw table schema and the default parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column names and category texts of the customer table.
CATEGORICAL = (
    "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
)
NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges")
SERVICES = (
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies",
)
TREATMENTS = ("Contract", "PaymentMethod", "InternetService")
CONFOUNDERS = ("tenure", "MonthlyCharges", "SeniorCitizen", "Partner")
SCORING_REQUIRED = ("tenure", "MonthlyCharges", "Contract", "PaymentMethod")


@dataclass(frozen=True)
class ColumnRoles:
    """Which column plays which part; operators take roles from here, not from type guessing."""

    key: str = "customerID"
    target: str = "Churn"
    categorical: tuple[str, ...] = CATEGORICAL
    numeric: tuple[str, ...] = NUMERIC
    services: tuple[str, ...] = SERVICES
    treatments: tuple[str, ...] = TREATMENTS
    confounders: tuple[str, ...] = CONFOUNDERS

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


ROLES = ColumnRoles()


@dataclass(frozen=True)
class CostMatrix:
    """Money per outcome used by the business cost metrics."""

    fp_cost: float = 100.0
    fn_cost: float = 500.0
    tp_benefit: float = 300.0
    tn_benefit: float = 0.0


@dataclass(frozen=True)
class CampaignValue:
    """Money per outcome used by the threshold sweep."""

    tp_value: float = 500.0
    fp_cost: float = 50.0
    fn_cost: float = 500.0


RANDOM_SEED = 42
TEST_SHARE = 0.2
FOLDS = 5


def raw_schema(roles: ColumnRoles = ROLES) -> T.StructType:
    """Explicit schema of the raw customer file; ``TotalCharges`` is text with blanks."""
    order = (
        "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
        "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
        "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
        "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
    )
    special = {
        "SeniorCitizen": T.IntegerType(),
        "tenure": T.IntegerType(),
        "MonthlyCharges": T.DoubleType(),
    }
    return T.StructType([T.StructField(c, special.get(c, T.StringType())) for c in order])
