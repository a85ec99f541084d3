"""Column expressions: cleaning, banding, risk tiers and report labels. All JVM-side."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Risk tier borders, rule score parts, key factor texts, and the actions per tier.
HIGH_RISK, MEDIUM_RISK = 0.7, 0.3
RULE_HIGH_RISK, RULE_MEDIUM_RISK = 0.5, 0.3
RULE_BASE, RULE_CAP = 0.3, 0.9
RULE_CONTRACT = {"Month-to-month": 0.3, "One year": 0.1}
RULE_SHORT_TENURE, RULE_HIGH_CHARGES = 0.2, 0.1
SHORT_TENURE, HIGH_CHARGES = 12, 70
CONTRACT_FACTOR = "Month-to-month contract (high risk)"
TENURE_FACTOR = ("Low tenure (", " months)")
CHARGES_FACTOR = ("High monthly charges ($", ")")
RECOMMENDATIONS = {
    "High": (
        "Consider offering loyalty discount",
        "Assign to dedicated retention specialist",
        "Review service quality issues",
    ),
    "Medium": (
        "Send personalized engagement offer",
        "Conduct satisfaction survey",
        "Monitor usage patterns",
    ),
    "Low": (
        "Maintain current service quality",
        "Continue regular engagement",
        "Monitor for any changes",
    ),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double_array(values: Iterable[float]) -> Column:
    """Literal ``array<double>``, built from one SQL text: hundreds of literals cost one call."""

    def literal(v: float) -> str:
        return f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)!r}')"

    return F.expr(f"cast(array({', '.join(map(literal, values))}) as array<double>)")


def text_to_number(c: Column | str) -> Column:
    """Text to double; blanks and other non-numbers (and NaN) become null, never an error."""
    number = F.trim(_col(c)).try_cast("double")
    return F.when(~F.isnan(number), number)


def label_to_int(c: Column | str) -> Column:
    """Yes is 1, No is 0, anything else is null."""
    return F.when(_col(c) == "Yes", 1).when(_col(c) == "No", 0)


def binary_outcome(df: DataFrame, name: str) -> Column:
    """Outcome as 0/1 whatever its type: text is mapped, numbers and booleans pass through."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return label_to_int(name)
    return F.col(name).cast("int")


def outcome_value(df: DataFrame, name: str) -> Column:
    """Outcome as a number: a text label as 0/1, whole numbers and booleans as such, others as double.

    NaN counts as unknown.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return label_to_int(name)
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int")
    if isinstance(kind, T.IntegralType):
        return F.col(name)
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def cut(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands ``(edge[i], edge[i+1]]``; values outside every band are null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    x = _col(c)
    band = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = x > F.lit(low)
        if not math.isinf(high):
            inside = inside & (x <= F.lit(high))
        band = F.when(inside, label) if band is None else band.when(inside, label)
    return band


def confidence(p: Column | str) -> Column:
    """Distance of a probability from 0.5, scaled to 0..1."""
    return F.abs(_col(p) - 0.5) * 2


def decide(p: Column | str, threshold: Column | float = 0.5) -> Column:
    """1 when the probability is strictly above the threshold."""
    return (_col(p) > threshold).cast("int")


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").otherwise("No")


def risk_tier(
    p: Column | str, high: float = HIGH_RISK, medium: float = MEDIUM_RISK
) -> Column:
    p = _col(p)
    return F.when(p > high, "High").when(p > medium, "Medium").otherwise("Low")


def rule_score(
    contract: Column | str = "Contract",
    tenure: Column | str = "tenure",
    charges: Column | str = "MonthlyCharges",
) -> Column:
    """Heuristic churn score from contract, tenure and monthly charges, at most 0.9."""
    score = F.lit(RULE_BASE)
    for level, part in RULE_CONTRACT.items():
        score = score + F.when(_col(contract) == level, part).otherwise(0.0)
    score = score + F.when(_col(tenure) < SHORT_TENURE, RULE_SHORT_TENURE).otherwise(0.0)
    score = score + F.when(_col(charges) > HIGH_CHARGES, RULE_HIGH_CHARGES).otherwise(0.0)
    return F.least(score, F.lit(RULE_CAP))


def rule_tier(score: Column | str) -> Column:
    return risk_tier(score, high=RULE_HIGH_RISK, medium=RULE_MEDIUM_RISK)


def count_yes(columns: Iterable[str]) -> Column:
    """How many of the columns hold 'Yes'; nulls count as no."""
    total = F.lit(0)
    for name in columns:
        total = total + F.coalesce((F.col(name) == "Yes").cast("int"), F.lit(0))
    return total


def key_factors(top_features: Column) -> Column:
    """Plain-text risk factors of a customer, limited to the features in ``top_features``.

    The order of ``top_features`` decides the order of the texts.
    """

    def around(texts, column):
        return F.concat(F.lit(texts[0]), F.col(column).cast("string"), F.lit(texts[1]))

    contract = F.when(F.col("Contract") == "Month-to-month", CONTRACT_FACTOR)
    tenure = F.when(F.col("tenure") < SHORT_TENURE, around(TENURE_FACTOR, "tenure"))
    charges = F.when(F.col("MonthlyCharges") > HIGH_CHARGES, around(CHARGES_FACTOR, "MonthlyCharges"))
    texts = F.transform(
        top_features,
        lambda name: F.when(name == "Contract", contract)
        .when(name == "tenure", tenure)
        .when(name == "MonthlyCharges", charges),
    )
    return F.array_compact(texts)


def recommendations(tier: Column | str) -> Column:
    """The three actions of a risk tier as ``array<string>``."""
    lookup = []
    for name, actions in RECOMMENDATIONS.items():
        lookup += [F.lit(name), F.array(*[F.lit(a) for a in actions])]
    return F.create_map(*lookup)[_col(tier)]


def effect_flag(effect: Column | str, margin: float = 0.05) -> Column:
    return F.when(_col(effect) > margin, "HIGH").when(_col(effect) < -margin, "LOW").otherwise("none")


def correlation_strength(r: Column | str) -> Column:
    size = F.abs(_col(r))
    return F.when(size > 0.3, "strong").when(size > 0.1, "moderate").otherwise("weak")


def direction(x: Column | str) -> Column:
    return F.when(_col(x) > 0, "increases").otherwise("decreases")


def relative_effect(effect: Column | str, base: Column | str) -> Column:
    """Effect over base, 0 when the base is not positive."""
    return F.when(_col(base) > 0, F.try_divide(_col(effect), _col(base))).otherwise(0.0)


def rate_class(percent: Column | str) -> Column:
    return F.when(_col(percent) > 30, "high").when(_col(percent) > 15, "moderate").otherwise("low")


def imbalanced(percent: Column | str) -> Column:
    return (_col(percent) < 20) | (_col(percent) > 80)


def looks_numeric(c: Column | str) -> Column:
    """True when the text is only digits once dots and dashes are taken out."""
    return F.translate(_col(c).cast("string"), ".-", "").rlike("^[0-9]+$")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 on a zero denominator, as the metric operators want."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))
