"""Batch scoring of customers: narrow maps over the input, any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import ROLES, ColumnRoles
from ebbline.functions.scalars import (
    confidence,
    decide,
    key_factors,
    recommendations,
    risk_tier,
    text_to_number,
    yes_no,
)
from ebbline.operators.encode import source_column
from ebbline.sources.readers import require_columns


def scoring_pipeline(encoder: PipelineModel, model: Model) -> PipelineModel:
    """Encoder and classifier as one saveable pipeline that takes raw rows."""
    return PipelineModel(stages=[encoder, model])


def _probabilities(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """Input columns plus ``probability`` of the positive class."""
    scored = pipeline.transform(df)
    positive = vector_to_array("probability")[1]
    return scored.select(*df.columns, positive.alias("probability"))


def score_batch(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """Input plus prediction, probability and confidence."""
    return _probabilities(pipeline, df).select(
        *df.columns,
        decide("probability").alias("Churn_Prediction"),
        F.col("probability").alias("Churn_Probability"),
        confidence("probability").alias("Prediction_Confidence"),
    )


def score_customers(
    pipeline: PipelineModel, df: DataFrame, threshold: float = 0.5, key: str = ROLES.key
) -> DataFrame:
    """Probability, yes/no decision and risk level per customer."""
    return _probabilities(pipeline, df).select(
        key,
        F.col("probability").alias("churn_probability"),
        (F.col("probability") > threshold).alias("prediction"),
        F.lower(risk_tier("probability")).alias("risk_level"),
    )


def top_source_columns(importance: DataFrame, top: int = 5, roles: ColumnRoles = ROLES) -> list[str]:
    """Table columns behind the ``top`` most important encoded features, most important first."""
    rows = importance.orderBy(F.desc("importance"), "feature").limit(top).collect()
    return list(dict.fromkeys(source_column(r["feature"], roles) for r in rows))


def explain_scores(
    pipeline: PipelineModel, df: DataFrame, top_features: Sequence[str], key: str = ROLES.key
) -> DataFrame:
    """Scores with risk level, key factors and recommended actions."""
    names = F.array(*[F.lit(n) for n in top_features]).cast("array<string>")
    tier = risk_tier("probability")
    return _probabilities(pipeline, df).select(
        key,
        F.col("probability").alias("churn_probability"),
        yes_no(decide("probability")).alias("prediction"),
        confidence("probability").alias("confidence"),
        tier.alias("risk_level"),
        key_factors(names).alias("key_factors"),
        recommendations(tier).alias("recommendations"),
    )


def _row_error(roles: ColumnRoles) -> Column:
    """Text naming the numeric columns of a row that cannot be read; null for a good row."""
    bad = [
        F.when(text_to_number(F.col(c).cast("string")).isNull(), F.lit(c))
        for c in roles.numeric
        if c != "TotalCharges"
    ]
    names = F.concat_ws(", ", *bad)
    return F.when(names != "", F.concat(F.lit("not a number: "), names))


def numbered(df: DataFrame, name: str = "row_number") -> DataFrame:
    """df with its row numbers from 1, in the order in which the rows are read.

    The number is the place within the partition plus the rows of all partitions before it: one counting pass, no
    sort and no shuffle of rows. One count a partition is joined back. The rows are persisted, so that both passes see
    the same partitions.
    """
    own = F.monotonically_increasing_id()
    placed = df.select("*", F.shiftright(own, 33).alias("_part"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    found = placed.join(F.broadcast(starts), "_part")
    return found.select((F.col("_start") + F.col("_place") + 1).alias(name), *df.columns)


def score_upload(
    pipeline: PipelineModel, df: DataFrame, roles: ColumnRoles = ROLES
) -> DataFrame:
    """Score an uploaded table that may lack optional columns or hold bad rows.

    Missing required columns reject the upload. Other absent feature columns are filled as
    missing. A row with an unreadable number gets an ``error`` and no score; the rest is scored.
    An upload without the key column gets row numbers as its key, in its order.
    """
    require_columns(df)
    keyed = df if roles.key in df.columns else numbered(df, roles.key)
    absent = {c: F.lit(None).cast("string") for c in roles.features if c not in df.columns}
    complete = keyed.withColumns(absent) if absent else keyed
    scored = _probabilities(pipeline, complete.withColumn("error", _row_error(roles)))
    good = F.col("error").isNull()
    return scored.select(
        roles.key,
        F.when(good, F.col("probability")).alias("churn_probability"),
        F.when(good, yes_no(decide("probability"))).alias("prediction"),
        "error",
    )
