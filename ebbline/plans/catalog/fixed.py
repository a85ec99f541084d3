"""Queries: attribution and scoring of a model written down in full, so that SQL gives every value.

The model has four trees over tenure, monthly charges and a flag for month-to-month contracts: a stump on each and
one tree that splits tenure, then charges.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from ebbline.operators import attribute as A
from ebbline.operators import score as S
from ebbline.operators.histogram_trees import TreesModel
from ebbline.operators.tree_paths import tree_attribution
from ebbline.plans.catalog.registry import query, r6

NAMES = ["tenure", "MonthlyCharges", "monthly_contract"]
# Base log-odds; stumps as feature, threshold, value up to it, value above it; the tree of two splits.
BASE = -0.2
STUMPS = [(0, 12.0, 0.8, -0.3), (1, 70.0, -0.25, 0.45), (2, 0.5, -0.5, 0.6)]
TENURE_CUT, CHARGES_CUT, LOW, HIGH, OLD = 24.0, 60.0, 0.35, -0.15, 0.1


def _model() -> TreesModel:
    def leaf(value):
        return [-1, 0.0, -1, value, 0.0, 1.0]

    trees = [[[f, cut, 1, 0.0, 1.0, 2.0], leaf(low), leaf(high)] for f, cut, low, high in STUMPS]
    trees.append([[0, TENURE_CUT, 1, 0.0, 1.0, 3.0], [1, CHARGES_CUT, 3, 0.0, 1.0, 2.0], leaf(OLD), leaf(LOW), leaf(HIGH)])
    return TreesModel(trees=json.dumps({"forest": False, "base": BASE, "features": 3, "trees": trees}))


def _encoder() -> PipelineModel:
    """Takes raw rows; a number that cannot be read is 0."""
    number = "coalesce(try_cast(trim(cast(`{0}` as string)) as double), 0D) AS f_{0}"
    statement = f"SELECT *, {number.format('tenure')}, {number.format('MonthlyCharges')}, if(Contract = 'Month-to-month', 1D, 0D) AS f_contract FROM __THIS__"
    assemble = VectorAssembler(inputCols=["f_tenure", "f_MonthlyCharges", "f_contract"], outputCol="features")
    return PipelineModel(stages=[SQLTransformer(statement=statement), assemble])


def _pipeline() -> PipelineModel:
    return S.scoring_pipeline(_encoder(), _model())


def _contributions(t):
    encoded = _encoder().transform(t.base).select("customerID", "features")
    return tree_attribution(encoded, _model(), NAMES, encoded)


def _case(column: str, cut: float, low: float, high: float) -> str:
    return f"CASE WHEN {column}<={cut!r}e0 THEN {low!r}e0 ELSE {high!r}e0 END"


# Rows with the values of all trees (fx), the Shapley values of each (ph, long: pf) and the margin.
_STUMP = [_case(c, cut, low, high) for c, (_, cut, low, high) in zip(("x0", "x1", "x2"), STUMPS)]
FIXED = f"""x AS (SELECT "customerID", tenure*1e0 AS x0, "MonthlyCharges" AS x1, CASE WHEN "Contract"='Month-to-month' THEN 1e0 ELSE 0e0 END AS x2 FROM f),
    fx AS (SELECT *, {_STUMP[0]} AS v0, {_STUMP[1]} AS v1, {_STUMP[2]} AS v2,
      CASE WHEN x0>{TENURE_CUT!r}e0 THEN {OLD!r}e0 ELSE {_case('x1', CHARGES_CUT, LOW, HIGH)} END AS v3 FROM x),
    sh AS (SELECT AVG(CASE WHEN x0<={TENURE_CUT!r}e0 THEN 1e0 ELSE 0e0 END) AS young,
      AVG(CASE WHEN x1<={CHARGES_CUT!r}e0 THEN 1e0 ELSE 0e0 END) FILTER (x0<={TENURE_CUT!r}e0) AS cheap,
      AVG(v0) AS m0, AVG(v1) AS m1, AVG(v2) AS m2, AVG(v3) AS m3 FROM fx),
    by_set AS (SELECT fx.*, m0, m1, m2, m3,
      CASE WHEN x0>{TENURE_CUT!r}e0 THEN {OLD!r}e0 ELSE cheap*{LOW!r}e0+(1-cheap)*{HIGH!r}e0 END AS t0,
      young*{_case('x1', CHARGES_CUT, LOW, HIGH)}+(1-young)*{OLD!r}e0 AS t1 FROM fx CROSS JOIN sh),
    ph AS (SELECT "customerID", x0, x1, x2, {BASE!r}e0+m0+m1+m2+m3 AS base, v0-m0+(t0-m3+v3-t1)/2 AS p0, v1-m1+(t1-m3+v3-t0)/2 AS p1, v2-m2 AS p2,
      {BASE!r}e0+v0+v1+v2+v3 AS margin FROM by_set),
    pf AS (SELECT "customerID", base, margin, 'tenure' AS feature, x0 AS value, p0 AS phi FROM ph
      UNION ALL SELECT "customerID", base, margin, 'MonthlyCharges', x1, p1 FROM ph
      UNION ALL SELECT "customerID", base, margin, 'monthly_contract', x2, p2 FROM ph),
    pr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "customerID" ORDER BY ROUND(ABS(phi), 9) DESC, feature) AS place FROM pf)"""


@query("x01d_contributions_of_a_known_model", FIXED + f""" SELECT "customerID", feature, {r6('value', 'value')}, {r6('phi', 'phi')}, {r6('base', 'base')} FROM pf""")
def _(t):
    return _contributions(t)


@query("x02c_importance_of_a_known_model", FIXED + f" SELECT feature, {r6('AVG(ABS(phi))', 'attribution_importance')} FROM pf GROUP BY 1")
def _(t):
    return A.attribution_importance(_contributions(t))


@query("c34c_totals_of_a_known_model", FIXED + f", i AS (SELECT feature, AVG(ABS(phi)) AS a FROM pf GROUP BY 1) SELECT {r6('SUM(a)', 'total_impact')}, {r6('AVG(a)', 'average_impact')} FROM i")
def _(t):
    return A.attribution_totals(A.attribution_importance(_contributions(t)))


def _ranked(t):
    """Contributions to 9 digits, so that equal ones are equal in every engine."""
    return _contributions(t).withColumn("phi", F.round("phi", 9))


@query(
    "x04c_local_contributions_of_a_known_model",
    FIXED + f""" SELECT "customerID", CAST(place AS INT) AS place, feature, {r6('value', 'value')}, {r6('phi', 'phi')}, {r6('ABS(phi)', 'abs_phi')},
    CASE WHEN ROUND(phi, 9)>0 THEN 'Increases Churn Risk' ELSE 'Decreases Churn Risk' END AS direction FROM pr WHERE place<=2""",
)
def _(t):
    return A.local_contributions(_ranked(t), top=2)


@query(
    "x05c_waterfall_of_a_known_model",
    FIXED + f""", w AS (SELECT "customerID", LEAST(place, 2) AS place, COUNT(*) AS features, MIN(feature) AS feature, MIN(value) AS value, SUM(phi) AS phi, MAX(base) AS base
      FROM pr GROUP BY 1, 2),
    e AS (SELECT *, base + SUM(phi) OVER (PARTITION BY "customerID" ORDER BY place) AS last FROM w)
    SELECT "customerID", CAST(place AS INT) AS place, CASE WHEN features=1 THEN feature ELSE features || ' other features' END AS feature,
    {r6('CASE WHEN features=1 THEN value END', 'value')}, {r6('phi', 'phi')}, {r6('base', 'base')}, {r6('last-phi', 'start')}, {r6('last', '"end"')} FROM e""",
)
def _(t):
    return A.waterfall(_ranked(t), max_display=2)


@query("x07c_beeswarm_of_a_known_model", FIXED + f""", i AS (SELECT feature FROM pf GROUP BY 1 ORDER BY ROUND(AVG(ABS(phi)), 9) DESC, feature LIMIT 2)
    SELECT "customerID", feature, {r6('value', 'value')}, {r6('phi', 'phi')} FROM pf SEMI JOIN i USING (feature)""")
def _(t):
    return A.beeswarm(_contributions(t), 2)


# The contribution of tenure depends on charges through the last tree alone.
_BIN = "LEAST(CAST(FLOOR(COALESCE((value-low)/NULLIF(high-low, 0), 0e0)*10) AS INT), 9)"
RANKED = FIXED + f""", rg AS (SELECT feature, MIN(value) AS low, MAX(value) AS high FROM pf GROUP BY 1),
    pb AS (SELECT "customerID", pf.feature, phi, value, {_BIN} AS bin FROM pf JOIN rg ON pf.feature=rg.feature),
    ce AS (SELECT o.feature, m.bin AS own_bin, o.bin, COUNT(*)*1e0 AS n, SUM(m.phi) AS s FROM pb o JOIN pb m ON o."customerID"=m."customerID"
      WHERE m.feature='tenure' AND o.feature<>'tenure' GROUP BY 1, 2, 3),
    li AS (SELECT feature, own_bin, SUM(n) AS n, SUM(s) AS s, SUM(s*s/n) AS between_bins FROM ce GROUP BY 1, 2),
    ra AS (SELECT feature, SUM(between_bins-s*s/n)/SUM(n) AS explained FROM li GROUP BY 1)"""


@query("x06c_interaction_ranking", RANKED + f" SELECT feature, {r6('explained', 'explained')} FROM ra")
def _(t):
    return A.interaction_ranking(_contributions(t), "tenure")


@query(
    "x06d_dependence_with_chosen_interaction",
    RANKED + f""", ch AS (SELECT feature FROM ra ORDER BY ROUND(explained, 9) DESC, feature LIMIT 1)
    SELECT a."customerID", {r6('a.value', 'value')}, {r6('a.phi', 'phi')}, {r6('b.value', 'interaction_value')}, b.feature AS interaction_feature
    FROM pf a JOIN pf b ON a."customerID"=b."customerID" JOIN ch ON b.feature=ch.feature WHERE a.feature='tenure'""",
)
def _(t):
    return A.dependence(_contributions(t), "tenure", "auto")


PROBABILITY = "1/(1+EXP(-margin))"
SCORED = FIXED + f", so AS (SELECT ph.*, {PROBABILITY} AS p FROM ph)"


@query("x03c_probability_of_a_known_model", SCORED + f""" SELECT "customerID", {r6('p', 'probability')} FROM so""")
def _(t):
    return S.score_batch(_pipeline(), t.base).select("customerID", F.col("Churn_Probability").alias("probability"))


@query(
    "s01d_scores_of_a_known_model",
    SCORED + f""" SELECT "customerID", CASE WHEN p>0.5 THEN 1 ELSE 0 END AS "Churn_Prediction", {r6('p', '"Churn_Probability"')}, {r6('ABS(p-0.5e0)*2', '"Prediction_Confidence"')} FROM so""",
)
def _(t):
    scored = S.score_batch(_pipeline(), t.base)
    return scored.select("customerID", "Churn_Prediction", "Churn_Probability", "Prediction_Confidence")


@query(
    "s02c_customers_of_a_known_model",
    SCORED + f""" SELECT "customerID", {r6('p', 'churn_probability')}, p>0.5 AS prediction, CASE WHEN p>0.7 THEN 'high' WHEN p>0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM so""",
)
def _(t):
    return S.score_customers(_pipeline(), t.base)


@query(
    "s04c_upload_without_a_key",
    SCORED + f""" SELECT ROW_NUMBER() OVER (ORDER BY "customerID") AS "customerID", {r6('CASE WHEN "customerID"%97<>0 THEN p END', 'churn_probability')},
    CASE WHEN "customerID"%97<>0 THEN CASE WHEN p>0.5 THEN 'Yes' ELSE 'No' END END AS prediction,
    CASE WHEN "customerID"%97=0 THEN 'not a number: MonthlyCharges' END AS error FROM f JOIN so USING ("customerID")""",
)
def _(t):
    # Rows come in the order of the customers, their number is not in the table, and some charges are unreadable.
    charges = F.when(F.col("customerID") % 97 == 0, "n/a").otherwise(F.col("MonthlyCharges").cast("string"))
    upload = t.base.orderBy("customerID").select("Contract", "PaymentMethod", "InternetService", "tenure", charges.alias("MonthlyCharges"))
    return S.score_upload(_pipeline(), upload)
