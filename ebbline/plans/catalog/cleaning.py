"""Queries: scans, cleaning, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.config import ROLES, raw_schema
from ebbline.functions import scalars as S
from ebbline.operators import clean as C
from ebbline.operators import effects as E
from ebbline.operators import evaluate as V
from ebbline.operators import features as X
from ebbline.operators import profile as P
from ebbline.operators import splitting
from ebbline.plans.catalog.registry import query, r6
from ebbline.session import shared_folder
from ebbline.sources import readers, writers

ALL_RAW = """"customerID", gender, "SeniorCitizen", "Partner", "Dependents", tenure, "PhoneService",
 "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
 "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod" """


@query(
    "a01_raw_csv_scan",
    f"""SELECT * REPLACE (CAST("customerID" AS VARCHAR) AS "customerID",
    {r6('"MonthlyCharges"', '"MonthlyCharges"')}) FROM f""",
)
def _(t):
    # The customer table as a CSV file in the shared folder, read back with the declared schema.
    path = f"{shared_folder(t.spark)}/raw_csv"
    writers.write_table(t.base, path, "csv")
    return readers.read_customers(t.spark, path)


@query("a06_required_columns", 'SELECT "customerID", "Contract", "PaymentMethod", tenure FROM f')
def _(t):
    checked = readers.require_columns(t.base)
    return checked.select("customerID", "Contract", "PaymentMethod", "tenure")


@query(
    "p01_total_charges_number",
    f"""SELECT "customerID", {r6('TRY_CAST(TRIM("TotalCharges") AS DOUBLE)', 'total')} FROM f""",
)
def _(t):
    return t.base.select("customerID", S.text_to_number("TotalCharges").alias("total"))


@query("p02_features_without_key", 'SELECT * EXCLUDE ("customerID", "Churn") REPLACE (' + r6('"MonthlyCharges"', '"MonthlyCharges"') + ", " + r6('"TotalCharges"', '"TotalCharges"') + ") FROM cl")
def _(t):
    return t.clean.select(*C.feature_columns(t.clean))


@query(
    "p03_fill_total_charges",
    f"""SELECT "customerID", {r6('COALESCE(TRY_CAST(TRIM("TotalCharges") AS DOUBLE), 0)', 'total')} FROM f""",
)
def _(t):
    return t.clean.select("customerID", F.col("TotalCharges").alias("total"))


@query("p04_flag_to_text", 'SELECT "customerID", CAST("SeniorCitizen" AS VARCHAR) AS senior FROM f')
def _(t):
    return t.clean.select("customerID", F.col("SeniorCitizen").alias("senior"))


@query(
    "p05_label_map",
    """SELECT "customerID", CAST(CASE "Churn" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INT) AS label FROM f""",
)
def _(t):
    return t.base.select("customerID", S.label_to_int("Churn").alias("label"))


@query(
    "p06_binary_outcome",
    """SELECT "customerID", CAST(CASE "Churn" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INT) AS from_text,
    CAST("SeniorCitizen" AS INT) AS from_number FROM f""",
)
def _(t):
    return t.base.select(
        "customerID",
        S.binary_outcome(t.base, "Churn").alias("from_text"),
        S.binary_outcome(t.base, "SeniorCitizen").alias("from_number"),
    )


@query(
    "p07_clean_table",
    f"""SELECT * REPLACE ({r6('"MonthlyCharges"', '"MonthlyCharges"')},
    {r6('"TotalCharges"', '"TotalCharges"')}) FROM cl""",
)
def _(t):
    return t.clean


@query(
    "p08_features_and_label",
    """SELECT "Churn" AS label, COUNT(*) AS n, COUNT(DISTINCT "customerID") AS customers
    FROM cl GROUP BY 1""",
)
def _(t):
    features, label = C.separate(t.clean)
    return (
        features.join(label, ROLES.key)
        .groupBy(F.col(ROLES.target).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(ROLES.key).alias("customers"))
    )


BAND = """CASE WHEN tenure>0 AND tenure<=12 THEN '0-1yr' WHEN tenure>12 AND tenure<=24 THEN '1-2yr'
 WHEN tenure>24 AND tenure<=48 THEN '2-4yr' WHEN tenure>48 THEN '4+yr' END"""
BAND_REPORT = """CASE WHEN tenure>0 AND tenure<=12 THEN '0-1yr' WHEN tenure>12 AND tenure<=24 THEN '1-2yr'
 WHEN tenure>24 AND tenure<=60 THEN '2-5yr' WHEN tenure>60 AND tenure<=100 THEN '5+yr' END"""
SERVICES_SQL = " + ".join(f"""CASE WHEN "{c}"='Yes' THEN 1 ELSE 0 END""" for c in ROLES.services)


@query("p09_tenure_band", f'SELECT "customerID", {BAND} AS band FROM f')
def _(t):
    return t.base.select("customerID", X.tenure_band().alias("band"))


@query("p10_tenure_band_report", f'SELECT "customerID", {BAND_REPORT} AS band FROM f')
def _(t):
    return t.base.select("customerID", X.tenure_band_report().alias("band"))


@query(
    "p11_charge_tenure_ratio",
    f"""SELECT "customerID", {r6('"TotalCharges"/(tenure+1)', 'charge_tenure_ratio')} FROM cl""",
)
def _(t):
    return t.clean.select("customerID", X.charge_tenure_ratio().alias("charge_tenure_ratio"))


@query(
    "p12_monthly_to_total_ratio",
    f"""SELECT "customerID", {r6('"MonthlyCharges"/("TotalCharges"+1)', 'monthly_to_total_ratio')} FROM cl""",
)
def _(t):
    return t.clean.select("customerID", X.monthly_to_total_ratio().alias("monthly_to_total_ratio"))


@query("p13_total_services", f'SELECT "customerID", {SERVICES_SQL} AS total_services FROM cl')
def _(t):
    return t.clean.select("customerID", S.count_yes(ROLES.services).alias("total_services"))


@query(
    "p14_engineered_features",
    f"""SELECT "customerID", {BAND} AS tenure_group, {r6('"TotalCharges"/(tenure+1)', 'charge_tenure_ratio')},
    {r6('"MonthlyCharges"/("TotalCharges"+1)', 'monthly_to_total_ratio')}, {SERVICES_SQL} AS total_services
    FROM cl""",
)
def _(t):
    return X.engineer(t.clean).select(
        "customerID", "tenure_group", "charge_tenure_ratio", "monthly_to_total_ratio", "total_services"
    )


@query(
    "p15_confidence",
    f"""SELECT "customerID", model, {r6('ABS(probability-0.5e0)*2', 'confidence')} FROM sc""",
)
def _(t):
    return t.scored.select("customerID", "model", S.confidence("probability").alias("confidence"))


@query(
    "p16_threshold_decision",
    """SELECT "customerID", model, CASE WHEN probability>0.5e0 THEN 1 ELSE 0 END AS decision,
    CASE WHEN probability>0.5e0 THEN 'Yes' ELSE 'No' END AS answer FROM sc""",
)
def _(t):
    decision = S.decide("probability", 0.5)
    return t.scored.select(
        "customerID", "model", decision.alias("decision"), S.yes_no(decision).alias("answer")
    )


TIER = """CASE WHEN probability>0.7e0 THEN 'High' WHEN probability>0.3e0 THEN 'Medium' ELSE 'Low' END"""


@query("p17_risk_tier", f'SELECT "customerID", model, {TIER} AS tier FROM sc')
def _(t):
    return t.scored.select("customerID", "model", S.risk_tier("probability").alias("tier"))


@query(
    "p18_rule_score",
    f"""SELECT "customerID", {r6('contract_rule', 'score')}, CASE WHEN contract_rule>0.5e0 THEN 'High'
    WHEN contract_rule>0.3e0 THEN 'Medium' ELSE 'Low' END AS tier FROM wide""",
)
def _(t):
    score = F.round(S.rule_score(), 6)
    return t.clean.select("customerID", score.alias("score"), S.rule_tier(score).alias("tier"))


@query(
    "p19_key_factors",
    """k AS (SELECT "customerID", "Contract", tenure, ROUND("MonthlyCharges", 2) AS charges FROM cl)
    SELECT "customerID", CONCAT_WS('; ',
      CASE WHEN "Contract"='Month-to-month' THEN 'Month-to-month contract (high risk)' END,
      CASE WHEN tenure<12 THEN 'Low tenure (' || CAST(tenure AS VARCHAR) || ' months)' END,
      CASE WHEN charges>70 THEN 'High monthly charges ($' || CAST(charges AS VARCHAR) || ')' END)
    AS key_factors FROM k""",
)
def _(t):
    bills = t.clean.withColumn("MonthlyCharges", F.round("MonthlyCharges", 2))
    top = F.array(*[F.lit(c) for c in ("Contract", "tenure", "gender", "MonthlyCharges", "Partner")])
    return bills.select("customerID", F.array_join(S.key_factors(top), "; ").alias("key_factors"))


@query(
    "p20_recommendations",
    f"""SELECT "customerID", model, CASE {TIER}
    WHEN 'High' THEN 'Consider offering loyalty discount; Assign to dedicated retention specialist; Review service quality issues'
    WHEN 'Medium' THEN 'Send personalized engagement offer; Conduct satisfaction survey; Monitor usage patterns'
    ELSE 'Maintain current service quality; Continue regular engagement; Monitor for any changes' END AS actions
    FROM sc""",
)
def _(t):
    actions = S.recommendations(S.risk_tier("probability"))
    return t.scored.select("customerID", "model", F.array_join(actions, "; ").alias("actions"))


RATES = """o AS (SELECT AVG("Churn") AS overall FROM cl),
    g AS (SELECT "PaymentMethod" AS level, AVG("Churn") AS rate, COUNT(*) AS n FROM cl GROUP BY 1)"""


@query(
    "p21_effect_flag",
    f"""b AS (SELECT {BAND} AS band, "Churn" AS y FROM cl), o AS (SELECT AVG(y) AS overall FROM b)
    SELECT band, CASE WHEN AVG(y)-MAX(overall)>0.05e0 THEN 'HIGH' WHEN AVG(y)-MAX(overall)<-0.05e0 THEN 'LOW'
    ELSE 'none' END AS flag FROM b CROSS JOIN o WHERE band IS NOT NULL GROUP BY band""",
)
def _(t):
    banded = t.clean.withColumn("band", X.tenure_band())
    report = P.factor_report(banded, "band", "Churn")
    return report.select(F.col("level").alias("band"), "flag")


@query(
    "p22_correlation_strength",
    """r AS (SELECT 'tenure' AS factor, CORR(tenure, "TotalCharges") AS r FROM cl
      UNION ALL SELECT 'MonthlyCharges', CORR("MonthlyCharges", "TotalCharges") FROM cl
      UNION ALL SELECT 'Churn', CORR("Churn", "TotalCharges") FROM cl)
    SELECT factor, CASE WHEN ABS(r)>0.3e0 THEN 'strong' WHEN ABS(r)>0.1e0 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN r>0 THEN 'increases' ELSE 'decreases' END AS direction FROM r""",
)
def _(t):
    r = P.correlation_with(t.clean, ["tenure", "MonthlyCharges", "Churn"], "TotalCharges")
    return r.select(
        F.col("column").alias("factor"),
        S.correlation_strength("correlation").alias("strength"),
        S.direction("correlation").alias("direction"),
    )


@query(
    "p23_direction_text",
    f"""{RATES} SELECT level, CASE WHEN rate-overall>0 THEN 'increases' ELSE 'decreases' END AS direction
    FROM g CROSS JOIN o""",
)
def _(t):
    report = P.factor_report(t.clean, "PaymentMethod", "Churn")
    return report.select("level", S.direction("effect").alias("direction"))


@query(
    "p24_half_even_rounding",
    """r AS (SELECT "customerID", "TotalCharges"/(tenure+1) AS x FROM cl)
    SELECT "customerID", CAST(ROUND_EVEN(x, 2) AS DOUBLE) AS two, CAST(ROUND_EVEN(x, 3) AS DOUBLE) AS three,
    CAST(ROUND_EVEN(x, 4) AS DOUBLE) AS four FROM r""",
)
def _(t):
    x = X.charge_tenure_ratio()
    return t.clean.select(
        "customerID", *[S.half_even(x, d).alias(n) for n, d in (("two", 2), ("three", 3), ("four", 4))]
    )


def _numeric_share(column):
    return (
        f"""SELECT '{column}' AS "column", {r6(f'''AVG(CASE WHEN REGEXP_MATCHES(REPLACE(REPLACE("{column}",'.',''),'-',''),'^[0-9]+$') THEN 1e0 ELSE 0e0 END)''', 'numeric_share')},"""
        f""" AVG(CASE WHEN REGEXP_MATCHES(REPLACE(REPLACE("{column}",'.',''),'-',''),'^[0-9]+$') THEN 1e0 ELSE 0e0 END) > 0.8e0 AS numeric_looking FROM f"""
    )


@query(
    "p25_numeric_looking_text",
    " UNION ALL ".join(_numeric_share(c) for c in ("TotalCharges", "Contract", "PaymentMethod")),
)
def _(t):
    return P.numeric_looking_text(t.base, ["TotalCharges", "Contract", "PaymentMethod"])


@query(
    "p26_rate_class",
    f"""p AS (SELECT AVG("Churn")*100 AS percent FROM cl)
    SELECT {r6('percent', 'percent')}, CASE WHEN percent>30 THEN 'high' WHEN percent>15 THEN 'moderate' ELSE 'low' END AS rate_class,
    (percent<20 OR percent>80) AS imbalanced FROM p""",
)
def _(t):
    return P.rate_summary(t.clean, "Churn")


@query(
    "p27_min_max_metrics",
    f"""m AS (SELECT model,
      COUNT(*) FILTER (prediction=label)*1e0/COUNT(*) AS accuracy,
      COALESCE(COUNT(*) FILTER (prediction=1 AND label=1)*1e0/NULLIF(COUNT(*) FILTER (prediction=1),0), 0e0) AS pr,
      COALESCE(COUNT(*) FILTER (prediction=1 AND label=1)*1e0/NULLIF(COUNT(*) FILTER (label=1),0), 0e0) AS recall
      FROM sc GROUP BY model)
    SELECT model, {r6('(accuracy-MIN(accuracy) OVER ())/NULLIF(MAX(accuracy) OVER () - MIN(accuracy) OVER (),0)', 'accuracy')},
    {r6('(pr-MIN(pr) OVER ())/NULLIF(MAX(pr) OVER () - MIN(pr) OVER (),0)', '"precision"')},
    {r6('(recall-MIN(recall) OVER ())/NULLIF(MAX(recall) OVER () - MIN(recall) OVER (),0)', 'recall')} FROM m""",
)
def _(t):
    metrics = V.classification_metrics(t.scored, by="model")
    return V.min_max_normalise(
        metrics.select("model", "accuracy", "precision", "recall"), ["accuracy", "precision", "recall"]
    )


NUMBERS = ("customerID", "SeniorCitizen", "tenure", "MonthlyCharges")


@query(
    "p28_columns_by_type",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{'numeric' if c in NUMBERS else 'text'}' AS kind, COUNT(*) FILTER ("{c}" IS NULL) AS null_count FROM f"""
        for c in raw_schema().fieldNames()
    ),
)
def _(t):
    kinds = C.columns_by_type(t.base)
    nulls = P.null_counts(t.base)
    is_numeric = F.col("column").isin(kinds["numeric"])
    return nulls.select("column", F.when(is_numeric, "numeric").otherwise("text").alias("kind"), "null_count")


@query(
    "p29_relative_effect",
    f"""{RATES} SELECT level, {r6('CASE WHEN overall>0 THEN (rate-overall)/overall ELSE 0 END', 'relative_effect')}
    FROM g CROSS JOIN o""",
)
def _(t):
    table = E.simple_effects(t.clean, ["PaymentMethod"])
    return table.select(
        F.col("Treatment_Level").alias("level"), F.col("Relative_Effect").alias("relative_effect")
    )


@query(
    "f01_drop_incomplete",
    f"""b AS (SELECT "customerID", {BAND} AS band, "Churn" AS y FROM cl)
    SELECT * FROM b WHERE band IS NOT NULL AND y IS NOT NULL""",
)
def _(t):
    banded = t.clean.select("customerID", X.tenure_band().alias("band"), F.col("Churn").alias("y"))
    return C.drop_incomplete(banded, "band", "y")


@query(
    "f04_level_filter",
    """SELECT "customerID", "Contract", tenure FROM cl WHERE "Contract"='Two year'""",
)
def _(t):
    return t.clean.where(F.col("Contract") == "Two year").select("customerID", "Contract", "tenure")


@query("f05_seeded_sample")
def _(t):
    return splitting.sample_rows(t.clean, 1000).select("customerID", "Churn", "tenure")


@query(
    "f06_stratified_split",
    # The rows are chosen by hash; their number per class is fixed.
    """c AS (SELECT "Churn" AS label, COUNT(*) AS n FROM cl GROUP BY 1)
    SELECT label, 'test' AS split, CAST(ROUND_EVEN(n*0.2e0, 0) AS BIGINT) AS n FROM c
    UNION ALL SELECT label, 'train', n - CAST(ROUND_EVEN(n*0.2e0, 0) AS BIGINT) FROM c""",
)
def _(t):
    parts = splitting.stratified_split(t.clean)
    return parts.groupBy(F.col("Churn").alias("label"), "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f07_stratified_folds",
    """c AS (SELECT "Churn" AS label, COUNT(*) AS n FROM cl GROUP BY 1)
    SELECT label, CAST(i AS INT) AS fold, CAST(((i+1)*n)//5 - (i*n)//5 AS BIGINT) AS n
    FROM c CROSS JOIN (SELECT UNNEST(RANGE(5)) AS i)""",
)
def _(t):
    parts = splitting.stratified_folds(t.clean)
    return parts.groupBy(F.col("Churn").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k05_preview",
    """SELECT "customerID", gender, tenure, "Contract", "Churn" FROM f ORDER BY "customerID" LIMIT 10""",
)
def _(t):
    return t.base.orderBy("customerID").limit(10).select(
        "customerID", "gender", "tenure", "Contract", "Churn"
    )
