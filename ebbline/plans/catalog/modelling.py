"""Queries: encoding, models, attribution and scoring.

Model queries call the operators with their defaults: whole grids, all folds and trees, all rows. One
prepared table, the tuned models, and one forest and one logistic model of the first grid point for
attribution and scoring are shared per folder by the queries of a session.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbline.config import ROLES
from ebbline.functions.scalars import text_to_number
from ebbline.operators import attribute as A
from ebbline.operators import encode as N
from ebbline.operators import evaluate as V
from ebbline.operators import models as M
from ebbline.operators import profile as P
from ebbline.operators import score as S
from ebbline.operators.ordered import exact_medians
from ebbline.plans import workflows as W
from ebbline.plans.catalog.profiling import CATEGORICAL, NUMERIC, union
from ebbline.plans.catalog.registry import query, r6
from ebbline.plans.catalog.statistics import STUDENT_P
from ebbline.session import shared_folder
from ebbline.sources import readers, writers

_kept: dict = {}


def _once(t, name, build):
    """Build once per application and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def forget_fits() -> None:
    """Drop everything shared between queries, e.g. between timed runs."""
    for value in _kept.values():
        if isinstance(value, W.Prepared):
            value.release()
    _kept.clear()


def _prepared(t) -> W.Prepared:
    return _once(t, "prepared", lambda: W.prepare(t.base))


def _trained(t, name, **options) -> M.TrainedModel:
    p = _prepared(t)
    return _once(
        t, (name, str(options)),
        lambda: M.train_model(name, p.train, p.test, **options),
    )


def _encoded(t):
    encoder = _once(t, "encoder_all", lambda: N.fit_encoder(t.base))
    return N.encode(encoder, t.base), N.feature_names(encoder)


def _forest(t):
    return _trained(t, "RandomForest", budget=1)


def _logistic(t):
    return _trained(t, "LogisticRegression", budget=1)


def _attributions(t):
    p = _prepared(t)
    return A.explain(p.test, _forest(t).model, p.names, p.train)


def _linear_attributions(t):
    p = _prepared(t)
    return A.linear_attribution(p.test, _logistic(t).model, p.names)


@query(
    "m01_median_imputation",
    f"""nt AS (SELECT "customerID", TRY_CAST(TRIM("TotalCharges") AS DOUBLE) AS x FROM f)
    SELECT "customerID", {r6('COALESCE(x, (SELECT MEDIAN(x) FROM nt))', 'total')} FROM nt""",
)
def _(t):
    numbers = t.base.select("customerID", text_to_number("TotalCharges").alias("total"))
    median = exact_medians(numbers, ["total"])["total"]
    return numbers.select("customerID", F.coalesce("total", F.lit(median)).alias("total"))


@query(
    "m02_missing_level",
    """SELECT "customerID", COALESCE(CASE WHEN tenure>0 THEN "Contract" END, 'missing') AS level FROM cl""",
)
def _(t):
    gaps = t.clean.select("customerID", F.when(F.col("tenure") > 0, F.col("Contract")).alias("level"))
    return gaps.fillna("missing", ["level"])


@query(
    "m03_standardised_numerics",
    "s AS (SELECT " + ", ".join(
        f"""AVG("{c}") AS "{c}_m", COALESCE(NULLIF(STDDEV_POP("{c}"),0),1) AS "{c}_s" """ for c in NUMERIC
    ) + """ FROM cl) SELECT "customerID", """ + ", ".join(
        r6(f'("{c}"-"{c}_m")/"{c}_s"', f'"{c}"') for c in NUMERIC
    ) + " FROM cl CROSS JOIN s",
)
def _(t):
    values = vector_to_array(N.FEATURES)
    return _encoded(t)[0].select(
        "customerID", *[values[i].alias(c) for i, c in enumerate(NUMERIC)]
    )


@query(
    "m04_one_hot_levels",
    "u AS (" + union(
        f"""SELECT '{c}_' || CAST("{c}" AS VARCHAR) AS feature, COUNT(*) AS customers FROM cl GROUP BY 1""" for c in CATEGORICAL
    ) + ") SELECT * FROM u",
)
def _(t):
    encoded, names = _encoded(t)
    long = N.long_features(encoded, names)
    return (
        long.where(~F.col("feature").isin(NUMERIC))
        .groupBy("feature")
        .agg(F.sum("value").cast("bigint").alias("customers"))
    )


#: Columns of the encoder with wide columns; lists of levels end at 20 so that both forms occur at every scale.
WIDE_ROLES = replace(ROLES, numeric=("tenure",), categorical=("TotalCharges", "Contract"))
WIDE_FROM = 20


@query(
    "m04b_one_hot_levels_joined",
    """lv AS (SELECT 1 AS part, 'TotalCharges_' || "TotalCharges" AS feature, COUNT(*) AS customers FROM f GROUP BY 2
      UNION ALL SELECT 2, 'Contract_' || "Contract", COUNT(*) FROM f GROUP BY 2)
    SELECT ROW_NUMBER() OVER (ORDER BY part, feature) AS position, feature, customers FROM lv""",
)
def _(t):
    encoder = N.fit_encoder(t.base, WIDE_ROLES, wide=True, max_levels=WIDE_FROM)
    entries = N.nonzero_features(N.encode(encoder, t.base, WIDE_ROLES))
    counts = entries.where(F.col("position") >= len(WIDE_ROLES.numeric)).groupBy("position").agg(F.count(F.lit(1)).alias("customers"))
    return N.feature_table(encoder, t.spark, WIDE_ROLES).join(counts, "position")


def _encoded_sql():
    """CTE ``enc(feature, label, x, w)``: every encoded value with its number of customers."""
    numeric = [
        f"""SELECT '{c}' AS feature, "Churn" AS label, ("{c}"-(SELECT AVG("{c}") FROM cl))/(SELECT STDDEV_POP("{c}") FROM cl) AS x, 1e0 AS w FROM cl"""
        for c in NUMERIC
    ]
    hot = [
        f"""SELECT '{c}_' || lvl, label, CASE WHEN v=lvl THEN 1e0 ELSE 0e0 END, n FROM
          (SELECT CAST("{c}" AS VARCHAR) AS v, "Churn" AS label, COUNT(*)*1e0 AS n FROM cl GROUP BY 1,2)
          CROSS JOIN (SELECT DISTINCT CAST("{c}" AS VARCHAR) AS lvl FROM cl)"""
        for c in CATEGORICAL
    ]
    return "enc AS (" + union(numeric + hot) + ")"


@query(
    "m05_encoded_features",
    _encoded_sql() + f""", mo AS (SELECT feature, SUM(w) AS n, SUM(w*x)/SUM(w) AS m, MIN(x) AS a, MAX(x) AS z FROM enc GROUP BY feature)
    SELECT feature, CAST(MAX(n) AS BIGINT) AS "count", {r6('MAX(m)', 'mean')}, {r6('SQRT(SUM(w*POWER(x-m,2))/(MAX(n)-1))', 'std')},
    {r6('MAX(a)', '"min"')}, {r6('MAX(z)', '"max"')} FROM enc JOIN mo USING (feature) GROUP BY feature""",
)
def _(t):
    encoded, names = _encoded(t)
    return P.feature_statistics_long(N.long_features(encoded, names), "feature", "value")


@query(
    "m06_select_k_best",
    _encoded_sql() + f""", g AS (SELECT feature, SUM(w*x)/SUM(w) AS grand, SUM(w) AS n FROM enc GROUP BY feature),
    c AS (SELECT feature, label, SUM(w) AS n, SUM(w*x)/SUM(w) AS m FROM enc GROUP BY 1,2),
    wi AS (SELECT enc.feature, SUM(w*POWER(x-m,2)) AS ssw FROM enc JOIN c ON enc.feature=c.feature AND enc.label=c.label GROUP BY 1),
    a AS (SELECT c.feature, SUM(c.n*POWER(c.m-grand,2))/(MAX(ssw)/(MAX(g.n)-2)) AS f, MAX(g.n)-2 AS d2
      FROM c JOIN g ON c.feature=g.feature JOIN wi ON wi.feature=c.feature GROUP BY 1)
    SELECT feature, {r6('f', 'score')}, {r6(STUDENT_P, 'p_value')}, ROW_NUMBER() OVER (ORDER BY ROUND(f,9) DESC, feature)<=20 AS selected FROM a""",
)
def _(t):
    encoded, names = _encoded(t)
    _, kept, scores = N.select_features(encoded, names, 20)
    return scores.withColumn("selected", F.col("feature").isin(kept))


@query("m07_recursive_elimination")
def _(t):
    p = _prepared(t)
    return M.eliminate_features(p.train, p.names)


@query("m08_forest_importance")
def _(t):
    p = _prepared(t)
    return M.forest_importance(p.train, p.names)


@query("w01_cumulative_importance")
def _(t):
    p = _prepared(t)
    return M.cumulative_importance(M.model_importance(_forest(t).model, p.names, t.spark), 15)


def _summary(t, trained):
    scored = M.scored_by(trained.model, _prepared(t).test, trained.name)
    return V.calculate_metrics(scored, "model")


@query("m09_random_forest")
def _(t):
    return _summary(t, _trained(t, "RandomForest"))


@query("m10_logistic_regression")
def _(t):
    return _summary(t, _trained(t, "LogisticRegression"))


@query("m11_probability_svm")
def _(t):
    return _summary(t, _trained(t, "SVM"))


@query("m12_gradient_boosting")
def _(t):
    return _summary(t, _trained(t, "GradientBoosting"))


@query("m13_gradient_boosting_leafwise")
def _(t):
    return _summary(t, _trained(t, "GradientBoostingLeafwise"))


@query("m14_grid_search")
def _(t):
    trained = _trained(t, "LogisticRegression")
    return t.spark.createDataFrame(
        [(trained.name, str(trained.params), trained.cv_auc, trained.roc_auc)],
        "model string, params string, cv_auc double, roc_auc double",
    )


def _all(t):
    return {name: _trained(t, name) for name in ("RandomForest", "GradientBoosting", "LogisticRegression")}


def _defaults(t):
    return {name: _trained(t, name) for name in M.DEFAULT_ALGORITHMS}


@query("m15_best_of_all_models")
def _(t):
    best = M.best_trained(_all(t))
    return _summary(t, best)


@query("m16_model_comparison")
def _(t):
    return M.compare_models(_all(t), _prepared(t).test)


def _accuracies(t, trained):
    rows = [(m.name, m.train_accuracy, m.test_accuracy) for m in trained.values()]
    return t.spark.createDataFrame(rows, "model string, train_accuracy double, test_accuracy double")


@query("m17_train_and_test_accuracy")
def _(t):
    return _accuracies(t, _all(t))


@query("m15c_best_of_default_algorithms")
def _(t):
    return _summary(t, M.best_trained(_defaults(t)))


@query("m16c_comparison_of_default_algorithms")
def _(t):
    return M.compare_models(_defaults(t), _prepared(t).test)


@query("m17c_accuracy_of_default_algorithms")
def _(t):
    return _accuracies(t, _defaults(t))


@query("c32_feature_summary")
def _(t):
    p = _prepared(t)
    importance = M.model_importance(_forest(t).model, p.names, t.spark)
    return P.feature_summary(t.clean, "Churn", list(ROLES.features), importance)


@query("x01_attribution_additivity")
def _(t):
    # Sum of contributions against prediction minus base, per customer.
    sums = _attributions(t).groupBy("customerID").agg(
        F.sum("phi").alias("total"), F.max("base").alias("base")
    )
    scored = M.scored_by(_forest(t).model, _prepared(t).test, "forest")
    return sums.join(scored, "customerID").select(
        "customerID", "total", "base", "probability",
        (F.abs(F.col("probability") - F.col("base") - F.col("total")) < 1e-9).alias("adds_up"),
    )


@query("x01b_linear_attribution")
def _(t):
    return _linear_attributions(t)


@query("x02_attribution_importance")
def _(t):
    return A.attribution_importance(_attributions(t))


@query("c34_attribution_totals")
def _(t):
    return A.attribution_totals(A.attribution_importance(_linear_attributions(t)))


@query("x03_positive_class_probability")
def _(t):
    return M.scored_by(_forest(t).model, _prepared(t).test, "forest")


@query("x04_local_contributions")
def _(t):
    return A.local_contributions(_linear_attributions(t))


@query("x05_waterfall")
def _(t):
    return A.waterfall(_linear_attributions(t))


@query("x06_dependence")
def _(t):
    return A.dependence(_linear_attributions(t), "tenure", "MonthlyCharges")


@query("x07_beeswarm")
def _(t):
    return A.beeswarm(_linear_attributions(t), 10)


@query("x08_feature_against_probability")
def _(t):
    p = _prepared(t)
    scored = M.scored_by(_forest(t).model, p.test, "forest").select("customerID", "probability")
    return t.clean.join(scored, "customerID").select("customerID", F.col("tenure").alias("x"), "probability")


@query("x09_model_importance_fallback")
def _(t):
    return M.model_importance(_forest(t).model, _prepared(t).names, t.spark)


def _scoring(t):
    return S.scoring_pipeline(_prepared(t).encoder, _forest(t).model)


@query("s01_batch_scoring")
def _(t):
    scored = S.score_batch(_scoring(t), t.base)
    return scored.select("customerID", "Churn_Prediction", "Churn_Probability", "Prediction_Confidence")


@query("s01b_saved_model_scoring")
def _(t):
    path = f"{shared_folder(t.spark)}/models"
    writers.save_model(_scoring(t), path)
    return S.score_batch(writers.load_model(path), t.base).select(
        "customerID", "Churn_Prediction", "Churn_Probability"
    )


@query("s02_customer_scores")
def _(t):
    return S.score_customers(_scoring(t), t.base)


@query("s03_explained_scores")
def _(t):
    importance = M.model_importance(_forest(t).model, _prepared(t).names, t.spark)
    explained = S.explain_scores(_scoring(t), t.base, S.top_source_columns(importance))
    return explained.withColumns(
        {c: F.array_join(c, "; ") for c in ("key_factors", "recommendations")}
    )


@query("s04_upload_scoring")
def _(t):
    # An upload: all text, some optional columns missing, and every 97th charge unreadable.
    upload = t.base.select(
        "customerID", "Contract", "PaymentMethod", "InternetService", "tenure",
        F.when(F.col("customerID") % 97 == 0, "n/a")
        .otherwise(F.col("MonthlyCharges").cast("string"))
        .alias("MonthlyCharges"),
    )
    return S.score_upload(_scoring(t), upload)


@query("a02_missing_file_is_empty", """SELECT "Churn", COUNT(*) AS n FROM f GROUP BY 1""")
def _(t):
    empty = readers.read_or_empty(t.spark, f"{shared_folder(t.spark)}/not_there", t.base.schema)
    return t.base.unionByName(empty).groupBy("Churn").agg(F.count(F.lit(1)).alias("n"))


def _written(t, name):
    return f"{shared_folder(t.spark)}/{name}"


@query("a03_table_sink", """SELECT "Churn", COUNT(*) AS n FROM cl GROUP BY 1""")
def _(t):
    path = _written(t, "cleaned")
    writers.write_table(t.clean, path)
    saved = t.spark.read.schema(t.clean.schema).parquet(path)
    return saved.groupBy("Churn").agg(F.count(F.lit(1)).alias("n"))


@query("a05_json_report", """SELECT "Contract" AS level, COUNT(*) AS n FROM cl GROUP BY 1""")
def _(t):
    report = t.clean.groupBy(F.col("Contract").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    path = _written(t, "contract_report")
    writers.write_json_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query(
    "a07_split_table",
    """c AS (SELECT "Churn" AS label, COUNT(*) AS n FROM cl GROUP BY 1)
    SELECT label, 'test' AS split, CAST(ROUND_EVEN(n*0.2e0, 0) AS BIGINT) AS n FROM c
    UNION ALL SELECT label, 'train', n - CAST(ROUND_EVEN(n*0.2e0, 0) AS BIGINT) FROM c""",
)
def _(t):
    path = _written(t, "prepared")
    writers.write_split_table(_prepared(t).table, path)
    saved = t.spark.read.parquet(path)
    return saved.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("a08_report_files", """SELECT "Contract" AS level, COUNT(*) AS n FROM cl GROUP BY 1""")
def _(t):
    report = t.clean.groupBy(F.col("Contract").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    paths = writers.write_reports({"contract_levels": report}, _written(t, "reports"))
    return t.spark.read.schema(report.schema).option("header", True).csv(paths["contract_levels"])
