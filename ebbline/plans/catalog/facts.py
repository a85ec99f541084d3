"""Queries: facts about fits, attributions, refuters and scores that SQL can state too.

The numbers of a fitted model are Spark's own, but what must hold of them is not: which rows are scored,
that contributions add up to the prediction, that shares sum to 1. Each query reads the whole result of
the query it is named after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.config import ROLES
from ebbline.operators import adjust as A
from ebbline.operators import models as M
from ebbline.operators import score as S
from ebbline.plans.catalog import modelling as B
from ebbline.plans.catalog.profiling import CATEGORICAL, NUMERIC
from ebbline.plans.catalog.registry import QUERIES, query
from ebbline.session import shared_folder
from ebbline.sources import writers

# Rows and churned rows of the test part (ts), and the number of encoded features (nf).
TEST = """c AS (SELECT "Churn" AS label, CAST(ROUND_EVEN(COUNT(*)*0.2e0, 0) AS BIGINT) AS n FROM cl GROUP BY 1),
    ts AS (SELECT CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(CASE WHEN label=1 THEN n ELSE 0 END) AS BIGINT) AS churned FROM c)"""
WIDTH = f"nf AS (SELECT CAST({len(NUMERIC)}+" + "+".join(f'COUNT(DISTINCT "{c}")' for c in CATEGORICAL) + " AS BIGINT) AS n FROM cl)"


def _result(t, name: str) -> DataFrame:
    return QUERIES[name](t.spark, t.folder)


def _rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def _always(condition, name: str):
    """Whether the condition holds in every row; a null does not hold."""
    return (F.count_if(~F.coalesce(condition, F.lit(False))) == 0).alias(name)


@query("f05b_sample_facts", """SELECT LEAST(COUNT(*), 1000) AS n, LEAST(COUNT(*), 1000) AS customers, LEAST(COUNT(*), 1000) AS of_the_table FROM cl""")
def _(t):
    drawn = _result(t, "f05_seeded_sample")
    found = drawn.join(t.clean.select("customerID", "Churn", "tenure"), ["customerID", "Churn", "tenure"], "left_semi")
    sizes = drawn.agg(_rows(), F.count_distinct("customerID").alias("customers"))
    return sizes.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("of_the_table"))))


EFFECT = """(SELECT SUM(n*(m1-m0))/SUM(n) FROM (SELECT c, COUNT(*)*1e0 AS n, AVG(y) FILTER (t=1) AS m1, AVG(y) FILTER (t=0) AS m0 FROM pl GROUP BY c))"""


@query("e06b_placebo_facts", f"SELECT COUNT(DISTINCT c) AS strata_used, COUNT(*) AS rows_used, COUNT(*) AS rows_total, {EFFECT}<>0 AS shrinks FROM pl")
def _(t):
    # Half of the adjusted effect is far above what chance leaves of a treatment dealt at random.
    effect = A.stratified_effect(t.planted, "t", "y", ["c"]).select(F.abs("Estimated_Effect").alias("real"))
    placebo = _result(t, "e06_placebo_treatment").crossJoin(F.broadcast(effect))
    return placebo.select("strata_used", "rows_used", "rows_total", (F.abs("Estimated_Effect") < F.col("real") / 2).alias("shrinks"))


@query("e07c_subset_facts", "SELECT CAST(5 AS BIGINT) AS subsets, COUNT(*) AS rows_used, TRUE AS bounded FROM pl")
def _(t):
    return _result(t, "e07_subset_effects").agg(
        F.count_distinct("subset").alias("subsets"), F.sum("rows_used").alias("rows_used"),
        _always((F.col("CI_Lower") <= F.col("Estimated_Effect")) & (F.col("Estimated_Effect") <= F.col("CI_Upper")), "bounded"),
    )


@query("e08b_sensitivity_facts", "SELECT CAST(5 AS BIGINT) AS strengths, COUNT(*) AS most_rows, TRUE AS falls FROM pl")
def _(t):
    # The invented cause takes over more of the effect the stronger it is.
    at = lambda s: F.max(F.when(F.col("strength") == s, F.col("Estimated_Effect")))
    return _result(t, "e08_confounder_sensitivity").agg(
        F.count_distinct("strength").alias("strengths"), F.max("rows_used").alias("most_rows"),
        ((at(0.0) > at(0.25)) & (at(0.25) > at(0.5))).alias("falls"),
    )


@query("m07b_elimination_facts", WIDTH + " SELECT n, CAST(15 AS BIGINT) AS kept, TRUE AS ranked FROM nf")
def _(t):
    return _result(t, "m07_recursive_elimination").agg(
        _rows(), F.count_if("support").alias("kept"),
        (F.count_distinct("ranking") == F.max("ranking")).alias("ranked"),
    )


def _importance_facts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("feature").alias("n"), F.sum("importance").alias("total"), _always(F.col("importance") >= 0, "shares"))


IMPORTANCE = WIDTH + " SELECT n, 1e0 AS total, TRUE AS shares FROM nf"


@query("m08b_importance_facts", IMPORTANCE)
def _(t):
    # Unrounded, as rounded shares add up to slightly more or less.
    p = B._prepared(t)
    return _importance_facts(M.forest_importance(p.train, p.names))


@query("x09b_importance_facts", IMPORTANCE)
def _(t):
    return _importance_facts(M.model_importance(B._forest(t).model, B._prepared(t).names, t.spark))


@query("w01b_cumulative_facts", WIDTH + " SELECT LEAST(n, 15) AS n, TRUE AS adds_up FROM nf")
def _(t):
    rows = _result(t, "w01_cumulative_importance")
    return rows.agg(_rows(), (F.abs(F.sum("importance") - F.max("cumulative_importance")) < 1e-9).alias("adds_up"))


def _model_facts(t, trained: M.TrainedModel) -> DataFrame:
    """Rows and churned rows scored; the reported accuracy against the share of right rows."""
    p = F.col("probability")
    scored = M.scored_by(trained.model, B._prepared(t).test, trained.name)
    return scored.agg(
        F.count_distinct("customerID").alias("n"), F.sum("label").cast("long").alias("churned"), _always((p >= 0) & (p <= 1), "probabilities"),
        (F.abs(F.avg((F.col("label") == F.col("prediction")).cast("double")) - trained.test_accuracy) < 1e-9).alias("accuracy_agrees"),
    )


FITTED = TEST + " SELECT n, churned, TRUE AS probabilities, TRUE AS accuracy_agrees FROM ts"

for _name, _algorithm in (
    ("m09b_random_forest_facts", "RandomForest"),
    ("m10b_logistic_regression_facts", "LogisticRegression"),
    ("m11b_probability_svm_facts", "SVM"),
    ("m12b_gradient_boosting_facts", "GradientBoosting"),
    ("m13b_gradient_boosting_leafwise_facts", "GradientBoostingLeafwise"),
):
    query(_name, FITTED)(lambda t, a=_algorithm: _model_facts(t, B._trained(t, a)))


@query("m14b_grid_facts", "SELECT 'LogisticRegression' AS model, COUNT(*)*0+12 AS points, COUNT(*)*0+60 AS areas, TRUE AS best_is_largest, TRUE AS shares, TRUE AS solvers_agree FROM cl")
def _(t):
    # The winner's mean over its folds is the largest of all; a solver does not change the optimum.
    trained = B._trained(t, "LogisticRegression")
    rows = [(i, float(a), {**p, "solver": ""} == {**trained.params, "solver": ""}, p["solver"]) for i, (p, areas) in enumerate(trained.tried) for a in areas]
    tried = t.spark.createDataFrame(rows, "point int, area double, best boolean, solver string")
    means = tried.groupBy("point", "best", "solver").agg(F.avg("area").alias("mean"), F.count(F.lit(1)).alias("n"), _always(F.col("area").between(0, 1), "fine"))
    at = lambda s: F.round(F.avg(F.when(F.col("solver") == s, F.col("mean"))), 9)
    top = F.abs(F.max("mean") - F.max(F.when(F.col("best"), F.col("mean")))) < 1e-12
    reported = F.abs(F.max("mean") - F.lit(trained.cv_auc)) < 1e-12
    return means.agg(
        F.count(F.lit(1)).alias("points"), F.sum("n").alias("areas"), (top & reported).alias("best_is_largest"), _always(F.col("fine"), "shares"),
        (at("liblinear") == at("saga")).alias("solvers_agree"),
    ).withColumn("model", F.lit(trained.name))


@query("m15b_best_model_facts", TEST + " SELECT CAST(3 AS BIGINT) AS models, TRUE AS best, n FROM ts")
def _(t):
    trained = B._all(t)
    best = M.best_trained(trained)
    scored = M.scored_by(best.model, B._prepared(t).test, best.name)
    aucs = _result(t, "m16_model_comparison").agg(_rows().alias("models"), F.max("ROC-AUC").alias("top"), F.max(F.when(F.col("Model") == best.name, F.col("ROC-AUC"))).alias("own"))
    return aucs.select("models", (F.col("own") == F.col("top")).alias("best")).crossJoin(F.broadcast(scored.agg(_rows())))


@query("m16b_comparison_facts", "SELECT UNNEST(['GradientBoosting','LogisticRegression','RandomForest']) AS \"Model\", TRUE AS shares, TRUE AS harmonic")
def _(t):
    measures = [F.col(c) for c in ("Accuracy", "Precision", "Recall", "`F1-Score`", "`ROC-AUC`")]
    shares = F.lit(True)
    for m in measures:
        shares = shares & m.between(0, 1)
    _, precision, recall, f1, _ = measures
    # Measures are rounded to 6 digits here.
    harmonic = F.abs(f1 * (precision + recall) - 2 * precision * recall) < 1e-5
    return _result(t, "m16_model_comparison").select("Model", shares.alias("shares"), harmonic.alias("harmonic"))


@query("m17b_accuracy_facts", "SELECT UNNEST(['GradientBoosting','LogisticRegression','RandomForest']) AS model, TRUE AS shares, TRUE AS as_compared")
def _(t):
    compared = _result(t, "m16_model_comparison").select(F.col("Model").alias("model"), "Accuracy")
    rows = _result(t, "m17_train_and_test_accuracy").join(compared, "model")
    shares = F.col("train_accuracy").between(0, 1) & F.col("test_accuracy").between(0, 1)
    return rows.select("model", shares.alias("shares"), (F.abs(F.col("test_accuracy") - F.col("Accuracy")) < 2e-6).alias("as_compared"))


@query("x01c_additivity_facts", TEST + " SELECT n, TRUE AS adds_up FROM ts")
def _(t):
    return _result(t, "x01_attribution_additivity").agg(F.count_distinct("customerID").alias("n"), _always(F.col("adds_up"), "adds_up"))


@query("x02b_importance_facts", WIDTH + " SELECT n, TRUE AS sizes FROM nf")
def _(t):
    return _result(t, "x02_attribution_importance").agg(F.count_distinct("feature").alias("n"), _always(F.col("attribution_importance") >= 0, "sizes"))


@query("c34b_totals_facts", WIDTH + " SELECT n FROM nf")
def _(t):
    return _result(t, "c34_attribution_totals").select(F.round(F.col("total_impact") / F.col("average_impact"), 2).cast("long").alias("n"))


GAPS = "+".join(f'COUNT(*) FILTER ("{c}" IS NULL)' for c in ROLES.features)


@query("c32b_summary_facts", WIDTH + f" SELECT n, CAST({len(ROLES.features)} AS BIGINT) AS columns, (SELECT {GAPS} FROM cl)*1e0 AS gaps, TRUE AS correlations FROM nf")
def _(t):
    section, value = F.col("section"), F.col("value")
    counts = section.endswith("_feature")
    return _result(t, "c32_feature_summary").agg(
        F.count_if(section == "importance").alias("n"), F.count_if(counts).alias("columns"), F.sum(F.when(counts, value)).alias("gaps"),
        _always((section != "correlation") | value.between(-1, 1), "correlations"),
    )


@query("x03b_probability_facts", TEST + " SELECT n, churned, TRUE AS probabilities FROM ts")
def _(t):
    return _result(t, "x03_positive_class_probability").agg(
        F.count_distinct("customerID").alias("n"), F.sum("label").cast("long").alias("churned"), _always(F.col("probability").between(0, 1), "probabilities")
    )


@query("x04b_contribution_facts", TEST + " SELECT n, n*10 AS contributions, TRUE AS directed FROM ts")
def _(t):
    directed = (F.col("direction") == "Increases Churn Risk") == (F.col("phi") > 0)
    # Rounded contributions below 0.0000005 lose their sign.
    return _result(t, "x04_local_contributions").agg(
        F.count_distinct("customerID").alias("n"), F.count(F.lit(1)).alias("contributions"), _always(directed | (F.abs("phi") < 1e-6), "directed")
    )


@query("x05b_waterfall_facts", TEST + " SELECT n, n*10 AS steps, TRUE AS ends_at_prediction FROM ts")
def _(t):
    # The last step ends at the base value and all contributions: the log odds of the linear model.
    steps = _result(t, "x05_waterfall")
    ends = steps.groupBy("customerID").agg(F.max_by("end", "place").alias("end"), F.count(F.lit(1)).alias("steps"))
    p = F.col("probability")
    scored = M.scored_by(B._logistic(t).model, B._prepared(t).test, "logistic").select("customerID", F.ln(p / (1 - p)).alias("odds"))
    return ends.join(scored, "customerID").agg(_rows(), F.sum("steps").alias("steps"), _always(F.abs(F.col("end") - F.col("odds")) < 1e-5, "ends_at_prediction"))


@query("x06b_dependence_facts", TEST + " SELECT n, TRUE AS complete FROM ts")
def _(t):
    return _result(t, "x06_dependence").agg(
        F.count_distinct("customerID").alias("n"), _always(F.col("value").isNotNull() & F.col("phi").isNotNull() & F.col("interaction_value").isNotNull(), "complete")
    )


@query("x07b_beeswarm_facts", TEST + " SELECT n, n*10 AS points, CAST(10 AS BIGINT) AS features FROM ts")
def _(t):
    return _result(t, "x07_beeswarm").agg(F.count_distinct("customerID").alias("n"), F.count(F.lit(1)).alias("points"), F.count_distinct("feature").alias("features"))


@query("x08b_feature_facts", TEST + " SELECT n, n AS own_tenure FROM ts")
def _(t):
    rows = _result(t, "x08_feature_against_probability")
    own = rows.join(t.clean.select("customerID", "tenure"), "customerID")
    return own.agg(_rows(), F.count_if(F.col("x") == F.col("tenure")).alias("own_tenure"))


ALL = "SELECT COUNT(*) AS n, TRUE AS consistent FROM f"


def _score_facts(df: DataFrame, consistent) -> DataFrame:
    return df.agg(F.count_distinct("customerID").alias("n"), _always(consistent, "consistent"))


@query("s01c_scoring_facts", ALL)
def _(t):
    p = F.col("Churn_Probability")
    # Probabilities are rounded to 6 digits here, so rows at the border itself may go either way.
    decided = ((F.col("Churn_Prediction") == 1) == (p > 0.5)) | (F.abs(p - 0.5) < 1e-6)
    sure = F.abs(F.abs(p - 0.5) * 2 - F.col("Prediction_Confidence")) < 3e-6
    return _score_facts(_result(t, "s01_batch_scoring"), decided & sure)


@query("s02b_score_facts", ALL)
def _(t):
    p = F.col("churn_probability")
    return _score_facts(_result(t, "s02_customer_scores"), (F.col("prediction") == (p > 0.5)) | (F.abs(p - 0.5) < 1e-6))


@query("s03b_explained_facts", ALL)
def _(t):
    p = F.col("churn_probability")
    return _score_facts(_result(t, "s03_explained_scores"), ((F.col("prediction") == "Yes") == (p > 0.5)) | (F.abs(p - 0.5) < 1e-6))


@query("s04b_upload_facts", """SELECT COUNT(*) AS n, COUNT(*) FILTER ("customerID" % 97 = 0) AS errors, COUNT(*) FILTER ("customerID" % 97 <> 0) AS scored FROM f""")
def _(t):
    return _result(t, "s04_upload_scoring").agg(
        F.count_distinct("customerID").alias("n"), F.count("error").alias("errors"),
        F.count_if(F.col("error").isNull() & F.col("churn_probability").between(0, 1) & F.col("prediction").isNotNull()).alias("scored"),
    )


@query("a04_model_sink", "SELECT COUNT(*) AS n, COUNT(*) AS alike FROM f")
def _(t):
    pipeline = B._scoring(t)
    path = f"{shared_folder(t.spark)}/models"
    writers.save_model(pipeline, path)
    before = S.score_batch(pipeline, t.base).select("customerID", F.col("Churn_Probability").alias("before"))
    after = S.score_batch(writers.load_model(path), t.base).select("customerID", "Churn_Probability")
    return before.join(after, "customerID").agg(_rows(), F.count_if(F.abs(F.col("before") - F.col("Churn_Probability")) < 1e-12).alias("alike"))
