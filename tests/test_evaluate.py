import random

import pytest
from pyspark.sql import functions as F

from ebbline.config import CampaignValue
from ebbline.operators import evaluate as V


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    rows = []
    for i in range(2000):
        y = int(rng.random() < 0.3)
        # A third of the rows share one score.
        p = 0.35 if i % 3 == 0 else min(max(rng.gauss(0.4 + 0.2 * y, 0.2), 0.0), 1.0)
        rows.append(("noisy", y, int(p > 0.5), p))
        rows.append(("perfect", y, y, 0.9 if y else 0.1))
        rows.append(("constant", y, 0, 0.4))
    return rows, spark.createDataFrame(rows, "model string, label int, prediction int, probability double").cache()


def brute_auc(rows):
    pos = [p for _, y, _, p in rows if y == 1]
    neg = [p for _, y, _, p in rows if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def test_auc(scored):
    rows, df = scored
    got = {r.model: r.roc_auc for r in V.roc_auc(df, "model").collect()}
    assert got["perfect"] == 1.0 and got["constant"] == 0.5
    assert got["noisy"] == pytest.approx(brute_auc([r for r in rows if r[0] == "noisy"]), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.4), (1, 0, 0.6)], "label int, prediction int, probability double")
    assert V.roc_auc(df).first().roc_auc is None


def test_auc_equals_the_exact_evaluator(scored):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    _, df = scored
    noisy = df.where("model = 'noisy'")
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0)
    assert V.roc_auc(noisy).first().roc_auc == pytest.approx(evaluator.evaluate(noisy), abs=1e-12)


def test_scores_outside_0_1_still_rank(spark):
    rows = [(1, 1, 5.0), (0, 0, -3.0), (1, 1, 2.0), (0, 0, 2.0)]
    df = spark.createDataFrame(rows, "label int, prediction int, probability double")
    assert V.roc_auc(df).first().roc_auc == pytest.approx(brute_auc([(0, *r) for r in rows]))


def test_crowded_scores_are_spread_over_buckets(spark, monkeypatch):
    # All scores lie within a millionth of each other.
    df = spark.range(5000).select(
        (F.col("id") % 2).cast("int").alias("label"), F.lit(0).alias("prediction"),
        (0.25 + (F.col("id") * 7919 % 5003) * 1e-10).alias("probability"),
    )
    monkeypatch.setattr(V, "SCORE_BUCKETS", 64)
    ranked = V._ranked_scores(df, None)
    sizes = [r["count"] for r in ranked.groupBy("bucket").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 5000 / 64 * 3
    rows = [(0, r.label, 0, r.probability) for r in df.collect()]
    assert V.roc_auc(df).first().roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_zero_denominators_give_zero(scored):
    _, df = scored
    r = V.classification_metrics(df.where("model = 'constant'")).first()
    assert (r.precision, r.recall, r.f1_score) == (0.0, 0.0, 0.0) and r.accuracy > 0.6


def test_sweep_equals_single_thresholds(scored):
    rows, df = scored
    thresholds = [0.1, 0.35, 0.5, 0.8]
    sweep = {(r.model, r.threshold): r for r in V.threshold_sweep(df, "model", thresholds).collect()}
    assert len(sweep) == 12
    for t in thresholds:
        single = {r.model: r for r in V.net_benefit(df, t, "model").collect()}
        for model in single:
            assert sweep[model, t].net_benefit == single[model].net_benefit
            assert sweep[model, t].tp == single[model].tp
    best = V.best_threshold(V.threshold_sweep(df, "model", thresholds), "model").collect()
    for r in best:
        assert r.net_benefit == max(x.net_benefit for (m, _), x in sweep.items() if m == r.model)
    assert len(V.sweep_thresholds()) == 50


def test_curves_end_where_they_should(scored):
    _, df = scored
    noisy = df.where("model = 'noisy'")
    roc = sorted((r.fpr, r.tpr) for r in V.roc_points(noisy).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(V.roc_auc(noisy).first().roc_auc)
    pr = V.precision_recall_points(noisy).collect()
    assert any(r.threshold is None and r.precision == 1.0 and r.recall == 0.0 for r in pr)
    mean = V.precision_summary(noisy).first().mean_precision
    assert mean == pytest.approx(sum(r.precision for r in pr) / len(pr))


def test_report_and_confusion(scored):
    rows, df = scored
    cells = {(r.label, r.prediction): r.n for r in V.confusion_matrix(df.where("model = 'perfect'")).collect()}
    assert cells[0, 1] == cells[1, 0] == 0 and sum(cells.values()) == 2000
    shares = V.confusion_matrix(df, "model", normalise=True).collect()
    assert sum(r.share for r in shares) == pytest.approx(6)
    report = {r["class"]: r for r in V.classification_report(df.where("model = 'noisy'")).collect()}
    assert set(report) == {"No Churn", "Churn", "accuracy", "macro avg", "weighted avg"}
    assert report["accuracy"].precision is None and report["accuracy"].support == 2000
    assert report["accuracy"].f1_score == pytest.approx(report["weighted avg"].recall)
    assert report["weighted avg"].recall == pytest.approx(V.classification_metrics(df.where("model = 'noisy'")).first().accuracy)


def test_business_metrics(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "label int, prediction int")
    r = V.business_metrics(df).first()
    assert r.total_cost == 100 + 500 - 300 and r.cost_per_customer == 75
    assert r.cost_savings == 1000 - 300 and r.customers_retained == 1
    value = CampaignValue(1.0, 1.0, 1.0)
    scored = spark.createDataFrame([(1, 0, 0.9)], "label int, prediction int, probability double")
    assert V.net_benefit(scored, 0.5, value=value).first().net_benefit == 1.0


def test_normalise_and_best(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.7, 1.0), ("c", 0.7, 1.0)], "model string, roc_auc double, flat double")
    got = {r.model: r for r in V.min_max_normalise(df, ["roc_auc", "flat"]).collect()}
    assert (got["a"].roc_auc, got["b"].roc_auc, got["a"].flat) == (0.0, 1.0, None)
    assert V.best_model(df).first().model == "b"
