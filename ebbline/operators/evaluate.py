"""Model evaluation on a scored table ``(label, prediction, probability[, model])``.

Every operator works for all models in one pass (``by='model'``). Curves first merge equal scores
and take running totals in score ranges, so they do not sort all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import CampaignValue, CostMatrix
from ebbline.functions.scalars import double_array, ratio
from ebbline.operators.ordered import range_bucket, running_totals, value_splits
from ebbline.operators.reshape import stack_columns

SCORE_BUCKETS = 1024


def _keys(by: str | None) -> list[str]:
    return [by] if by else []


def confusion_counts(scored: DataFrame, by: str | None = None) -> DataFrame:
    """``tp, fp, fn, tn`` (and the row count) per model in one aggregation."""
    y, p = F.col("label"), F.col("prediction")
    return scored.groupBy(*_keys(by)).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if(y.isNotNull() & p.isNotNull()).alias("n"),
    )


def _basic_metrics() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    }


def classification_metrics(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is 0."""
    counts = confusion_counts(scored, by)
    return counts.select(*_keys(by), *[m.alias(name) for name, m in _basic_metrics().items()])


def _ranked_scores(scored: DataFrame, by: str | None) -> DataFrame:
    """One row per distinct score with the totals of all higher scores.

    One pass finds score borders that split the rows evenly, so scores that crowd in a narrow range
    are spread over tasks as well.
    """
    known = scored.where(F.col("label").isNotNull() & F.col("probability").isNotNull())
    borders = value_splits(known, ["probability"], SCORE_BUCKETS)["probability"]
    merged = known.groupBy(*_keys(by), "probability").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.sum(1 - F.col("label").cast("bigint")).alias("neg"),
    )
    # Negative, so that the lowest bucket number holds the highest scores.
    bucket = -range_bucket(F.col("probability"), double_array(borders), SCORE_BUCKETS)
    return running_totals(
        merged.withColumn("bucket", bucket),
        _keys(by),
        "bucket",
        [F.desc("probability")],
        ["pos", "neg"],
    )


def roc_auc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Area under the ROC curve; pairs with equal scores count half. Null with one class only."""
    ranked = _ranked_scores(scored, by)
    # For every negative the positives that score higher, plus half of those that score the same.
    wins = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return ranked.groupBy(*_keys(by)).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def calculate_metrics(scored: DataFrame, by: str | None = None) -> DataFrame:
    """The five headline metrics per model."""
    basic, area = classification_metrics(scored, by), roc_auc(scored, by)
    # One row per model on both sides.
    return basic.join(area, by) if by else basic.crossJoin(F.broadcast(area))


def confusion_matrix(scored: DataFrame, by: str | None = None, normalise: bool = False) -> DataFrame:
    """Count (or share of the true label's rows) for all four label/prediction cells."""
    cells = confusion_counts(scored, by).select(
        *_keys(by),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n")
                    )
                    for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
                ]
            )
        ),
    )
    if not normalise:
        return cells
    row = Window.partitionBy(*_keys(by), "label")
    share = ratio(F.col("n"), F.sum("n").over(row))
    return cells.select(*_keys(by), "label", "prediction", share.alias("share"))


def roc_points(scored: DataFrame, by: str | None = None) -> DataFrame:
    """All ROC points, from (0, 0) without a threshold to the lowest score."""
    ranked = _ranked_scores(scored, by)
    points = ranked.select(
        *_keys(by),
        F.col("probability").alias("threshold"),
        ratio(F.col("neg_before") + F.col("neg"), F.col("neg_all")).alias("fpr"),
        ratio(F.col("pos_before") + F.col("pos"), F.col("pos_all")).alias("tpr"),
    )
    models = scored.select(*_keys(by)).distinct() if by else scored.sparkSession.range(1).select()
    start = models.select(
        *_keys(by),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return start.unionByName(points)


def precision_recall_points(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Precision and recall at every distinct score, plus the end point (recall 0, precision 1)."""
    ranked = _ranked_scores(scored, by)
    hits = F.col("pos_before") + F.col("pos")
    points = ranked.select(
        *_keys(by),
        F.col("probability").alias("threshold"),
        ratio(hits, hits + F.col("neg_before") + F.col("neg")).alias("precision"),
        ratio(hits, F.col("pos_all")).alias("recall"),
    )
    models = scored.select(*_keys(by)).distinct() if by else scored.sparkSession.range(1).select()
    end = models.select(
        *_keys(by),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def precision_summary(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Plain mean of the curve's precision values, and the recall-weighted average precision."""
    ranked = _ranked_scores(scored, by)
    hits = F.col("pos_before") + F.col("pos")
    precision = ratio(hits, hits + F.col("neg_before") + F.col("neg"))
    return ranked.groupBy(*_keys(by)).agg(
        # The end point (precision 1) is part of the curve.
        F.try_divide(F.sum(precision) + 1, F.count(F.lit(1)) + 1).alias("mean_precision"),
        F.sum(precision * F.try_divide(F.col("pos"), F.col("pos_all"))).alias("average_precision"),
    )


def classification_report(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, the accuracy, then macro and weighted averages.

    The accuracy of all rows stands under ``f1_score`` of the row ``accuracy``, which has no precision
    and no recall.
    """
    counts = confusion_counts(scored, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    classes = counts.select(
        *_keys(by),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("class"),
                        ratio(hit, hit + wrong).alias("precision"),
                        ratio(hit, hit + missed).alias("recall"),
                        ratio(2 * hit, 2 * hit + wrong + missed).alias("f1_score"),
                        (hit + missed).alias("support"),
                    )
                    for name, hit, wrong, missed in (
                        ("No Churn", tn, fn, fp),
                        ("Churn", tp, fp, fn),
                    )
                ]
            )
        ),
    )
    measures = ("precision", "recall", "f1_score")
    averages = classes.groupBy(*_keys(by)).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        F.sum("support").alias("support"),
    )
    average_rows = averages.select(
        *_keys(by),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("class"),
                        *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                        F.col("support"),
                    )
                    for kind in ("macro", "weighted")
                ]
            )
        ),
    )
    total = tp + fp + fn + tn
    unknown = F.lit(None).cast("double")
    accuracy_row = counts.select(
        *_keys(by), F.lit("accuracy").alias("class"), unknown.alias("precision"), unknown.alias("recall"),
        ratio(tp + tn, total).alias("f1_score"), total.alias("support"),
    )
    return classes.unionByName(accuracy_row).unionByName(average_rows)


def business_metrics(
    scored: DataFrame, by: str | None = None, costs: CostMatrix = CostMatrix()
) -> DataFrame:
    """Outcome counts with their total cost and cost per customer.

    The last three columns compare with doing nothing: money saved, customers kept and return on
    the money spent on contacts.
    """
    counts = confusion_counts(scored, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = fp * costs.fp_cost + fn * costs.fn_cost - tp * costs.tp_benefit - tn * costs.tn_benefit
    nothing_done = (tp + fn) * costs.fn_cost
    return counts.select(
        *_keys(by),
        tp.alias("true_positives"),
        tn.alias("true_negatives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        total.alias("total_cost"),
        F.try_divide(total, F.col("n")).alias("cost_per_customer"),
        (nothing_done - total).alias("cost_savings"),
        tp.alias("customers_retained"),
        F.try_divide(tp * costs.tp_benefit - fp * costs.fp_cost, (tp + fp) * costs.fp_cost).alias("roi"),
    )


def net_benefit(
    scored: DataFrame,
    threshold: float = 0.5,
    by: str | None = None,
    value: CampaignValue = CampaignValue(),
) -> DataFrame:
    """Campaign value when everyone above the threshold is contacted."""
    decided = scored.withColumn("prediction", (F.col("probability") > threshold).cast("int"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion_counts(decided, by).select(
        *_keys(by), "tp", "fp", "fn", "tn",
        (tp * value.tp_value - fp * value.fp_cost - fn * value.fn_cost).alias("net_benefit"),
    )


def sweep_thresholds(low: float = 0.1, high: float = 0.9, points: int = 50) -> list[float]:
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def threshold_sweep(
    scored: DataFrame,
    by: str | None = None,
    thresholds: Sequence[float] | None = None,
    value: CampaignValue = CampaignValue(),
) -> DataFrame:
    """Net benefit at many thresholds from one pass over the scores.

    A row only matters through the number of thresholds its score exceeds. Rows are counted per
    that number, and the totals per threshold are running sums over at most 51 rows per model.
    """
    thresholds = sorted(thresholds or sweep_thresholds())
    borders = double_array(thresholds)
    passed = F.size(F.filter(borders, lambda t: t < F.col("probability")))
    cells = (
        scored.where(F.col("label").isNotNull() & F.col("probability").isNotNull())
        .groupBy(*_keys(by), passed.alias("passed"))
        .agg(
            F.sum(F.col("label").cast("bigint")).alias("pos"),
            F.sum(1 - F.col("label").cast("bigint")).alias("neg"),
        )
    )
    # A row that passes k thresholds is positive at the first k of them.
    spread = cells.select(
        *_keys(by), "pos", "neg",
        F.posexplode(
            F.transform(
                borders,
                lambda t, i: F.struct(t.alias("threshold"), (i < F.col("passed")).alias("hit")),
            )
        ).alias("step", "at"),
    )
    hit = F.col("at.hit")
    counts = spread.groupBy(*_keys(by), F.col("at.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    benefit = (
        F.col("tp") * value.tp_value - F.col("fp") * value.fp_cost - F.col("fn") * value.fn_cost
    )
    return counts.select(*_keys(by), "threshold", "tp", "fp", "fn", benefit.alias("net_benefit"))


def best_threshold(sweep: DataFrame, by: str | None = None) -> DataFrame:
    """Threshold with the highest net benefit; the lowest threshold wins ties."""
    best = F.min(F.struct((-F.col("net_benefit")).alias("loss"), F.col("threshold").alias("t")))
    return sweep.groupBy(*_keys(by)).agg(best.alias("best")).select(
        *_keys(by), F.col("best.t").alias("threshold"), (-F.col("best.loss")).alias("net_benefit")
    )


def comprehensive_report(scored: DataFrame, by: str = "model") -> DataFrame:
    """Metrics, per-class report, business metrics and confusion cells as long rows."""

    def long(df: DataFrame, section: str, names: Sequence[str], prefix: Column | None = None):
        name = F.col("metric") if prefix is None else F.concat_ws(" / ", prefix, F.col("metric"))
        ids = [by] + (["class"] if "class" in df.columns else [])
        values = df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
        return stack_columns(values, ids, list(names), "metric", "value").select(
            by, F.lit(section).alias("section"), name.alias("metric"), "value"
        )

    basic = calculate_metrics(scored, by)
    report = classification_report(scored, by)
    business = business_metrics(scored, by)
    return (
        long(basic, "basic", ["accuracy", "precision", "recall", "f1_score", "roc_auc"])
        .unionByName(
            long(report, "class", ["precision", "recall", "f1_score", "support"], F.col("class"))
        )
        .unionByName(
            long(
                business,
                "business",
                [
                    "true_positives", "true_negatives", "false_positives", "false_negatives",
                    "total_cost", "cost_per_customer",
                ],
            )
        )
    )


def min_max_normalise(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale metric columns to 0..1 across models; null where all models agree."""
    spans = metrics.agg(
        *[F.min(c).alias(f"{c}:low") for c in columns], *[F.max(c).alias(f"{c}:high") for c in columns]
    )
    scaled = {
        c: F.try_divide(F.col(c) - F.col(f"{c}:low"), F.col(f"{c}:high") - F.col(f"{c}:low"))
        for c in columns
    }
    return metrics.crossJoin(F.broadcast(spans)).withColumns(scaled).select(*metrics.columns)


def best_model(metrics: DataFrame, score: str = "roc_auc", name: str = "model") -> DataFrame:
    """The model with the highest score; the first name wins ties."""
    pick = F.min(F.struct((-F.col(score)).alias("loss"), F.col(name).alias("name")))
    top = metrics.where(F.col(score).isNotNull()).agg(pick.alias("best"))
    return top.select(F.col("best.name").alias(name), (-F.col("best.loss")).alias(score))
