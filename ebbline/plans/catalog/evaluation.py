"""Queries: model evaluation, on scores that need no fitted model so that SQL can check them."""

from __future__ import annotations

from ebbline.operators import evaluate as V
from ebbline.plans.catalog.registry import query, r6

COUNTS = """k AS (SELECT model, COUNT(*) FILTER (label=1 AND prediction=1)*1e0 AS tp, COUNT(*) FILTER (label=0 AND prediction=1)*1e0 AS fp,
    COUNT(*) FILTER (label=1 AND prediction=0)*1e0 AS fn, COUNT(*) FILTER (label=0 AND prediction=0)*1e0 AS tn, COUNT(*)*1e0 AS n
    FROM sc GROUP BY model),
  m AS (SELECT *, (tp+tn)/n AS accuracy, COALESCE(tp/NULLIF(tp+fp,0),0) AS prec, COALESCE(tp/NULLIF(tp+fn,0),0) AS recall,
    COALESCE(2*tp/NULLIF(2*tp+fp+fn,0),0) AS f1 FROM k)"""
# Equal scores count half: mid-ranks of the positives give the area.
AUC = """rk AS (SELECT model, label, probability, RANK() OVER (PARTITION BY model ORDER BY probability)
      + (COUNT(*) OVER (PARTITION BY model, probability)-1)/2e0 AS r FROM sc),
  auc AS (SELECT model, (SUM(r) FILTER (label=1) - COUNT(*) FILTER (label=1)*(COUNT(*) FILTER (label=1)+1)/2e0)
      /(COUNT(*) FILTER (label=1)*1e0*COUNT(*) FILTER (label=0)) AS area FROM rk GROUP BY model)"""


@query(
    "v01_classification_metrics",
    COUNTS + f""" SELECT model, {r6('accuracy', 'accuracy')}, {r6('prec', '"precision"')}, {r6('recall', 'recall')}, {r6('f1', 'f1_score')} FROM m""",
)
def _(t):
    return V.classification_metrics(t.scored, "model")


@query("v02_roc_auc", AUC + f" SELECT model, {r6('area', 'roc_auc')} FROM auc")
def _(t):
    return V.roc_auc(t.scored, "model")


@query(
    "v02b_headline_metrics",
    COUNTS + ", " + AUC + f""" SELECT m.model, {r6('accuracy', 'accuracy')}, {r6('prec', '"precision"')}, {r6('recall', 'recall')},
    {r6('f1', 'f1_score')}, {r6('area', 'roc_auc')} FROM m JOIN auc ON m.model=auc.model""",
)
def _(t):
    return V.calculate_metrics(t.scored, "model")


GRID = """grid AS (SELECT models.model, l.label, p.prediction FROM (SELECT DISTINCT model FROM sc) models
    CROSS JOIN (VALUES (0),(1)) l(label) CROSS JOIN (VALUES (0),(1)) p(prediction)),
  cells AS (SELECT g.model, g.label, g.prediction, COUNT(sc.model) AS n FROM grid g LEFT JOIN sc
    ON sc.model=g.model AND sc.label=g.label AND sc.prediction=g.prediction GROUP BY 1,2,3)"""


@query("v03_confusion_matrix", GRID + " SELECT * FROM cells")
def _(t):
    return V.confusion_matrix(t.scored, "model")


@query(
    "v04_confusion_matrix_normalised",
    GRID + f""" SELECT model, label, prediction, {r6('COALESCE(n*1e0/NULLIF(SUM(n) OVER (PARTITION BY model, label),0),0)', 'share')} FROM cells""",
)
def _(t):
    return V.confusion_matrix(t.scored, "model", normalise=True)


CURVE = """d AS (SELECT model, probability, SUM(label)*1e0 AS pos, SUM(1-label)*1e0 AS neg FROM sc GROUP BY 1,2),
  cum AS (SELECT model, probability, pos, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY model) AS p,
    SUM(neg) OVER (PARTITION BY model) AS n FROM d WINDOW w AS (PARTITION BY model ORDER BY probability DESC))"""


@query(
    "v05_roc_points",
    CURVE + f""" SELECT model, {r6('probability', 'threshold')}, {r6('fp/n', 'fpr')}, {r6('tp/p', 'tpr')} FROM cum
    UNION ALL SELECT DISTINCT model, NULL, 0e0, 0e0 FROM sc""",
)
def _(t):
    return V.roc_points(t.scored, "model")


@query(
    "v06_precision_recall_points",
    CURVE + f""" SELECT model, {r6('probability', 'threshold')}, {r6('tp/(tp+fp)', '"precision"')}, {r6('tp/p', 'recall')} FROM cum
    UNION ALL SELECT DISTINCT model, NULL, 1e0, 0e0 FROM sc""",
)
def _(t):
    return V.precision_recall_points(t.scored, "model")


@query(
    "v06b_mean_precision",
    CURVE + f""" SELECT model, {r6('(SUM(tp/(tp+fp))+1)/(COUNT(*)+1)', 'mean_precision')},
    {r6('SUM(tp/(tp+fp)*pos/p)', 'average_precision')} FROM cum GROUP BY model""",
)
def _(t):
    return V.precision_summary(t.scored, "model")


REPORT = """cls AS (SELECT model, 'No Churn' AS class, COALESCE(tn/NULLIF(tn+fn,0),0) AS pr, COALESCE(tn/NULLIF(tn+fp,0),0) AS re,
      COALESCE(2*tn/NULLIF(2*tn+fn+fp,0),0) AS f1, tn+fp AS support FROM k
    UNION ALL SELECT model, 'Churn', COALESCE(tp/NULLIF(tp+fp,0),0), COALESCE(tp/NULLIF(tp+fn,0),0), COALESCE(2*tp/NULLIF(2*tp+fp+fn,0),0), tp+fn FROM k),
  rep AS (SELECT * FROM cls
    UNION ALL SELECT model, 'accuracy', NULL, NULL, COALESCE((tp+tn)/NULLIF(tp+tn+fp+fn,0),0), tp+tn+fp+fn FROM k
    UNION ALL SELECT model, 'macro avg', AVG(pr), AVG(re), AVG(f1), SUM(support) FROM cls GROUP BY model
    UNION ALL SELECT model, 'weighted avg', SUM(pr*support)/SUM(support), SUM(re*support)/SUM(support), SUM(f1*support)/SUM(support), SUM(support) FROM cls GROUP BY model)"""


@query(
    "v07_classification_report",
    COUNTS + ", " + REPORT + f""" SELECT model, class, {r6('pr', '"precision"')}, {r6('re', 'recall')}, {r6('f1', 'f1_score')},
    CAST(support AS BIGINT) AS support FROM rep""",
)
def _(t):
    return V.classification_report(t.scored, "model")


@query(
    "v08_business_metrics",
    COUNTS + f""" SELECT model, CAST(tp AS BIGINT) AS true_positives, CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives,
    CAST(fn AS BIGINT) AS false_negatives, fp*100+fn*500-tp*300 AS total_cost, {r6('(fp*100+fn*500-tp*300)/n', 'cost_per_customer')},
    (tp+fn)*500-(fp*100+fn*500-tp*300) AS cost_savings, CAST(tp AS BIGINT) AS customers_retained,
    {r6('(tp*300-fp*100)/NULLIF((tp+fp)*100,0)', 'roi')} FROM k""",
)
def _(t):
    return V.business_metrics(t.scored, "model")


BENEFIT = "SUM(CASE WHEN label=1 AND probability>{t} THEN 500e0 WHEN label=1 THEN -500e0 WHEN probability>{t} THEN -50e0 ELSE 0e0 END)"


@query(
    "v09_net_benefit",
    f"""SELECT model, COUNT(*) FILTER (label=1 AND probability>0.45e0) AS tp, COUNT(*) FILTER (label=0 AND probability>0.45e0) AS fp,
    COUNT(*) FILTER (label=1 AND probability<=0.45e0) AS fn, COUNT(*) FILTER (label=0 AND probability<=0.45e0) AS tn,
    {BENEFIT.format(t='0.45e0')} AS net_benefit FROM sc GROUP BY model""",
)
def _(t):
    return V.net_benefit(t.scored, 0.45, "model")


SWEEP = f"""th AS (SELECT 0.1e0 + (0.9e0-0.1e0)*i/49 AS threshold FROM (SELECT UNNEST(RANGE(50)) AS i)),
  sw AS (SELECT model, threshold, COUNT(*) FILTER (label=1 AND probability>threshold) AS tp, COUNT(*) FILTER (label=0 AND probability>threshold) AS fp,
    COUNT(*) FILTER (label=1 AND probability<=threshold) AS fn, {BENEFIT.format(t='threshold')} AS net_benefit FROM sc CROSS JOIN th GROUP BY 1,2)"""


@query("v10_threshold_sweep", SWEEP + f" SELECT model, {r6('threshold', 'threshold')}, tp, fp, fn, net_benefit FROM sw")
def _(t):
    return V.threshold_sweep(t.scored, "model")


BASIC = [("accuracy", "accuracy"), ("precision", "prec"), ("recall", "recall"), ("f1_score", "f1")]
BUSINESS = [
    ("true_positives", "tp"), ("true_negatives", "tn"), ("false_positives", "fp"), ("false_negatives", "fn"),
    ("total_cost", "fp*100+fn*500-tp*300"), ("cost_per_customer", "(fp*100+fn*500-tp*300)/n"),
]


@query(
    "v11_comprehensive_report",
    COUNTS + ", " + AUC + ", " + REPORT + " " + " UNION ALL ".join(
        [f"SELECT model, 'basic' AS section, '{name}' AS metric, {r6(x, 'value')} FROM m" for name, x in BASIC]
        + [f"SELECT model, 'basic', 'roc_auc', {r6('area', 'value')} FROM auc"]
        + [f"SELECT model, 'class', class || ' / {name}', {r6(x, 'value')} FROM rep"
           for name, x in (("precision", "pr"), ("recall", "re"), ("f1_score", "f1"), ("support", "support"))]
        + [f"SELECT model, 'business', '{name}', {r6(x, 'value')} FROM k" for name, x in BUSINESS]
    ),
)
def _(t):
    return V.comprehensive_report(t.scored, "model")


@query(
    "v12_best_threshold",
    SWEEP + f""", b AS (SELECT model, threshold, net_benefit, ROW_NUMBER() OVER (PARTITION BY model ORDER BY net_benefit DESC, threshold) AS r FROM sw)
    SELECT model, {r6('threshold', 'threshold')}, net_benefit FROM b WHERE r=1""",
)
def _(t):
    return V.best_threshold(V.threshold_sweep(t.scored, "model"), "model")


@query(
    "m18_best_model",
    AUC + f" SELECT model, {r6('area', 'roc_auc')} FROM auc ORDER BY area DESC, model LIMIT 1",
)
def _(t):
    return V.best_model(V.roc_auc(t.scored, "model"))
