"""Classifiers, grid search, model comparison and forest-based feature ranking.

Every fit is a Spark job on the encoded table. Boosted trees and forests grow all grid points and folds of a search
together; the other algorithms overlap their fits with a small thread pool whose threads only submit jobs.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.config import FOLDS, RANDOM_SEED, ROLES
from ebbline.functions.scalars import half_even
from ebbline.operators.encode import FEATURES
from ebbline.operators.evaluate import calculate_metrics
from ebbline.operators.histogram_trees import BinnedTable, BoostedTrees, Forest
from ebbline.operators.kernel_svm import KernelSVM
from ebbline.operators.splitting import stratified_folds

log = logging.getLogger(__name__)

# Hyper-parameter grids per algorithm; depth 0 is no bound. Both solvers minimise the same loss, so
# points that differ in the solver share a fit.
GRIDS: dict[str, dict[str, list]] = {
    "RandomForest": {
        "numTrees": [100, 200],
        "maxDepth": [10, 20, 0],
        "minInstancesPerSplit": [2, 5],
        "minInstancesPerNode": [1, 2],
    },
    "GradientBoosting": {
        "maxIter": [100, 200],
        "maxDepth": [3, 6, 9],
        "stepSize": [0.01, 0.1, 0.2],
        "subsamplingRate": [0.8, 1.0],
    },
    "GradientBoostingLeafwise": {
        "maxIter": [100, 200],
        "maxDepth": [3, 6, 9],
        "stepSize": [0.01, 0.1, 0.2],
        "numLeaves": [31, 50, 100],
    },
    "LogisticRegression": {"C": [0.1, 1, 10], "elasticNetParam": [1.0, 0.0], "solver": ["liblinear", "saga"]},
    "SVM": {},
}
#: Rows that are worth a task of their own in an iterative fit, and numbers (rows x features) of a task at most where fits run side by side.
TASK_ROWS = 10_000
SHARED_TASK_CELLS = 1 << 25


def fit_tasks(rows: int, spark: SparkSession, at_once: int = 1, width: int = 1) -> int:
    """Partitions of the rows of an iterative fit, as each sends a result to the driver in every iteration: one a core at most.

    Of fits that run side by side each takes its share of the cores, and more only for tasks of `SHARED_TASK_CELLS` numbers at most.
    """
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(rows // TASK_ROWS, cores, max(-(-cores // at_once), -(-rows * width // SHARED_TASK_CELLS))))


# Other names under which the two boosting profiles are known.
ALIASES = {"XGBoost": "GradientBoosting", "LightGBM": "GradientBoostingLeafwise"}
DEFAULT_ALGORITHMS = ("RandomForest", "GradientBoosting", "GradientBoostingLeafwise")


def get_model(name: str, seed: int = RANDOM_SEED) -> Estimator | None:
    """A fresh estimator by name, ``None`` for an unknown name."""
    name = ALIASES.get(name, name)
    common = {"featuresCol": FEATURES, "labelCol": "label"}
    if name == "RandomForest":
        return Forest(seed=seed, **common)
    if name == "LogisticRegression":
        return LogisticRegression(standardization=False, **common)
    if name == "GradientBoosting":
        return BoostedTrees(seed=seed, **common)
    if name == "GradientBoostingLeafwise":
        # Leaf-wise trees: 31 leaves, 20 rows a leaf, 0.8 of the features a tree, no penalty.
        return BoostedTrees(
            maxDepth=0, stepSize=0.1, numLeaves=31, minInstancesPerNode=20, featureShare=0.8, minWeight=1e-3,
            penalty=0.0, seed=seed, **common,
        )
    if name == "SVM":
        return KernelSVM(seed=seed, **common)
    return None


def get_grid(name: str, budget: int | None = None) -> list[dict]:
    """Grid points of an algorithm; ``budget`` takes that many, spread evenly over the grid."""
    grid = GRIDS.get(ALIASES.get(name, name), {})
    points = [dict(zip(grid, values)) for values in product(*grid.values())] if grid else [{}]
    if budget is not None and budget < len(points):
        points = [points[i * len(points) // budget] for i in range(budget)]
    return points


def _configured(estimator: Estimator, point: Mapping, rows: int) -> Estimator:
    params = {k: v for k, v in point.items() if k != "solver"}
    if "C" in params:
        # C scales the summed loss, regParam the mean loss plus penalty.
        params["regParam"] = 1.0 / (params.pop("C") * max(rows, 1))
    return estimator.copy({estimator.getParam(k): v for k, v in params.items()})


@dataclass
class TrainedModel:
    name: str
    model: Model
    params: dict = field(default_factory=dict)
    cv_auc: float | None = None
    train_accuracy: float | None = None
    test_accuracy: float | None = None
    roc_auc: float | None = None
    #: Every grid point tried with its AUC on each fold.
    tried: list[tuple[dict, list[float]]] = field(default_factory=list)


def grid_search(
    name: str, train: DataFrame, points: Sequence[Mapping], folds: int = FOLDS,
    parallelism: int = 8, key: str = ROLES.key, seed: int = RANDOM_SEED,
) -> tuple[Mapping, float]:
    """Best grid point by mean AUC over stratified folds; the first point wins ties."""
    best, _, means, _ = search(name, train, points, folds, parallelism, key, seed)
    return points[best], means[best]


def search(
    name: str, train: DataFrame, points: Sequence[Mapping], folds: int = FOLDS,
    parallelism: int = 8, key: str = ROLES.key, seed: int = RANDOM_SEED,
) -> tuple[int, list[list[float]], list[float], Model | None]:
    """Place of the best point, the AUC of every point and fold, the means, and the refit where the search gives it."""
    # Persisted because every fit and every fold reads it again; small partitions are joined, as each costs a task in
    # every iteration of a fit.
    parts = stratified_folds(train, "label", key, folds, seed).coalesce(fit_tasks(train.count(), train.sparkSession))
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    estimator = get_model(name, seed)
    try:
        if isinstance(estimator, (BoostedTrees, Forest)):
            best, areas, model = estimator.search(parts, points, folds)
            return best, areas, [sum(a) / folds for a in areas], model
        rows = parts.count()
        evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
        # Points that set the same parameters of the estimator share their fits.
        effective = [{k: v for k, v in p.items() if k != "solver"} for p in points]
        first = [effective.index(p) for p in effective]
        tasks = list(product(range(folds), sorted(set(first))))
        at_once = min(parallelism, len(tasks))
        one = parts.select(FEATURES).first()
        shared = fit_tasks(rows, train.sparkSession, at_once, one[FEATURES].size if one else 1)

        def score(task):
            fold, i = task
            fitted = _configured(get_model(name, seed), points[i], rows * (folds - 1) // folds).fit(
                parts.where(F.col("fold") != fold).coalesce(shared)
            )
            return (i, fold), evaluator.evaluate(fitted.transform(parts.where(F.col("fold") == fold)))

        with ThreadPool(at_once) as pool:
            scores = dict(pool.map(score, tasks))
    finally:
        parts.unpersist()
    areas = [[scores[i, fold] for fold in range(folds)] for i in first]
    means = [sum(a) / folds for a in areas]
    return max(range(len(points)), key=lambda j: (means[j], -j)), areas, means, None


def train_model(
    name: str, train: DataFrame, test: DataFrame | None = None, budget: int | None = None,
    folds: int = FOLDS, parallelism: int = 8, overrides: Mapping | None = None,
    seed: int = RANDOM_SEED,
) -> TrainedModel:
    """Tune (when there is more than one grid point), refit on all train rows, evaluate.

    ``overrides`` fixes parameters for every grid point, e.g. fewer trees.
    """
    estimator = get_model(name, seed)
    if estimator is None:
        raise ValueError(f"unknown algorithm {name}")
    points = [{**p, **(overrides or {})} for p in get_grid(name, budget)]
    points = [p for i, p in enumerate(points) if p not in points[:i]]
    best, auc, fitted, tried = points[0], None, None, []
    if len(points) > 1:
        place, areas, means, fitted = search(name, train, points, folds, parallelism, seed=seed)
        best, auc, tried = points[place], means[place], list(zip(points, areas))
    if fitted is None:
        rows = train.count() if "C" in best else 0
        fitted = _configured(estimator, best, rows).fit(train)
    # Train and test are scored together, so both are measured in one job.
    scored = scored_by(fitted, train, "train")
    if test is not None:
        scored = scored.unionByName(scored_by(fitted, test, "test"))
    # The measures read the scores several times.
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    measured = {r["model"]: r for r in calculate_metrics(scored, "model").collect()}
    scored.unpersist()
    result = TrainedModel(name, fitted, dict(best), auc, measured["train"]["accuracy"], tried=tried)
    if test is not None and "test" in measured:
        result.test_accuracy = measured["test"]["accuracy"]
        result.roc_auc = measured["test"]["roc_auc"]
    return result


def train_all(
    train: DataFrame, test: DataFrame, algorithms: Sequence[str] = DEFAULT_ALGORITHMS, **options
) -> dict[str, TrainedModel]:
    """Train every algorithm; one that fails is reported and left out."""
    results = {}
    for name in algorithms:
        try:
            results[name] = train_model(name, train, test, **options)
        except Exception as error:  # the other algorithms still count
            log.error("training %s failed: %s", name, error)
    return results


def best_trained(results: Mapping[str, TrainedModel]) -> TrainedModel | None:
    """Highest test AUC; an equal later one does not replace an earlier one."""
    best = None
    for trained in results.values():
        if trained.roc_auc is not None and (best is None or trained.roc_auc > best.roc_auc):
            best = trained
    return best


def scored_by(model: Model, data: DataFrame, name: str, key: str = ROLES.key) -> DataFrame:
    """``key, label, prediction, probability, model`` for the metric operators."""
    return model.transform(data).select(
        key,
        "label",
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
        F.lit(name).alias("model"),
    )


def compare_models(results: Mapping[str, TrainedModel], test: DataFrame) -> DataFrame:
    """Comparison table of all models from one grouped metric pass."""
    scored = None
    for name, trained in results.items():
        part = scored_by(trained.model, test, name)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("no model was trained")
    texts = F.create_map(
        *[x for name, t in results.items() for x in (F.lit(name), F.lit(str(t.params)))]
    )
    metrics = calculate_metrics(scored, "model")
    return metrics.select(
        F.col("model").alias("Model"),
        F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        F.col("f1_score").alias("F1-Score"),
        F.col("roc_auc").alias("ROC-AUC"),
        texts[F.col("model")].alias("Best Parameters"),
    )


def _forest(model: Model) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def model_importance(model: Model, names: Sequence[str], spark) -> DataFrame:
    """Feature importances of a fitted tree model (one row per feature)."""
    values = _forest(model).featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def forest_importance(
    encoded: DataFrame, names: Sequence[str], trees: int = 100, depth: int = 10,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    forest = Forest(numTrees=trees, maxDepth=depth, seed=seed, featuresCol=FEATURES).fit(encoded)
    return model_importance(forest, names, encoded.sparkSession)


def cumulative_importance(importance: DataFrame, top: int | None = None, digits: int = 4) -> DataFrame:
    """Importances rounded first, then added up from the largest down.

    The table has one row per feature, so the global window is over a bounded table.
    """
    ranked = importance.orderBy(F.desc("importance"), "feature")
    if top is not None:
        ranked = ranked.limit(top)
    order = (
        Window.orderBy(F.desc("importance"), "feature")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rounded = half_even("importance", digits)
    return ranked.select(
        "feature", rounded.alias("importance"), F.sum(rounded).over(order).alias("cumulative_importance")
    )


def eliminate_features(
    encoded: DataFrame, names: Sequence[str], keep: int = 15, step: int = 1, trees: int = 100,
    depth: int = 10, seed: int = RANDOM_SEED,
) -> DataFrame:
    """Recursive elimination with a forest: ``feature, ranking, support``; ranking 1 is kept.

    One forest a round over the same binned table; ``step`` features leave per round.
    """
    left = list(range(len(names)))
    dropped: list[list[int]] = []
    grown = Forest(numTrees=trees, maxDepth=depth, seed=seed)
    key = ROLES.key if ROLES.key in encoded.columns else None
    with BinnedTable(encoded, FEATURES, len(names), key) as table:
        while len(left) > keep:
            fit = replace(grown.settings(len(left)), columns=tuple(left))
            weights = table.gain_shares(fit, len(names), seed)
            order = sorted(left, key=lambda i: (weights[i], i))
            leaving = set(order[: min(step, len(left) - keep)])
            dropped.append(sorted(leaving))
            left = [i for i in left if i not in leaving]
    ranking = dict.fromkeys(left, 1)
    for place, leaving in enumerate(reversed(dropped), start=2):
        ranking.update(dict.fromkeys(leaving, place))
    rows = [(names[i], ranking[i], ranking[i] == 1) for i in range(len(names))]
    schema = "feature string, ranking int, support boolean"
    return encoded.sparkSession.createDataFrame(rows, schema).orderBy("ranking", "feature")
