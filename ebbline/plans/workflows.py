"""End-to-end flows: train and compare, score, and report effects."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.config import RANDOM_SEED, ROLES, TEST_SHARE, ColumnRoles
from ebbline.operators import attribute, effects, encode, models, score
from ebbline.operators.clean import clean
from ebbline.operators.splitting import stratified_split
from ebbline.sources import writers


log = logging.getLogger(__name__)


@dataclass
class Prepared:
    """Encoded train and test rows (persisted) with their encoder."""

    table: DataFrame
    encoder: PipelineModel
    names: list[str]
    #: Partitions of the train rows: small ones are joined, as each costs a task in every iteration of a fit.
    tasks: int | None = None

    def _part(self, name: str) -> DataFrame:
        return self.table.where(F.col("split") == name).drop("split")

    @property
    def train(self) -> DataFrame:
        return self._part("train") if self.tasks is None else self._part("train").coalesce(self.tasks)

    @property
    def test(self) -> DataFrame:
        return self._part("test")

    def release(self) -> None:
        self.table.unpersist()


def prepare(
    raw: DataFrame, roles: ColumnRoles = ROLES, test_share: float = TEST_SHARE,
    seed: int = RANDOM_SEED, fit_on: str = "train",
) -> Prepared:
    """Split, then encode. The encoder sees the train rows only unless ``fit_on='all'``.

    The needed columns are kept while split borders and encoder constants are found, as each of
    those is a pass over the rows.
    """
    kept = raw.select(roles.key, roles.target, *roles.features).persist(StorageLevel.MEMORY_AND_DISK)
    parts = stratified_split(kept, roles.target, roles.key, test_share, seed)
    source = parts if fit_on == "all" else parts.where(F.col("split") == "train")
    encoder = encode.fit_encoder(source.drop("split"), roles)
    coded = clean(encoder.transform(parts), roles).select(
        roles.key, F.col(roles.target).alias("label"), encode.FEATURES, "split"
    )
    table = coded.where(F.col("label").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = models.fit_tasks(table.count(), table.sparkSession)
    kept.unpersist()
    return Prepared(table, encoder, encode.feature_names(encoder, roles), tasks)


def train_and_compare(
    raw: DataFrame, algorithms: Sequence[str] = models.DEFAULT_ALGORITHMS,
    roles: ColumnRoles = ROLES, **options,
) -> tuple[Prepared, dict[str, models.TrainedModel], DataFrame]:
    prepared = prepare(raw, roles)
    trained = models.train_all(prepared.train, prepared.test, algorithms, **options)
    return prepared, trained, models.compare_models(trained, prepared.test)


def run_training(
    raw: DataFrame, folder: str, algorithms: Sequence[str] = models.DEFAULT_ALGORITHMS,
    roles: ColumnRoles = ROLES, explain_rows: int | None = None, **options: Mapping,
) -> dict[str, str]:
    """Train, compare, explain and write every artefact under ``folder``; returns their paths.

    A failing explanation or effect report is left out; the models are kept.
    """
    prepared, trained, comparison = train_and_compare(raw, algorithms, roles, **options)
    best = models.best_trained(trained)
    if best is None:
        raise ValueError("no model could be trained")
    pipeline_path, split_path = f"{folder}/model", f"{folder}/prepared"
    writers.save_model(score.scoring_pipeline(prepared.encoder, best.model), pipeline_path)
    writers.write_split_table(prepared.table, split_path)
    cleaned_path = f"{folder}/cleaned"
    writers.write_table(clean(raw, roles), cleaned_path)
    cleaned = raw.sparkSession.read.parquet(cleaned_path)

    def attribution() -> DataFrame:
        rows = attribute.explain(
            prepared.test, best.model, prepared.names, prepared.train, roles.key, sample_size=explain_rows
        )
        return attribute.attribution_importance(rows)

    reports = {
        "model_comparison": lambda: comparison,
        "feature_importance": lambda: models.forest_importance(prepared.train, prepared.names),
        "anova_scores": lambda: encode.anova_of_vector(prepared.train, prepared.names),
        "attribution_importance": attribution,
        "treatment_effects": lambda: effects.effect_summary(cleaned, roles.treatments),
    }
    paths = {}
    for name, build in reports.items():
        try:
            paths |= writers.write_reports({name: build()}, f"{folder}/reports")
        except Exception:  # a report is no reason to lose the model
            log.exception("report %s is left out", name)
    metadata = raw.sparkSession.createDataFrame(
        [(best.name, str(best.params), best.roc_auc, best.test_accuracy, len(prepared.names))],
        "model string, params string, roc_auc double, test_accuracy double, features int",
    )
    writers.write_json_report(metadata, f"{folder}/metadata")
    prepared.release()
    return {
        **paths, "model": pipeline_path, "prepared": split_path, "cleaned": cleaned_path,
        "metadata": f"{folder}/metadata",
    }


def run_batch_scoring(spark, model_path: str, customers: DataFrame, output: str) -> DataFrame:
    """Load a saved pipeline, score, write, and return the scored table as read back."""
    scored = score.score_batch(writers.load_model(model_path), customers)
    writers.write_table(scored, output)
    return spark.read.schema(scored.schema).parquet(output)
