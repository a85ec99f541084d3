import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbline.operators import models as M
from ebbline.operators.evaluate import roc_auc
from ebbline.operators.kernel_svm import FourierFeatures, KernelSVM
from tests.test_tree_models import vectors


@pytest.fixture(scope="module")
def rings(spark):
    """Label by distance from the origin: no line separates the classes. A tenth of the labels is turned."""
    rng = np.random.default_rng(4)
    angle, y = rng.uniform(0, 2 * np.pi, 900), rng.integers(0, 2, 900)
    r = np.where(y == 1, 2.0, 1.0) + rng.normal(scale=0.15, size=900)
    y = np.where(rng.uniform(size=900) < 0.1, 1 - y, y)
    return vectors(spark, [(i, int(y[i]), float(r[i] * np.cos(angle[i])), float(r[i] * np.sin(angle[i]))) for i in range(900)], 1)


def auc(model, rows):
    return roc_auc(M.scored_by(model, rows, "m"), "model").first()["roc_auc"]


def test_kernel_machine_separates_rings_and_is_calibrated(rings, tmp_path):
    train, test = rings.where("customerID % 3 > 0").cache(), rings.where("customerID % 3 = 0").cache()
    model = KernelSVM().fit(train)
    assert auc(M.get_model("LogisticRegression").fit(train), test) < 0.62
    assert auc(model, test) > 0.85
    p = vector_to_array("probability")[1]
    bins = model.transform(test).groupBy((p > 0.5).alias("side")).agg(F.avg("label").alias("share"), F.avg(p).alias("p")).collect()
    assert len(bins) == 2 and all(abs(r["share"] - r["p"]) < 0.07 for r in bins)
    path = str(tmp_path / "svm")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert again.transform(test).select(p).exceptAll(model.transform(test).select(p)).count() == 0


def test_random_features_approach_the_kernel(spark):
    rows = vectors(spark, [(i, 0, float(i) / 3, float(i % 3)) for i in range(9)], 1)
    mapped = FourierFeatures(width=2, size=20_000, gamma=0.4).transform(rows).orderBy("customerID").collect()
    x, z = (np.array([r[c].toArray() for r in mapped]) for c in ("features", "fourier"))
    kernel = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=-1))
    np.testing.assert_allclose(z @ z.T, kernel, atol=0.04)
