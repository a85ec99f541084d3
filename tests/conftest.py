import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ebbline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def base(spark):
    from ebbline.plans.fixtures import churn_base

    return churn_base(spark, SMALL).cache()


@pytest.fixture(scope="session")
def cleaned(base):
    from ebbline.operators.clean import clean

    return clean(base).cache()


@pytest.fixture(scope="session")
def planted(spark):
    """20,000 rows with a true treatment effect of 0.15 and one confounder."""
    from pyspark.sql import functions as F

    u = spark.range(20_000).select(
        "id",
        (F.col("id") * 7919 % 10007 / 10007).alias("u1"),
        (F.col("id") * 104729 % 10009 / 10009).alias("u2"),
        (F.col("id") * 1299709 % 10037 / 10037).alias("u3"),
    )
    c = u.withColumn("c", F.when(F.col("u1") < 0.5, 1).otherwise(0))
    t = c.withColumn("t", F.when(F.col("u2") < 0.2 + 0.5 * F.col("c"), 1).otherwise(0))
    chance = 0.2 + 0.15 * F.col("t") + 0.3 * F.col("c")
    return t.select("id", "c", "t", F.when(F.col("u3") < chance, 1).otherwise(0).alias("y")).cache()


@pytest.fixture(scope="session")
def prepared(base):
    from ebbline.plans.workflows import prepare

    return prepare(base)


@pytest.fixture(scope="session")
def forest(prepared):
    from ebbline.operators.models import train_model

    small = {"numTrees": 5, "maxDepth": 3}
    return train_model("RandomForest", prepared.train, prepared.test, budget=1, overrides=small)


@pytest.fixture(scope="session")
def logistic(prepared):
    from ebbline.operators.models import train_model

    return train_model("LogisticRegression", prepared.train, prepared.test, budget=1)
