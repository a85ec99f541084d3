import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.functions.distributions import chi2_tail, erfc, f_tail, normal_two_sided
from ebbline.operators import splitting as P
from ebbline.operators.ordered import exact_quantiles


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_quantiles_match_numpy_with_a_hot_value(spark, buckets):
    rng = random.Random(1)
    # A third of the rows share one value; some are missing.
    values = [7.25 if i % 3 == 0 else rng.gauss(0, 50) for i in range(3000)]
    rows = [(v, i % 2, None if i % 11 == 0 else v * 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, g int, b double")
    probabilities = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"], probabilities, buckets=buckets).collect()}
    by = {(r["column"], r["g"]): r for r in exact_quantiles(df, ["a", "b"], probabilities, "g", buckets).collect()}
    for name, i in (("a", 0), ("b", 2)):
        known = [r[i] for r in rows if r[i] is not None]
        for q, p in probabilities.items():
            assert got[name][q] == pytest.approx(np.quantile(known, p), abs=1e-12)
            for g in (0, 1):
                part = [r[i] for r in rows if r[i] is not None and r[1] == g]
                assert by[name, g][q] == pytest.approx(np.quantile(part, p), abs=1e-12)


def test_quantiles_of_an_all_null_column_are_absent(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    rows = exact_quantiles(df, ["a", "b"], {"m": 0.5}).collect()
    assert [(r["column"], r["m"]) for r in rows] == [("a", 1.5)]


def test_tails_match_known_values(spark):
    df = spark.range(1)

    def value(c):
        return df.select(c).first()[0]

    for x in (0.0, 0.2, 1.0, 2.49, 2.51, 4.0, 9.0):
        assert value(erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-10, abs=1e-300)
    assert value(normal_two_sided(F.lit(-1.959963984540054))) == pytest.approx(0.05, abs=1e-12)
    # Critical values from printed tables.
    for x, dof, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0)):
        assert value(chi2_tail(F.lit(x), F.lit(dof))) == pytest.approx(p, abs=1e-10)
    for f, a, b, p in ((4.964602743730711, 1.0, 10.0, 0.05), (3.0983912121407795, 3.0, 20.0, 0.05), (0.0, 2.0, 5.0, 1.0)):
        assert value(f_tail(F.lit(f), F.lit(a), F.lit(b))) == pytest.approx(p, abs=1e-9)
    assert value(f_tail(F.lit(1e9), F.lit(1.0), F.lit(1e6))) < 1e-12


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1003).select("id", (F.col("id") % 10 < 3).cast("int").alias("y")).cache()


def test_split_is_exact_disjoint_and_repeatable(rows):
    split = P.stratified_split(rows, "y", "id")
    counts = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    for y, n in {1: 303, 0: 700}.items():
        assert counts[y, "test"] == round(n * 0.2)
        assert counts[y, "train"] == n - round(n * 0.2)
    again = P.stratified_split(rows.repartition(5), "y", "id")
    assert sorted(split.collect()) == sorted(again.collect())
    other = P.stratified_split(rows, "y", "id", seed=7)
    assert sorted(split.collect()) != sorted(other.collect())


def test_split_adds_no_shuffle_to_the_table(rows):
    plan = P.stratified_split(rows, "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_differ_by_one_row_at_most(rows, k):
    sizes = {}
    for r in P.stratified_folds(rows, "y", "id", k).groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, {})[r.fold] = r["count"]
    for found in sizes.values():
        assert sorted(found) == list(range(k))
        assert max(found.values()) - min(found.values()) <= 1


def test_folds_of_tiny_classes(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(9)], "id long, y string")
    sizes = [r["count"] for r in P.stratified_folds(df, "y", "id", 5).where("y = 'a'").groupBy("fold").count().collect()]
    assert sizes == [1, 1]


def test_a_key_holding_a_third_of_the_rows_stays_together(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit(1).alias("y"))
    split = P.stratified_split(df, "y", "id", 0.5)
    assert split.where("id = -1").select("split").distinct().count() == 1
    tests = split.where("split = 'test'").count()
    assert 450 <= tests < 450 + 300


def test_string_keys_and_null_labels(spark):
    df = spark.createDataFrame([(f"k{i}", None if i == 0 else i % 2) for i in range(41)], "k string, y int")
    split = P.stratified_split(df, "y", "k", 0.25)
    tests = [r["count"] for r in split.where("split = 'test'").groupBy("y").count().collect()]
    assert tests == [5, 5]
    assert split.where("y is null").first().split == "train"


def test_borders_are_refined_bit_by_bit(spark, monkeypatch):
    """Buckets of a few bits, refined again and again, give the split of buckets that are ordered whole."""
    from pyspark.sql import functions as F

    # A third of all rows share one key, so one bucket stays large to the last bit.
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"), (F.col("id") % 5 == 0).cast("int").alias("y"))

    def both():
        split = P.stratified_split(rows, "y", "id", 0.25).select("id", "y", F.col("split").alias("part"))
        folds = P.stratified_folds(rows, "y", "id", 4).select("id", "y", F.col("fold").cast("string").alias("part"))
        return sorted(split.collect()), sorted(folds.collect())

    whole = both()
    monkeypatch.setattr(P, "HASH_BITS", 5)
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 2)
    assert both() == whole
    keys = spark.range(2000).withColumn("y", F.lit(1))
    tests = P.stratified_split(keys, "y", "id", 0.25).where("split = 'test'")
    assert tests.count() == 500
    first = keys.orderBy(P._hash("id", P.RANDOM_SEED), "id").limit(500)
    assert sorted(r.id for r in tests.collect()) == sorted(r.id for r in first.collect())


def test_sample_and_share(rows):
    assert P.sample_rows(rows, 100, "id").count() == 100
    assert P.sample_rows(rows, 5000, "id").count() == 1003
    assert sorted(P.sample_rows(rows, 50, "id").collect()) == sorted(P.sample_rows(rows.repartition(3), 50, "id").collect())
    ones = rows.withColumn("t", P.assign_share(rows, 0.37, "id")).agg(F.sum("t")).first()[0]
    assert ones == round(1003 * 0.37)
    share = P.hash_fraction_split(rows, "id").where("split = 'test'").count() / 1003
    assert 0.15 < share < 0.25


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_CLASSES", 1)
    monkeypatch.setattr(P, "HASH_BITS", 3)
    with pytest.raises(ValueError):
        P.stratified_split(spark.range(500).withColumn("y", F.col("id") % 50), "y", "id")
