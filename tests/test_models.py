import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbline.config import ROLES, ColumnRoles
from ebbline.operators import attribute as A
from ebbline.operators import encode as N
from ebbline.operators import models as M
from ebbline.operators import score as S
from ebbline.plans import workflows as W
from ebbline.sources import readers, writers

TINY = ColumnRoles(categorical=("Contract", "Partner"), numeric=("tenure", "TotalCharges"))


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [
        (1, "One year", "Yes", 2, "10.0", "Yes"), (2, "Two year", None, 4, " ", "No"),
        (3, "One year", "No", None, "30.5", "No"), (4, "One year", "No", 10, "20.0", "Yes"),
    ]
    return spark.createDataFrame(rows, "customerID long, Contract string, Partner string, tenure int, TotalCharges string, Churn string")


def vectors(df):
    return {r.customerID: [float(v) for v in r.v] for r in df.select("customerID", vector_to_array("features").alias("v")).collect()}


def test_encoder_fills_scales_and_names(tiny):
    encoder = N.fit_encoder(tiny, TINY)
    names = N.feature_names(encoder, TINY)
    assert names == ["tenure", "TotalCharges", "Contract_One year", "Contract_Two year", "Partner_No", "Partner_Yes", "Partner_missing"]
    got = vectors(N.encode(encoder, tiny, TINY))
    # tenure: median 4 fills the gap; mean 5, population deviation 3.
    assert [got[i][0] for i in (1, 2, 3, 4)] == pytest.approx([-1.0, -1 / 3, -1 / 3, 5 / 3])
    assert got[2][2:] == [0.0, 1.0, 0.0, 0.0, 1.0]
    assert [N.source_column(n, TINY) for n in ("tenure", "Contract_Two year")] == ["tenure", "Contract"]


def test_unknown_levels_are_all_zeros_and_constants_scale_by_one(spark, tiny):
    encoder = N.fit_encoder(tiny.withColumn("tenure", F.lit(7)), TINY)
    new = spark.createDataFrame([(9, "Three year", "Yes", 8, "x")], "customerID long, Contract string, Partner string, tenure int, TotalCharges string")
    got = vectors(N.encode(encoder, new, TINY))[9]
    assert got[0] == 1.0 and got[2:4] == [0.0, 0.0]


def test_too_many_levels_are_refused(spark):
    wide = spark.range(5000).select(F.col("id").alias("customerID"), F.col("id").cast("string").alias("Contract"), F.lit("a").alias("Partner"), F.lit(1).alias("tenure"), F.lit("1").alias("TotalCharges"))
    with pytest.raises(ValueError):
        N.fit_encoder(wide, TINY)


def test_wide_levels_give_the_same_vectors(spark, tiny, tmp_path):
    listed = N.fit_encoder(tiny, TINY)
    joined = N.fit_encoder(tiny, TINY, wide=True, max_levels=1)
    joined.write().overwrite().save(str(tmp_path / "encoder"))
    loaded = PipelineModel.load(str(tmp_path / "encoder"))
    unknown = tiny.withColumn("Contract", F.when(F.col("customerID") == 1, "Three year").otherwise(F.col("Contract")))
    for rows in (tiny, unknown, tiny.limit(0)):
        for encoder in (joined, loaded):
            assert vectors(N.encode(encoder, rows, TINY)) == vectors(N.encode(listed, rows, TINY))
    table = N.feature_table(joined, spark, TINY).orderBy("position").collect()
    assert [r.feature for r in table] == N.feature_names(listed, TINY)
    with pytest.raises(ValueError):
        N.feature_names(joined, TINY)
    entries = {(r.customerID, r.position): r.value for r in N.nonzero_features(N.encode(joined, tiny, TINY)).collect()}
    dense = vectors(N.encode(listed, tiny, TINY))
    assert entries == {(k, i): x for k, v in dense.items() for i, x in enumerate(v) if x}


def test_a_hundred_thousand_levels(spark):
    # A third of all rows share one level.
    level = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("L%06d", F.col("id") * 7919 % 200_003))
    rows = spark.range(150_000).select(F.col("id").alias("customerID"), level.alias("Contract"), F.lit("a").alias("Partner"), F.lit(1).alias("tenure"), F.lit("1").alias("TotalCharges"))
    encoder = N.fit_encoder(rows, TINY, wide=True)
    names = N.feature_table(encoder, spark, TINY).where("feature LIKE 'Contract_%'")
    assert names.count() == 100_001
    by_name = names.orderBy(F.col("feature").cast("binary")).collect()
    assert [r.position for r in by_name] == list(range(2, 100_003))
    entries = N.nonzero_features(N.encode(encoder, rows, TINY)).where("position BETWEEN 2 AND 100002")
    found = entries.join(names, "position").join(rows, "customerID")
    assert found.count() == 150_000
    assert found.where("feature != concat('Contract_', Contract) OR value != 1").isEmpty()


def test_prepare_splits_before_fitting(base, prepared):
    sizes = {r.split: r["count"] for r in prepared.table.groupBy("split").count().collect()}
    assert sum(sizes.values()) == base.count()
    assert sizes["test"] == pytest.approx(base.count() * 0.2, abs=1)
    mean = prepared.train.select(F.avg(vector_to_array("features")[0])).first()[0]
    assert mean == pytest.approx(0, abs=1e-9)
    assert len(prepared.names) == len(vectors(prepared.test).popitem()[1])


def test_vector_anova_equals_column_anova(prepared):
    from ebbline.operators.effects import anova

    scores = {r.feature: r.score for r in N.anova_of_vector(prepared.train, prepared.names).collect()}
    columns = prepared.train.select("label", *[vector_to_array("features")[i].alias(f"f{i}") for i in range(3)])
    direct = {r.feature: r.score for r in anova(columns, ["f0", "f1", "f2"], "label").collect()}
    for i in range(3):
        assert scores[prepared.names[i]] == pytest.approx(direct[f"f{i}"], rel=1e-6)
    _, kept, _ = N.select_features(prepared.train, prepared.names, 5)
    assert len(kept) == 5


def test_catalog_of_models_and_grids():
    assert M.get_model("nothing") is None
    for name in ("RandomForest", "LogisticRegression", "SVM", "XGBoost", "LightGBM"):
        assert M.get_model(name) is not None
    sizes = {n: len(M.get_grid(n)) for n in ("RandomForest", "XGBoost", "LightGBM", "LogisticRegression", "SVM")}
    assert sizes == {"RandomForest": 24, "XGBoost": 36, "LightGBM": 54, "LogisticRegression": 12, "SVM": 1}
    assert len(M.get_grid("XGBoost", 5)) == 5


def test_models_find_a_planted_signal(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [(i, i % 2, float(i % 2) + (i * 37 % 100) / 80.0, float(i * 13 % 7)) for i in range(400)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "customerID long, label int, a double, b double")
    ).coalesce(1).cache()
    options = {"RandomForest": {"numTrees": 5}, "SVM": {}, "XGBoost": {"maxIter": 3}, "LightGBM": {"maxIter": 3}}
    for name, overrides in options.items():
        trained = M.train_model(name, df, df, budget=1, overrides=overrides)
        assert trained.roc_auc > 0.85, name
        assert trained.test_accuracy == trained.train_accuracy
    tuned = M.train_model("LogisticRegression", df, df, budget=2, folds=2)
    assert tuned.cv_auc > 0.85 and "elasticNetParam" in tuned.params
    ranking = {r.feature: r for r in M.eliminate_features(df, ["a", "b"], keep=1, trees=3, depth=3).collect()}
    assert ranking["a"].ranking == 1 and ranking["a"].support and ranking["b"].ranking == 2
    importance = M.forest_importance(df, ["a", "b"], trees=3, depth=3)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert importance.first().feature == "a"
    steps = M.cumulative_importance(importance).collect()
    assert steps[-1].cumulative_importance == pytest.approx(1, abs=1e-3)


def test_one_failing_algorithm_does_not_stop_the_others(prepared):
    got = M.train_all(prepared.train, prepared.test, ["Unknown", "RandomForest"], budget=1, overrides={"numTrees": 2, "maxDepth": 2})
    assert list(got) == ["RandomForest"]
    assert M.best_trained(got).name == "RandomForest"
    table = M.compare_models(got, prepared.test)
    assert table.columns == ["Model", "Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC", "Best Parameters"]
    assert table.first()["ROC-AUC"] == pytest.approx(got["RandomForest"].roc_auc)


def test_equal_scores_keep_the_first_model():
    a, b = (M.TrainedModel(n, None, roc_auc=0.7) for n in "ab")
    assert M.best_trained({"a": a, "b": b}).name == "a"


def test_sampled_attribution_adds_up(prepared, forest):
    found = A.sampled_attribution(prepared.test, forest.model, prepared.names, permutations=3)
    sums = found.groupBy("customerID").agg(F.sum("phi").alias("s"), F.max("base").alias("b"), F.count("*").alias("n"))
    scored = M.scored_by(forest.model, prepared.test, "m")
    rows = sums.join(scored, "customerID").collect()
    assert len(rows) == prepared.test.count()
    for r in rows:
        assert r.n == len(prepared.names)
        assert r.s == pytest.approx(r.probability - r.b, abs=1e-9)
    some = A.sampled_attribution(prepared.test, forest.model, prepared.names, sample_size=4, permutations=2)
    assert some.select("customerID").distinct().count() == 4


def test_linear_attribution_views(prepared, logistic):
    found = A.linear_attribution(prepared.test, logistic.model, prepared.names).cache()
    raw = logistic.model.transform(prepared.test).select("customerID", vector_to_array("rawPrediction")[1].alias("margin"))
    steps = A.waterfall(found, max_display=4)
    ends = {r.customerID: r for r in steps.where("place = 4").collect()}
    for r in raw.collect():
        assert ends[r.customerID].end == pytest.approx(r.margin, abs=1e-9)
        assert ends[r.customerID].feature.endswith("other features")
    importance = A.attribution_importance(found)
    totals = A.attribution_totals(importance).first()
    assert totals.total_impact == pytest.approx(totals.average_impact * len(prepared.names))
    top = A.local_contributions(found, top=3).collect()
    assert len(top) == 3 * prepared.test.count()
    assert all((r.phi > 0) == (r.direction == "Increases Churn Risk") for r in top)
    assert A.beeswarm(found, 2).select("feature").distinct().count() == 2
    one = A.dependence(found, "tenure", "MonthlyCharges").first()
    assert one.value is not None and one.interaction_value is not None


def test_scoring_takes_raw_and_clean_rows(base, cleaned, prepared, forest):
    pipeline = S.scoring_pipeline(prepared.encoder, forest.model)
    raw = {r.customerID: r for r in S.score_batch(pipeline, base).collect()}
    for r in S.score_batch(pipeline, cleaned).collect():
        assert raw[r.customerID].Churn_Probability == r.Churn_Probability
        assert r.Prediction_Confidence == pytest.approx(abs(r.Churn_Probability - 0.5) * 2)
        assert r.Churn_Prediction == int(r.Churn_Probability > 0.5)
    assert {r.risk_level for r in S.score_customers(pipeline, base).collect()} <= {"low", "medium", "high"}
    explained = S.explain_scores(pipeline, base, ["tenure", "Contract"]).first()
    assert len(explained.recommendations) == 3


def test_upload_with_bad_rows_and_absent_columns(spark, prepared, forest):
    pipeline = S.scoring_pipeline(prepared.encoder, forest.model)
    columns = "customerID long, tenure string, MonthlyCharges string, Contract string, PaymentMethod string"
    upload = spark.createDataFrame([(1, "12", "70.5", "One year", "BUILDING"), (2, "twelve", "x", "One year", None)], columns)
    good, bad = sorted(S.score_upload(pipeline, upload).collect(), key=lambda r: r.customerID)
    assert good.error is None and 0 <= good.churn_probability <= 1 and good.prediction in ("Yes", "No")
    assert bad.churn_probability is None and bad.error == "not a number: tenure, MonthlyCharges"
    with pytest.raises(readers.MissingColumns) as refused:
        S.score_upload(pipeline, upload.drop("tenure", "Contract"))
    assert refused.value.missing == ["Contract", "tenure"]


def test_upload_without_a_key_is_numbered_in_order(spark, prepared, forest):
    rows = [(str(i % 70), "70.5" if i % 7 else "x", "One year", "BUILDING") for i in range(100)]
    upload = spark.createDataFrame(rows, "tenure string, MonthlyCharges string, Contract string, PaymentMethod string").repartition(5).sortWithinPartitions("tenure")
    order = [(r.tenure, r.MonthlyCharges) for r in S.numbered(upload).orderBy("row_number").collect()]
    assert order == [(r.tenure, r.MonthlyCharges) for r in upload.collect()]
    scored = S.score_upload(S.scoring_pipeline(prepared.encoder, forest.model), upload).orderBy("customerID").collect()
    assert [r.customerID for r in scored] == list(range(1, 101))
    assert [r.error is not None for r in scored] == [charge == "x" for _, charge in order]
    assert S.numbered(upload.limit(0)).count() == 0


def test_interaction_of_a_planted_product_is_found(spark):
    """phi of `a` holds a * c; b and d have no part in it."""
    cells = []
    for i in range(4_000):  # chance explains about 100 pairs of bins / 4,000 rows
        a, b, c, d = (i * 37 % 100) / 100, (i * 53 % 97) / 97, (i * 71 % 89) / 89, 1.0
        cells += [(i, "a", a, 2 * a + a * c), (i, "b", b, b), (i, "c", c, 0.1), (i, "d", d, 0.0)]
    rows = spark.createDataFrame(cells, "customerID long, feature string, value double, phi double")
    ranking = {r.feature: r.explained for r in A.interaction_ranking(rows, "a").collect()}
    assert ranking["c"] > 3 * ranking["b"] and ranking["d"] == pytest.approx(0, abs=1e-12)
    chosen = A.dependence(rows, "a", "auto").collect()
    assert len(chosen) == 4_000 and {r.interaction_feature for r in chosen} == {"c"}


def test_training_run_writes_everything(spark, base, tmp_path):
    paths = W.run_training(base, str(tmp_path / "run"), ["RandomForest"], budget=1, overrides={"numTrees": 3, "maxDepth": 2}, explain_rows=5)
    assert {"model_comparison", "attribution_importance", "treatment_effects", "model", "prepared"} <= set(paths)
    assert spark.read.parquet(paths["prepared"]).groupBy("split").count().count() == 2
    assert spark.read.json(paths["metadata"]).first().model == "RandomForest"
    scored = W.run_batch_scoring(spark, paths["model"], base, str(tmp_path / "scored"))
    assert scored.count() == base.count()
    assert scored.columns[-3:] == ["Churn_Prediction", "Churn_Probability", "Prediction_Confidence"]


def test_csv_round_trip_keeps_blanks(spark, base, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_table(base, path, "csv")
    back = readers.read_customers(spark, path)
    assert back.where("TotalCharges = ' '").count() == base.where("TotalCharges = ' '").count() > 0
    assert back.count() == base.count()
    empty = readers.read_or_empty(spark, str(tmp_path / "absent"), base.schema)
    assert empty.count() == 0 and empty.columns == base.columns


def test_weights_and_roles():
    assert len(ROLES.categorical) == 16 and len(ROLES.features) == 19


def test_catalog_fits_with_the_operators_defaults(monkeypatch):
    from types import SimpleNamespace

    from ebbline.plans.catalog import modelling as B
    from ebbline.plans.catalog import registry

    calls = []
    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none"))
    monkeypatch.setattr(registry, "rounded", lambda result: result)
    monkeypatch.setattr(B, "_kept", {})
    monkeypatch.setattr(B, "_prepared", lambda t: SimpleNamespace(train="train", test="test", names=["a"]))
    monkeypatch.setattr(B, "_summary", lambda t, trained: trained)
    monkeypatch.setattr(M, "train_model", lambda *args, **options: calls.append((args[0], options)) or M.TrainedModel(args[0], None, roc_auc=0.5))
    monkeypatch.setattr(M, "eliminate_features", lambda *args, **options: calls.append(("eliminate", options)))
    monkeypatch.setattr(M, "compare_models", lambda trained, test: list(trained))
    for name in ("m07_recursive_elimination", "m09_random_forest", "m10_logistic_regression", "m12_gradient_boosting", "m13_gradient_boosting_leafwise"):
        registry.QUERIES[name](session, "none")
    names = ["eliminate", "RandomForest", "LogisticRegression", "GradientBoosting", "GradientBoostingLeafwise"]
    assert calls == [(name, {}) for name in names]
    assert registry.QUERIES["m16c_comparison_of_default_algorithms"](session, "none") == list(M.DEFAULT_ALGORITHMS)
    assert len(calls) == 5
