"""Boosted trees and tree attributions against hand-made and brute-force versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbline.operators import histogram_trees as B
from ebbline.operators import models as M
from ebbline.operators import tree_paths as T


def vectors(spark, rows, parts=3):
    """rows: (key, label, a, b, ...) as an encoded table."""
    names = [f"x{i}" for i in range(len(rows[0]) - 2)]
    schema = "customerID long, label int, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("customerID", "label", "features").cache()


@pytest.fixture(scope="module")
def wavy(spark):
    """Label depends on two features together."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 21, size=(600, 4)) / 20
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)) | (rng.uniform(size=600) < 0.05)
    return vectors(spark, [(i, int(y[i]), *map(float, x[i])) for i in range(600)])


def log_loss(df, model):
    p = vector_to_array("probability")[1]
    loss = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return model.transform(df).agg(F.avg(loss)).first()[0]


def test_first_tree_by_hand(spark):
    # Base share 1/2: gradient -0.5 or 0.5, Hessian 0.25 a row.
    df = vectors(spark, [(1, 0, 1.0), (2, 0, 2.0), (3, 0, 3.0), (4, 1, 4.0), (5, 1, 5.0), (6, 1, 6.0)])
    model = B.BoostedTrees(maxIter=1, maxDepth=1, stepSize=0.5, minWeight=0.0).fit(df)
    base, width, trees = model.ensemble["base"], model.ensemble["features"], model.ensemble["trees"]
    assert (base, width, len(trees)) == (0.0, 1, 1)
    root, left, right = trees[0]
    assert root[:3] == [0, 3.5, 1] and root[5] == 6 * 0.25
    # Sums of three rows: G = 1.5, H = 0.75; value -0.5 * G / (H + 1).
    assert left[3] == pytest.approx(-0.5 * 1.5 / 1.75) and right[3] == pytest.approx(0.5 * 1.5 / 1.75)
    assert root[4] == pytest.approx(2 * 1.5**2 / 1.75)
    scored = {r.customerID: r for r in model.transform(df).collect()}
    assert scored[6].probability[1] == pytest.approx(1 / (1 + math.exp(-0.5 * 1.5 / 1.75))) and scored[6].prediction == 1.0


def test_training_loss_falls_every_round(wavy):
    model = B.BoostedTrees(maxIter=12, maxDepth=3, stepSize=0.3).fit(wavy)
    base, width, trees = model.ensemble["base"], model.ensemble["features"], model.ensemble["trees"]
    losses = [log_loss(wavy, B.BoostedTrees().model(base, width, trees[:n], False)) for n in (0, 1, 2, 4, 8, 12)]
    assert all(a > b for a, b in zip(losses, losses[1:]))
    assert losses[-1] < 0.35
    assert sum(model.featureImportances[:2]) > 0.9


def test_fits_do_not_depend_on_partitions(wavy):
    fits = [B.BoostedTrees(maxIter=6, maxDepth=4, subsamplingRate=0.7, featureShare=0.5).fit(wavy.repartition(n)).ensemble for n in (1, 7)]
    assert fits[0] == fits[1]


def test_leaf_budget_is_reached_best_first(wavy):
    whole = B.BoostedTrees(maxIter=1, maxDepth=5, minWeight=0.0, minInstancesPerNode=5).fit(wavy).ensemble["trees"][0]
    some = B.BoostedTrees(maxIter=1, maxDepth=5, minWeight=0.0, minInstancesPerNode=5, numLeaves=7).fit(wavy).ensemble["trees"][0]
    assert sum(n[2] < 0 for n in some) == 7 < sum(n[2] < 0 for n in whole)
    # By hand over the whole tree: split the open leaf of largest gain until there are seven.
    open_, gains = [0], []
    while len(gains) < 6:
        best = max((n for n in open_ if whole[n][2] >= 0), key=lambda n: whole[n][4])
        open_.remove(best)
        open_ += [whole[best][2], whole[best][2] + 1]
        gains.append(whole[best][4])
    assert sorted(n[4] for n in some if n[2] >= 0) == pytest.approx(sorted(gains))
    assert all(n[5] >= 5 * 0.2 for n in some)  # Hessians of five rows and more


def test_shared_search_equals_separate_fits(spark, wavy):
    from ebbline.operators.evaluate import roc_auc
    from ebbline.operators.splitting import stratified_folds

    parts = stratified_folds(wavy, "label", "customerID", 3, 42).cache()
    points = [{"maxIter": r, "maxDepth": d, "stepSize": 0.2, "subsamplingRate": 0.8} for r in (3, 6) for d in (2, 3)]
    best, areas, model = B.BoostedTrees().search(parts, points, 3)
    for point, own in zip(points, areas):
        for fold in range(3):
            alone = B.BoostedTrees(**point).fit(parts.where(F.col("fold") != fold))
            scored = M.scored_by(alone, parts.where(F.col("fold") == fold), "m")
            assert own[fold] == pytest.approx(roc_auc(scored, "model").first()["roc_auc"], abs=1e-9)
    means = [sum(a) for a in areas]
    assert means[best] == max(means)
    assert model.ensemble == B.BoostedTrees(**points[best]).fit(wavy).ensemble


def test_forest_points_share_a_fit(spark, wavy):
    from ebbline.operators.evaluate import roc_auc
    from ebbline.operators.splitting import stratified_folds

    parts = stratified_folds(wavy, "label", "customerID", 2, 42).cache()
    points = [{"numTrees": n, "maxDepth": d, "minInstancesPerSplit": s} for n in (3, 5) for d in (2, 4, 0) for s in (2, 20)]
    best, areas, model = B.Forest().search(parts, points, 2)
    for point, own in list(zip(points, areas))[::3]:
        alone = B.Forest(**point).fit(parts.where("fold != 1"))
        scored = M.scored_by(alone, parts.where("fold = 1"), "m")
        assert own[1] == pytest.approx(roc_auc(scored, "model").first()["roc_auc"], abs=1e-9)
    assert model.ensemble == B.Forest(**points[best]).fit(wavy).ensemble
    assert sum(areas[-2]) / 2 > 0.75


def test_forest_leaves_hold_shares(spark, wavy):
    model = B.Forest(numTrees=3, maxDepth=4, minInstancesPerNode=7, minInstancesPerSplit=40).fit(wavy)
    for tree in model.ensemble["trees"]:
        for feature, threshold, first, value, gain, rows in tree:
            assert 0 <= value <= 1 and rows >= 7
            if first >= 0:
                assert rows >= 40 and tree[first][5] + tree[first + 1][5] == rows
        # About 63 of 100 rows are drawn at least once.
        assert 0.55 * 600 < tree[0][5] < 0.72 * 600
    assert sum(model.featureImportances) == pytest.approx(1)


@pytest.mark.parametrize("kind", ["boosted", "leafwise", "forest"])
def test_fits_over_many_blocks_equal_those_over_one(spark, wavy, kind, monkeypatch):
    """More rows than a block: all fits grow level by level in shared passes, with the same trees and scores."""
    from ebbline.operators.splitting import stratified_folds

    parts = stratified_folds(wavy, "label", "customerID", 2, 42).cache()
    points = {
        "boosted": [{"maxIter": r, "maxDepth": d, "subsamplingRate": 0.8} for r in (2, 4) for d in (1, 3)],
        "leafwise": [{"maxIter": 3, "maxDepth": 4, "numLeaves": n, "minInstancesPerNode": 20, "featureShare": 0.8} for n in (3, 6)],
        "forest": [{"numTrees": n, "maxDepth": d} for n in (2, 5) for d in (2, 0)],
    }[kind]
    estimator = B.Forest() if kind == "forest" else B.BoostedTrees()
    one = estimator.search(parts, points, 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    monkeypatch.setattr(B, "TREES_AT_ONCE", 12)
    many = estimator.search(parts, points, 2)
    assert one[0] == many[0]
    np.testing.assert_allclose(one[1], many[1], atol=1e-12)
    assert one[2].ensemble == many[2].ensemble


def test_boosted_model_is_saved(spark, wavy, tmp_path):
    from pyspark.ml import PipelineModel

    model = B.BoostedTrees(maxIter=2, maxDepth=2).fit(wavy)
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.stages[0].ensemble == model.ensemble
    assert back.transform(wavy).select("probability").exceptAll(model.transform(wavy).select("probability")).count() == 0


def test_rows_of_one_class_and_constant_features(spark):
    one = vectors(spark, [(i, 1, 1.0, float(i)) for i in range(20)])
    model = B.BoostedTrees(maxIter=2).fit(one)
    assert model.transform(one).where("prediction = 1").count() == 20
    flat = vectors(spark, [(i, i % 2, 1.0) for i in range(20)])
    assert all(len(t) == 1 for t in B.BoostedTrees(maxIter=2).fit(flat).ensemble["trees"])


def subset_values(nodes, rows, x, known):
    """Prediction with the features of `known` taken from x, the others averaged by background rows."""

    def at(node):
        if nodes.left[node] < 0:
            return nodes.value[node]
        left, right = int(nodes.left[node]), int(nodes.right[node])
        if nodes.feature[node] in known:
            own = node in nodes.categories
            goes = x[nodes.feature[node]] in nodes.categories[node] if own else x[nodes.feature[node]] <= nodes.threshold[node]
            return at(left if goes else right)
        counts = rows if rows[node] else nodes.rows
        return (counts[left] * at(left) + counts[right] * at(right)) / counts[node]

    return nodes.base + sum(at(int(r)) for r in nodes.roots)


def brute_shapley(nodes, rows, x):
    m = len(x)
    phi = np.zeros(m)
    for j in range(m):
        others = [i for i in range(m) if i != j]
        for k in range(m):
            for s in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[j] += weight * (subset_values(nodes, rows, x, {*s, j}) - subset_values(nodes, rows, x, set(s)))
    return phi


@pytest.mark.parametrize("kind", ["forest", "spark_forest", "tree", "boosted", "gbt"])
def test_contributions_equal_subset_enumeration(spark, wavy, kind):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier

    estimators = {
        "forest": B.Forest(numTrees=4, maxDepth=6), "spark_forest": RandomForestClassifier(numTrees=4, maxDepth=5, seed=3), "tree": DecisionTreeClassifier(maxDepth=6),
        "boosted": B.BoostedTrees(maxIter=5, maxDepth=4), "gbt": GBTClassifier(maxIter=3, maxDepth=3, seed=1),
    }
    model = estimators[kind].fit(wavy)
    background, explained = wavy.where("customerID < 250"), wavy.where("customerID % 60 = 7")
    nodes = T.nodes_of(model)
    rows = T.background_rows(background, nodes)
    found = {}
    for r in T.tree_attribution(explained, model, ["a", "b", "c", "d"], background).collect():
        found.setdefault(r.customerID, {})[r.feature] = (r.value, r.phi, r.base)
    assert len(found) == 10

    def prediction(df):
        scored = model.transform(df)
        if kind in ("forest", "spark_forest", "tree"):
            return scored.select("customerID", "features", vector_to_array("probability")[1].alias("p"))
        return scored.select("customerID", "features", vector_to_array("rawPrediction")[1].alias("p"))

    base = prediction(background).agg(F.avg("p")).first()[0]
    for r in prediction(explained).collect():
        own = found[r.customerID]
        phi = np.array([own[c][1] for c in "abcd"])
        np.testing.assert_allclose(phi, brute_shapley(nodes, rows, r.features.toArray()), atol=1e-12)
        assert [own[c][0] for c in "abcd"] == list(r.features)
        assert own["a"][2] == pytest.approx(base, abs=1e-12)
        assert phi.sum() + base == pytest.approx(r.p, abs=1e-9)


def test_categories_of_splits_and_nodes_without_background(spark, prepared, forest):
    """One-hot features are split as categories; a background of few rows leaves nodes empty."""
    for background in (prepared.train, prepared.train.limit(3)):
        rows = T.tree_attribution(prepared.test, forest.model, prepared.names, background)
        sums = rows.groupBy("customerID").agg(F.sum("phi").alias("s"), F.max("base").alias("b"), F.count("*").alias("n"))
        for r in sums.join(M.scored_by(forest.model, prepared.test, "m"), "customerID").collect():
            assert r.n == len(prepared.names) and r.s + r.b == pytest.approx(r.probability, abs=1e-9)


def test_levels_send_splits_to_the_driver_not_histograms(spark, monkeypatch):
    """Over many blocks a level costs the driver one split a node, whatever the bins."""
    import pickle

    from pyspark import RDD

    rng = np.random.default_rng(2)
    x = rng.uniform(size=(900, 6))
    y = (x[:, 0] + rng.uniform(size=900) > 1).astype(int)
    rows = vectors(spark, [(i, int(y[i]), *map(float, x[i])) for i in range(900)], 6)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: [sent.append(len(pickle.dumps(found := collect(rdd)))), found][1])
    model = B.Forest(numTrees=8, maxDepth=5, seed=3).fit(rows)
    assert sum(len(t) for t in model.ensemble["trees"]) > 200
    # 6 features of 64 bins are 9 kB of sums a node.
    assert sent and max(sent) < 60_000


@pytest.mark.parametrize("most", [4, 256])
def test_levels_of_a_column_are_counted_together(most, monkeypatch):
    """Features that exclude each other share a column of codes, and its sums are those of every feature by itself."""
    monkeypatch.setattr(B, "JOINT_CODES", most)
    rng = np.random.default_rng(5)
    n = 500
    level, other, number = rng.integers(0, 20, n), rng.integers(0, 2, n), rng.integers(0, 30, n)
    bins = np.concatenate(([number], level == np.arange(20)[:, None], [other, 1 - other])).astype(np.uint8)
    layout = B.Layout([[float(i) for i in range(29)], *[[0.5]] * 22])
    joint = B.joint_codes(bins, layout.sizes)
    assert sorted(f for j in joint for f in j.features) == list(range(23))
    assert all(len(j.bins) <= max(most, layout.sizes[j.features[0]]) for j in joint)
    if most == 256:
        # 23 features, but a row is counted in two columns.
        assert len(joint) == 2
    for j in joint:
        assert (j.bins[j.codes].T == bins[j.features]).all()
    rows = np.sort(rng.choice(n, 400, replace=False))
    drawn = B.Drawn(rows, rng.integers(-1000, 1000, (3, 400)).astype(float), rng.integers(0, 3, 400))
    columns = np.array([0, 2, 3, 7, 20, 22])
    slot = np.where(drawn.node == 1, -1, drawn.node // 2)
    found = B.shared_histograms(joint, drawn, slot, 2, columns, layout)
    allowed = np.zeros((2, 23), bool)
    allowed[:, columns] = True
    kept = slot >= 0
    alone = B.chosen_histograms(bins, B.Drawn(rows[kept], drawn.values[:, kept], slot[kept]), slot[kept], B.choice_of(allowed, layout))
    assert (found.reshape(3, -1) == alone).all()


def test_few_blocks_are_dealt(wavy, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)
    monkeypatch.setattr(B, "_side_by_side", None)
    assert len(B.Forest(numTrees=3, maxDepth=3).fit(wavy).ensemble["trees"]) == 3


def test_trees_are_packed_and_older_models_are_read(wavy):
    import json

    model = B.Forest(numTrees=3).fit(wavy)
    held = model.ensemble
    for packed, tree in zip(model.held["trees"], held["trees"]):
        assert isinstance(packed, bytes) and len(packed) < 16 * len(tree) + 200
        assert B.unpacked_tree(packed).tolist() == tree
    older = B.TreesModel(trees=json.dumps(held))
    assert older.ensemble == held and list(older.featureImportances) == list(model.featureImportances)


def test_leaf_budgets_beyond_the_depth_share_a_fit(spark, wavy, monkeypatch):
    from ebbline.operators.splitting import stratified_folds

    parts = stratified_folds(wavy, "label", "customerID", 2, 42).cache()
    fits, fit = [], B.BinnedTable.fit
    monkeypatch.setattr(B.BinnedTable, "fit", lambda self, own, *a: fits.extend(own) or fit(self, own, *a))
    points = [{"maxIter": 2, "maxDepth": 3, "numLeaves": n} for n in (5, 8, 31)]
    _, areas, _ = B.BoostedTrees().search(parts, points, 2)
    assert len(fits) == 2 * 3 and areas[1] == areas[2]


@pytest.mark.parametrize("longest", [2, 10])
def test_tabled_paths_equal_paths_one_by_one(spark, wavy, longest, monkeypatch):
    monkeypatch.setattr(T, "TABLE_FEATURES", longest)
    model = B.Forest(numTrees=4, maxDepth=6).fit(wavy)
    one = {(r.customerID, r.feature): r.phi for r in T.tree_attribution(wavy.coalesce(1), model, list("abcd"), wavy).collect()}
    monkeypatch.setattr(T, "TABLE_ROWS", 1)
    monkeypatch.setattr(T, "TABLE_CELLS", 64)
    monkeypatch.setattr(T, "PATTERN_CELLS", 1)
    nodes = T.nodes_of(model)
    counts = T.background_rows(wavy, nodes)
    rows = wavy.select("customerID", vector_to_array("features").alias("x")).collect()
    x = np.array([r.x for r in rows])
    paths, _ = T.leaf_paths(nodes, counts)
    found = T.tabled_contributions(x, nodes, T.tabled_paths(nodes, counts))
    found = found + T.contributions(x, nodes, {m: p for m, p in paths.items() if m > longest})
    expected = [[one[r.customerID, c] for c in "abcd"] for r in rows]
    np.testing.assert_allclose(found, expected, atol=1e-12)


def test_paths_of_a_subtree_are_looked_up_together(wavy):
    """Repeated features, features new below the node, and trees that are one subtree as a whole."""
    for depth in (2, 3, 8):
        nodes = T.nodes_of(B.Forest(numTrees=2, maxDepth=depth).fit(wavy))
        counts = T.background_rows(wavy, nodes)
        trees = T.tabled_paths(nodes, counts)
        paths = sum(len(s.paths) for t in trees for s in t.subtrees)
        assert paths == sum(len(p.leaf) for p in T.leaf_paths(nodes, counts)[0].values())
        assert 2 * sum(len(t.subtrees) for t in trees) <= paths
        assert all(s.bits + len(s.nodes) <= T.TABLE_BITS for t in trees for s in t.subtrees)
        x = np.random.default_rng(depth).normal(size=(300, 4))
        found, expected = T.tabled_contributions(x, nodes, trees), T.contributions(x, nodes, T.leaf_paths(nodes, counts)[0])
        np.testing.assert_allclose(found, expected, atol=1e-12)


def test_rows_are_gathered_before_they_are_explained(spark, wavy):
    """Small batches and many small partitions would leave too few rows for tables."""
    import pyarrow as pa

    batches = [pa.record_batch({"k": list(range(10 * i, 10 * i + n))}) for i, n in enumerate([10, 0, 10, 10, 10, 3])]
    found = list(T.gathered(batches, 20))
    assert [b.num_rows for b in found] == [20, 20, 3] and found[0]["k"].to_pylist() == [*range(10), *range(20, 30)]
    model = B.Forest(numTrees=2, maxDepth=3).fit(wavy)
    explained = T.tree_attribution(wavy.repartition(40), model, list("abcd"), wavy)
    assert explained.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert explained.count() == 4 * wavy.count()


def test_fits_side_by_side_share_the_cores(spark, wavy, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert M.fit_tasks(10_000 * M.TASK_ROWS, spark, 1) == cores
    assert M.fit_tasks(20 * M.TASK_ROWS, spark, cores) == 1 and M.fit_tasks(5, spark, cores) == 1
    rows = M.SHARED_TASK_CELLS // 256
    assert M.fit_tasks(2 * rows, spark, cores, 256) == min(2, cores) and M.fit_tasks((cores + 5) * rows, spark, cores, 256) == cores
    monkeypatch.setattr(M, "TASK_ROWS", 10)
    used, configured = [], M._configured

    class Counted:
        def __init__(self, *settings):
            self.own = configured(*settings)

        def fit(self, rows):
            used.append(rows.rdd.getNumPartitions())
            return self.own.fit(rows)

    monkeypatch.setattr(M, "_configured", Counted)
    M.search("LogisticRegression", wavy.repartition(16), [{"C": 1.0, "elasticNetParam": e} for e in (0.0, 1.0)], 4, cores)
    assert used == [-(-cores // min(8, cores))] * 8


def test_tasks_of_a_fit_are_bounded_by_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert M.fit_tasks(5, spark) == 1 and M.fit_tasks(2 * M.TASK_ROWS, spark) == min(2, cores)
    assert M.fit_tasks(10_000 * M.TASK_ROWS, spark) == cores


@pytest.mark.parametrize("rows", [100, 65_536])
def test_trees_do_not_pass_through_the_driver(spark, wavy, tmp_path, rows, monkeypatch):
    """They are stored by tasks, read by those that score, and a saved model has its own copy."""
    import pickle

    from pyspark import RDD
    from pyspark.ml import PipelineModel

    monkeypatch.setattr(B, "BLOCK_ROWS", rows)
    sent, collect = [0], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: [sent.append(len(pickle.dumps(found := collect(rdd)))), found][1])
    monkeypatch.setattr(B, "BLOCKS_AT_ONCE", 1)
    model = B.Forest(numTrees=40).fit(wavy)
    shares = model.featureImportances
    packed = sum(map(len, model.held["trees"]))
    assert packed > 10 * len(model.getOrDefault(model.trees))
    if rows > 100:
        assert max(sent) < packed / 5
    assert list(shares) == list(B.gain_shares(map(B.unpacked_tree, model.held["trees"]), 4, True))
    whole = {r.customerID: r.probability[1] for r in model.transform(wavy).collect()}
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert back.ensemble == model.ensemble and str(tmp_path) in back.getOrDefault(back.trees)
    assert {r.customerID: r.probability[1] for r in back.transform(wavy).collect()} == whole


def test_elimination_keeps_no_trees(spark, wavy, monkeypatch):
    """The gains of a forest reach the driver, not its trees; its ranking is that of the trees."""
    fit = B.Forest(numTrees=30, maxDepth=8).settings(4)
    with B.BinnedTable(wavy, "features", 4, "customerID") as table:
        grown, _ = table.fit([fit], seed=3)
        own = B.gain_shares(map(B.unpacked_tree, grown[0][1]), 4, True)
        monkeypatch.setattr(B, "packed_tree", None)
        assert list(table.gain_shares(fit, 4, 3)) == list(own)
        monkeypatch.setattr(B, "BLOCKS_AT_ONCE", 0)
        assert list(table.gain_shares(fit, 4, 3)) == list(own)


@pytest.mark.parametrize("kind", ["boosted", "leafwise", "forest"])
def test_trees_of_stored_blocks_and_of_shared_passes_are_the_same(spark, wavy, kind, monkeypatch):
    """Tables of many blocks are read as a whole from the shared folder, larger ones grow in shared passes."""
    from ebbline.operators.splitting import stratified_folds

    parts = stratified_folds(wavy, "label", "customerID", 2, 42).cache()
    points = {
        "boosted": [{"maxIter": 3, "maxDepth": d, "subsamplingRate": 0.8} for d in (1, 4)],
        "leafwise": [{"maxIter": 3, "maxDepth": 5, "numLeaves": n, "minInstancesPerNode": 10, "featureShare": 0.8, "minWeight": 1e-3, "penalty": 0.0} for n in (4, 9)],
        "forest": [{"numTrees": 3, "maxDepth": d, "minInstancesPerSplit": s} for d in (3, 0) for s in (2, 9)],
    }[kind]
    estimator = B.Forest() if kind == "forest" else B.BoostedTrees()
    one = estimator.search(parts, points, 2)
    # Parts of few rows, coarse codes for all levels, nodes dealt early and counted both ways.
    for name, value in {"BLOCK_ROWS": 50, "PART_ROWS": 100, "COARSE_NODES": 3, "DEALT_NODES": 3, "JOINT_ROWS": 20, "DRAWN_ROWS": 70}.items():
        monkeypatch.setattr(B, name, value)
    with monkeypatch.context() as own:
        own.setattr(B, "_side_by_side", None)
        stored = estimator.search(parts, points, 2)
    monkeypatch.setattr(B, "STORED_ROWS", 0)
    monkeypatch.setattr(B, "_dealt", None)
    passes = estimator.search(parts, points, 2)
    for other in (stored, passes):
        assert one[0] == other[0] and one[2].ensemble == other[2].ensemble
        np.testing.assert_allclose(one[1], other[1], atol=1e-12)


def test_parts_of_a_block_give_the_same_trees(monkeypatch):
    """What is summed up together, and where rows stand, does not change a tree."""
    rng = np.random.default_rng(3)
    n = 3000
    bins = np.concatenate((rng.integers(0, 40, (3, n)), rng.integers(0, 2, (6, n)))).astype(np.uint8)
    label = ((bins[0] > 20) ^ (bins[4] > 0) ^ (rng.random(n) < 0.2)).astype(float)
    layout = B.Layout([[float(i) for i in range(39)]] * 3 + [[0.5]] * 6)
    raw = {"bins": bins, "label": label, "fold": rng.integers(0, 3, n).astype(np.int32), "hash": rng.integers(0, 2**62, n).astype(np.uint64)}
    fits = [
        B.Fit(rounds=3, depth=0, features_share=0.4, least_weight=0.0, penalty=0.0, forest=True, fold=1),
        B.Fit(rounds=4, depth=6, rows_share=0.7, fold=1), B.Fit(rounds=4, depth=7, leaves=9, least_rows=5, features_share=0.8, penalty=0.0, least_weight=1e-3, fold=1),
    ]

    def found():
        block = B.ready_block(B.prepared_block(raw, layout), layout)
        scores = [list(B._run_alone(block, 0, f, 0.1, layout, [(f.rounds, 0 if f.forest else f.depth, 2 if f.forest else 0)], 7, len)) for f in fits]
        return scores, [B.tree_table(B._grown_alone(block, fits[0], k, layout, 7)[0], 0, layout.borders).tolist() for k in (1, 2)]

    whole = found()
    assert all(len(rows) for rows in whole[0]) and len(whole[1][0]) > 200
    for settings in ({"PART_ROWS": 200, "DEALT_NODES": 2, "JOINT_ROWS": 30}, {"COARSE_NODES": 0, "JOINT_ROWS": 1 << 30}, {"COARSE_CODES": 300, "COARSE_NODES": 64, "JOINT_ROWS": 0}):
        with monkeypatch.context() as own:
            for name, value in settings.items():
                own.setattr(B, name, value)
            assert found() == whole
    # Labels other than 0 and 1 are not packed.
    raw["label"] = label * 0.5
    halves = found()[1]
    assert [[n[:3] for n in t] for t in halves] != [] and all(0 <= n[3] <= 0.5 for t in halves for n in t)


def test_forest_points_that_split_fewer_nodes_share_a_fit(spark, wavy, monkeypatch):
    from ebbline.operators.splitting import stratified_folds

    parts = stratified_folds(wavy, "label", "customerID", 2, 42).cache()
    fits, fit = [], B.BinnedTable.fit
    monkeypatch.setattr(B.BinnedTable, "fit", lambda self, own, *a, **b: fits.append(len(own)) or fit(self, own, *a, **b))
    points = [{"numTrees": 2, "minInstancesPerSplit": s, "minInstancesPerNode": n} for s in (2, 30) for n in (1, 2)]
    B.Forest().search(parts, points, 2)
    # One fit a fold for each of the two leaf sizes, and the refit of the best point.
    assert fits == [4, 1]


def test_leaf_budgets_bound_what_is_grown(wavy, monkeypatch):
    """Nodes that best-first order can't reach are not split on the way."""
    rows = wavy.collect()
    x = np.array([r.features.toArray() for r in rows])
    borders = [sorted({(a + 0.5) / 20 for a in range(20)})] * 4
    bins = np.stack([np.searchsorted(borders[i], x[:, i]) for i in range(4)]).astype(np.uint8)
    raw = {"bins": bins, "label": np.array([float(r.label) for r in rows]), "fold": np.full(600, -2, np.int32), "hash": np.arange(600, dtype=np.uint64)}
    layout = B.Layout(borders)
    block = B.ready_block(B.prepared_block(raw, layout), layout) | {"scores": np.zeros((1, 600))}
    searched, split = [], B.best_splits
    monkeypatch.setattr(B, "best_splits", lambda sums, choice, *a: searched.append(len(choice.first) - 1) or split(sums, choice, *a))
    fit = B.Fit(depth=9, least_weight=0.0, penalty=0.1, leaves=5)
    some = B._grown_alone(block, fit, 1, layout, 1)[0]
    few, searched[:] = sum(searched), []
    free = B._grown_alone(block, B.replace(fit, leaves=None), 1, layout, 1)[0]
    assert len(B.tree_table(some, 0, borders)) == 9 and few < sum(searched) / 3
    assert len(some.left) < len(free.left) / 3
