"""Exact Shapley values of tree ensembles from their leaf paths.

The value of a set S of features is the prediction with S taken from the row and every split on another feature
averaged over its branches by the share of background rows that take them. A leaf then contributes a
product: over the features of its path, 1 or 0 for those in S (the row keeps to the path or not) and the branch shares
for the others. The Shapley weight of such a product has a closed form as an integral,

    phi_j = leaf * (o_j - r_j) * integral over t in [0, 1] of prod_{i != j} (o_i t + r_i (1 - t)),

a polynomial of degree m - 1 in t for a path of m features, so a Gauss-Legendre rule of m / 2 points gives it exactly. Contributions of a
row add up to its prediction minus the base, and the base is the mean prediction over all background rows.

Both passes are narrow: one over the background counts rows by node, one over the explained rows takes all paths. For
many rows, a path of m features at most `TABLE_FEATURES` is worked out once for each of the 2^m patterns of features that a row
keeps to. The paths below a node are added up by the pattern at that node and the sides of the splits below it, as far
as these make `TABLE_BITS` bits: a row gets its pattern on its way down and looks up all paths of such a subtree at once. Rows are
gathered before that, whatever batches and partitions Spark cuts, as tables cost the same for few rows as for many. Nodes and
paths travel with the tasks; their number is that of the model.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.config import ROLES
from ebbline.operators.encode import FEATURES
from ebbline.operators.histogram_trees import TreesModel, unpacked_tree
from ebbline.session import shared_folder

#: Cells (rows x paths x features of a path) worked on at once.
CELLS = 1 << 21
#: Features of a path whose patterns are tabled, bits by which a subtree is looked up, rows from which tables pay.
TABLE_FEATURES = 10
TABLE_BITS = 11
TABLE_ROWS = 1024
#: Cells of tables and of patterns held at once, rows looked up at once, cells (rows x features) gathered at once.
TABLE_CELLS = 1 << 20
PATTERN_CELLS = 1 << 25
LOOKUP_ROWS = 1 << 14
GATHERED_CELLS = 1 << 21


@dataclass
class Nodes:
    """All trees of a model side by side; `left` and `right` are -1 for leaves, whose `value` counts."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    categories: dict[int, list[float]]  # node: values that go left, for splits on categories
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    base: float = 0.0

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        """rows x nodes: whether a row would go left at the node."""
        found = x[:, self.feature] <= self.threshold
        for node, values in self.categories.items():
            found[:, node] = np.isin(x[:, self.feature[node]], values)
        return found


def _own_nodes(model: TreesModel) -> Nodes:
    held = model.held
    trees = held["trees"]
    share = 1.0 / max(len(trees), 1) if held["forest"] else 1.0
    roots, parts, at = [], [], 0
    for tree in trees:
        table = unpacked_tree(tree)
        inner = table[:, 2] >= 0
        table[inner, 2] += at
        roots.append(at)
        parts.append(table)
        at += len(table)
    table = np.concatenate(parts) if parts else np.zeros((0, 6))
    left = table[:, 2].astype(np.int64)
    feature = np.maximum(table[:, 0], 0).astype(np.int64)
    return Nodes(np.array(roots, np.int64), feature, table[:, 1], {}, left, np.where(left >= 0, left + 1, -1), table[:, 3] * share, table[:, 5], held["base"])


def _saved_nodes(model: Model) -> Nodes:
    """Nodes of a Spark tree model from its saved form; probability of class 1 for classifiers, margin for boosted ones."""
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/trees"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    data = data if "nodeData" in data.columns else data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = "GBT" in type(model).__name__
    share = [w if boosted else 1.0 / len(weights) for w in weights]
    found = data.select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    place = {(r["treeID"], r["id"]): i for i, r in enumerate(found)}
    n = len(found)
    feature, threshold, left, right, value = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n)
    categories, roots = {}, []
    for i, r in enumerate(found):
        if r["id"] == 0:
            roots.append(i)
        if r["leftChild"] >= 0:
            left[i], right[i] = place[r["treeID"], r["leftChild"]], place[r["treeID"], r["rightChild"]]
            feature[i] = r["split"]["featureIndex"]
            if r["split"]["numCategories"] >= 0:
                categories[i] = list(r["split"]["leftCategoriesOrThreshold"])
            else:
                threshold[i] = r["split"]["leftCategoriesOrThreshold"][0]
        stats = r["impurityStats"]
        own = r["prediction"] if boosted else stats[1] / sum(stats)
        value[i] = own * share[r["treeID"]]
    return Nodes(np.array(roots), feature, threshold, categories, left, right, value, np.array([r["rawCount"] for r in found], np.float64))


def nodes_of(model: Model) -> Nodes:
    """The trees of a fitted model (forest, tree, boosted trees; the last stage of a pipeline)."""
    model = model.stages[-1] if isinstance(model, PipelineModel) else model
    return _own_nodes(model) if isinstance(model, TreesModel) else _saved_nodes(model)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def background_rows(background: DataFrame, nodes: Nodes) -> np.ndarray:
    """Rows of the background that reach each node: one narrow pass, one row a node and task merged by Spark."""

    categorical = np.zeros(len(nodes.left), bool)
    categorical[list(nodes.categories)] = True

    def count(batches):
        total = np.zeros(len(nodes.left), np.int64)
        for batch in batches:
            x = _matrix(batch)
            for root in nodes.roots.tolist():
                node, open_ = np.full(len(x), root), np.arange(len(x))
                total[root] += len(x)
                while True:
                    open_ = open_[nodes.left[node[open_]] >= 0]
                    if not len(open_):
                        break
                    at = node[open_]
                    goes = x[open_, nodes.feature[at]] <= nodes.threshold[at]
                    for own in np.unique(at[categorical[at]]).tolist():
                        mine = at == own
                        goes[mine] = np.isin(x[open_[mine], nodes.feature[own]], nodes.categories[own])
                    node[open_] = np.where(goes, nodes.left[at], nodes.right[at])
                    counts = np.bincount(node[open_] - root)
                    total[root : root + len(counts)] += counts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["node", "n"])

    rows = background.select(vector_to_array(FEATURES).alias("x"))
    counts = rows.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(nodes.left), np.int64)
    for r in counts:
        total[r["node"]] = r["n"]
    return total


@dataclass
class Paths:
    """Leaf paths of m features each: `node` and `side` of every split by feature (padded by repetition), shares, leaf values."""

    feature: np.ndarray  # paths x m
    node: np.ndarray  # paths x m x splits
    side: np.ndarray  # paths x m x splits: True for left
    share: np.ndarray  # paths x m
    leaf: np.ndarray  # paths


def _branch_share(nodes: Nodes, rows: np.ndarray, child: int, parent: int) -> float:
    # Where no background row comes, the rows that the model was fitted on decide.
    counts = rows if rows[parent] else nodes.rows
    return float(counts[child]) / float(counts[parent])


def leaf_paths(nodes: Nodes, rows: np.ndarray) -> tuple[dict[int, Paths], float]:
    """Paths by number of features, and the base value; rows holds the background rows of each node."""
    found: dict[int, list] = {}
    base = nodes.base

    for root in nodes.roots:
        total = max(int(rows[root]), 1)
        open_: list[tuple[int, dict]] = [(int(root), {})]
        while open_:
            node, taken = open_.pop()
            if nodes.left[node] < 0:
                base += nodes.value[node] * rows[node] / total
                if taken:
                    found.setdefault(len(taken), []).append((taken, nodes.value[node]))
                continue
            f = int(nodes.feature[node])
            for child, is_left in ((int(nodes.left[node]), True), (int(nodes.right[node]), False)):
                splits, weight = taken.get(f, ((), 1.0))
                open_.append((child, taken | {f: ((*splits, (node, is_left)), weight * _branch_share(nodes, rows, child, node))}))
    paths = {}
    for m, group in found.items():
        most = max(len(splits) for taken, _ in group for splits, _ in taken.values())
        padded = [[splits + (splits[-1],) * (most - len(splits)) for splits, _ in taken.values()] for taken, _ in group]
        table = np.array(padded, np.int64).reshape(len(group), m, most, 2)
        shares = np.array([[w for _, w in taken.values()] for taken, _ in group])
        paths[m] = Paths(np.array([list(taken) for taken, _ in group]), table[..., 0], table[..., 1].astype(bool), shares, np.array([v for _, v in group]))
    return paths, float(base)


def contributions(x: np.ndarray, nodes: Nodes, paths: dict[int, Paths]) -> np.ndarray:
    """rows x features: Shapley values of the rows of x."""
    phi = np.zeros(x.shape)
    if not paths:
        return phi
    left = nodes.goes_left(x)
    for m, p in paths.items():
        points, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        step = max(1, CELLS // (len(x) * m))
        for at in range(0, len(p.leaf), step):
            part = slice(at, at + step)
            kept = (left[:, p.node[part]] == p.side[part]).all(axis=-1).astype(np.float64)  # rows x paths x m
            share, total = p.share[part], np.zeros_like(kept)
            for t, w in zip(points, weights):
                factor = kept * t + share * (1 - t)
                before, after = np.ones_like(factor), np.ones_like(factor)
                for j in range(1, m):
                    before[..., j] = before[..., j - 1] * factor[..., j - 1]
                    after[..., m - 1 - j] = after[..., m - j] * factor[..., m - j]
                total += w * before * after
            total *= (kept - share) * p.leaf[part][:, None]
            owners = p.feature[part].reshape(-1)
            order = np.argsort(owners, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(owners[order]) > 0])
            phi[:, owners[order][starts]] += np.add.reduceat(total.reshape(len(x), -1)[:, order], starts, axis=1)
    return phi


@dataclass
class Subtree:
    """Paths that are looked up together, those below one node.

    The index of a row has the pattern at the node (its place `at`, -1: root; `bits` bits) and, above it, a bit for each of `nodes`: whether
    the row goes left there. paths: m, the place among the paths of m features, and the steps from the node to the leaf as
    (number of the split, bit of its feature, whether that is new to the path, whether the path goes left).
    """

    number: int
    at: int
    bits: int
    nodes: list[int]
    paths: list[tuple[int, int, tuple]]


@dataclass
class Tabled:
    """Paths of one tree with `TABLE_FEATURES` features at most.

    splits, parents first: the place of the pattern of the node (-1: root), the node, and the bit of its feature; the children's patterns
    are at twice the place of the split and the next one. leaves by m: features, shares, leaf values of the paths.
    """

    splits: list[tuple[int, int, int, bool]]
    subtrees: list[Subtree]
    leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _splits_below(nodes: Nodes, root: int) -> dict[int, int]:
    """Splits of the subtree of every node of a tree."""
    order, found = [root], {}
    for node in order:
        if nodes.left[node] >= 0:
            order += [int(nodes.left[node]), int(nodes.right[node])]
    for node in reversed(order):
        found[node] = 1 + found[int(nodes.left[node])] + found[int(nodes.right[node])] if nodes.left[node] >= 0 else 0
    return found


def tabled_paths(nodes: Nodes, rows: np.ndarray) -> list[Tabled]:
    """Short paths of every tree; rows holds the background rows of each node."""
    found = []
    for root in nodes.roots.tolist():
        splits, subtrees, ends, below = [], [], [], _splits_below(nodes, root)
        # A node, the place of its pattern, features and shares of its path; its subtree once that is looked up as one, and the steps there.
        open_: list[tuple[int, int, tuple, tuple, Subtree | None, tuple]] = [(root, -1, (), (), None, ())]
        for node, at, features, shares, own, steps in open_:
            if own is None and (not below[node] or len(features) + below[node] <= TABLE_BITS):
                own = Subtree(len(subtrees), at, len(features), [], [])
                subtrees.append(own)
                ends.append([])
            if nodes.left[node] < 0:
                if features:
                    ends[own.number].append((features, shares, nodes.value[node], steps))
                continue
            f = int(nodes.feature[node])
            bit = features.index(f) if f in features else len(features)
            if bit == TABLE_FEATURES:
                continue
            fresh = bit == len(features)
            for i, child in enumerate((int(nodes.left[node]), int(nodes.right[node]))):
                share = _branch_share(nodes, rows, child, node)
                weights = (*shares, share) if fresh else (*shares[:bit], shares[bit] * share, *shares[bit + 1 :])
                place, further = (2 * len(splits) + i, ()) if own is None else (-1, (*steps, (len(own.nodes), bit, fresh, i == 0)))
                open_.append((child, place, (*features, f) if fresh else features, weights, own, further))
            if own is None:
                splits.append((at, node, bit, fresh))
            else:
                own.nodes.append(node)
        # Paths are numbered in the order of their subtrees, in which their tables are worked out.
        leaves: dict[int, list] = {}
        for subtree, paths in zip(subtrees, ends):
            for features, shares, value, steps in paths:
                group = leaves.setdefault(len(features), [])
                subtree.paths.append((len(features), len(group), steps))
                group.append((features, shares, value))
        held = {m: tuple(np.array(c) for c in zip(*group)) for m, group in leaves.items()}
        found.append(Tabled(splits, [s for s in subtrees if s.paths], held))
    return found


def pattern_tables(share: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """paths x m x 2^m: contributions of the features of each path by pattern; bit j is set where a row keeps to feature j."""
    m = share.shape[1]
    points, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
    points, weights = (points + 1) / 2, weights / 2
    low = share[:, :, None] * (1 - points)
    high = low + points
    product = np.ones((len(share), 1, len(points)))
    for j in range(m):
        product = np.concatenate((product * low[:, [j]], product * high[:, [j]]), axis=1)
    # Without feature j: the product with its bit set over its factor, which is above 0 then.
    others = product @ (weights / high).transpose(0, 2, 1)
    bit, pattern = 1 << np.arange(m), np.arange(1 << m)[:, None]
    table = others[:, pattern | bit, np.arange(m)]
    share = share[:, None, :]
    table *= np.where(pattern & bit, 1 - share, -share) * leaf[:, None, None]
    return np.ascontiguousarray(table.transpose(0, 2, 1))


@lru_cache(maxsize=4096)
def _path_patterns(bits: int, splits: int, steps: tuple) -> np.ndarray:
    """Pattern of a path by the index of its subtree."""
    index = np.arange(1 << (bits + splits))
    pattern = index & ((1 << bits) - 1)
    for split, bit, fresh, is_left in steps:
        kept = ((index >> (bits + split)) & 1) == is_left
        pattern = pattern | (kept << bit) if fresh else pattern & ~(~kept << bit)
    return pattern


def tabled_contributions(x: np.ndarray, nodes: Nodes, trees: Sequence[Tabled]) -> np.ndarray:
    """rows x features: the part of the Shapley values that comes from short paths."""
    columns, phi = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
    most = max((len(t.splits) for t in trees), default=0)
    step = max(TABLE_ROWS, PATTERN_CELLS // (2 * most + 1))
    read = np.empty(LOOKUP_ROWS)
    for tree in trees:
        for start in range(0, x.shape[0], step):
            part = columns[:, start : start + step]
            patterns = _patterns(part, nodes, tree)
            for subtree, features, table in _subtree_tables(tree):
                for at in range(0, part.shape[1], LOOKUP_ROWS):
                    some = slice(at, at + LOOKUP_ROWS)
                    index = _index(part[:, some], patterns[:, some], nodes, subtree)
                    found, own = read[: len(index)], slice(start + at, start + at + len(index))
                    for f, values in zip(features, table):
                        # Every index is in the table; clipping saves a check and a copy.
                        values.take(index, out=found, mode="clip")
                        phi[f, own] += found
    return phi.T


def _index(columns: np.ndarray, patterns: np.ndarray, nodes: Nodes, subtree: Subtree) -> np.ndarray:
    """Places of the rows (columns: features x rows) in the table of a subtree."""
    index = patterns[subtree.at].astype(np.intp) if subtree.at >= 0 else np.zeros(columns.shape[1], np.intp)
    for i, node in enumerate(subtree.nodes):
        index |= _goes_left(columns, nodes, node).astype(np.intp) << (subtree.bits + i)
    return index


def _subtree_tables(tree: Tabled) -> Iterator[tuple[Subtree, list[int], np.ndarray]]:
    """Subtrees with their features and features x indices: the sum of the contributions over all paths."""
    ranges = {m: range(0) for m in tree.leaves}
    tables: dict[int, np.ndarray] = {}
    for subtree in tree.subtrees:
        features = sorted({int(f) for m, k, _ in subtree.paths for f in tree.leaves[m][0][k]})
        row = {f: i for i, f in enumerate(features)}
        total = np.zeros((len(features), 1 << (subtree.bits + len(subtree.nodes))))
        for m, k, steps in subtree.paths:
            own, shares, leaf = tree.leaves[m]
            if k not in ranges[m]:
                ranges[m] = range(k, min(k + max(1, TABLE_CELLS // (m << m)), len(leaf)))
                tables[m] = pattern_tables(shares[ranges[m].start : ranges[m].stop], leaf[ranges[m].start : ranges[m].stop])
            pattern = _path_patterns(subtree.bits, len(subtree.nodes), steps)
            total[[row[f] for f in own[k].tolist()]] += tables[m][k - ranges[m].start].take(pattern, axis=1)
        yield subtree, features, total


def _goes_left(columns: np.ndarray, nodes: Nodes, node: int) -> np.ndarray:
    value = columns[nodes.feature[node]]
    return np.isin(value, nodes.categories[node]) if node in nodes.categories else value <= nodes.threshold[node]


def _patterns(columns: np.ndarray, nodes: Nodes, tree: Tabled) -> np.ndarray:
    """Patterns of the rows (columns: features x rows) at both children of every split."""
    found = np.empty((2 * len(tree.splits), columns.shape[1]), np.uint16)
    for i, (at, node, bit, fresh) in enumerate(tree.splits):
        left = _goes_left(columns, nodes, node).astype(np.uint16) << np.uint16(bit)
        right = left ^ np.uint16(1 << bit)
        before = found[at] if at >= 0 else np.uint16(0)
        if fresh:
            found[2 * i], found[2 * i + 1] = before | left, before | right
        else:
            others = np.uint16(0xFFFF ^ (1 << bit))
            found[2 * i], found[2 * i + 1] = before & (left | others), before & (right | others)
    return found


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to one of so many rows or a little more."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(rows).ravel()))


def tree_attribution(encoded: DataFrame, model: Model, names: Sequence[str], background: DataFrame, key: str = ROLES.key) -> DataFrame:
    """Exact contributions of every row of encoded: key, feature, value, phi, base.

    On the scale on which the trees add up: the probability for forests, the margin for boosted trees.
    """
    nodes = nodes_of(model)
    counts = background_rows(background, nodes)
    paths, base = leaf_paths(nodes, counts)
    tabled, long = tabled_paths(nodes, counts), {m: p for m, p in paths.items() if m > TABLE_FEATURES}
    rows = encoded.select(key, vector_to_array(FEATURES).alias("x"))
    most = max(TABLE_ROWS, GATHERED_CELLS // max(len(names), 1))
    # The work of a row grows with the paths: few partitions are dealt to all cores. Many small ones are joined, as each task works out all tables.
    cores, parts = encoded.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    if parts < cores:
        rows = rows.repartition(cores)
    elif parts > cores:
        rows = rows.coalesce(min(parts, max(cores, encoded.count() // most)))

    def explain(batches):
        for batch in gathered(batches, most):
            x = _matrix(batch)
            # Tables are for many rows; what is left for each row are the long paths.
            many = len(x) >= TABLE_ROWS
            phi = np.ascontiguousarray(tabled_contributions(x, nodes, tabled)) if many else np.zeros(x.shape)
            for at in range(0, len(x), 256):
                phi[at : at + 256] += contributions(x[at : at + 256], nodes, long if many else paths)
            for at in range(0, len(x), 4096):
                some = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], _lists(x[some]), _lists(phi[some])], names=[key, "x", "phi"])

    kind = rows.schema[key].dataType.simpleString()
    explained = rows.mapInArrow(explain, f"`{key}` {kind}, x array<double>, phi array<double>")
    texts = F.array(*[F.lit(n) for n in names])
    cells = F.transform("phi", lambda p, i: F.struct(texts[i].alias("feature"), F.col("x")[i].alias("value"), p.alias("phi")))
    return explained.select(key, F.inline(cells)).withColumn("base", F.lit(base))
