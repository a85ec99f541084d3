"""Attribution of predictions to features, as long tables keyed by customer and feature.

Linear models have exact contributions per row, and so have tree models (``tree_paths``). Other models use sampled
permutations: features
are switched from a background row to the customer's values one by one, the model scores every
step, and a feature's contribution is the mean change it causes. Contributions of a row add up to
its prediction minus the base value.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import RANDOM_SEED, ROLES
from ebbline.functions.scalars import double_array
from ebbline.operators.encode import FEATURES
from ebbline.operators.histogram_trees import TreesModel
from ebbline.operators.splitting import sample_rows
from ebbline.operators.tree_paths import tree_attribution

#: Equal-width bins of a value in the search for interactions.
INTERACTION_BINS = 10


def _names(names: Sequence[str]):
    return F.array(*[F.lit(n) for n in names])


def linear_attribution(
    encoded: DataFrame, model: Model, names: Sequence[str], key: str = ROLES.key
) -> DataFrame:
    """Exact contributions of a linear model on its log-odds scale: a narrow projection.

    Columns: key, feature, value, phi, base (the log-odds at the mean of the data).
    """
    mean = encoded.agg(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"]
    weights = [float(w) for w in model.coefficients.toArray()]
    means = [float(m) for m in mean]
    base = float(model.intercept + sum(w * m for w, m in zip(weights, means)))
    weight_of, mean_of = double_array(weights), double_array(means)
    name_of = _names(names)
    cells = F.transform(
        vector_to_array(FEATURES),
        lambda x, i: F.struct(
            name_of[i].alias("feature"),
            x.alias("value"),
            (weight_of[i] * (x - mean_of[i])).alias("phi"),
        ),
    )
    return encoded.select(key, F.inline(cells)).withColumn("base", F.lit(base))


def explain(
    encoded: DataFrame, model: Model, names: Sequence[str], background: DataFrame, key: str = ROLES.key,
    sample_size: int | None = None,
) -> DataFrame:
    """Contributions by the exact form where the model has one, else sampled.

    ``background`` gives the base of tree models; ``sample_size`` rows are explained (``None``: all).
    """
    rows = encoded if sample_size is None else sample_rows(encoded, sample_size, key, RANDOM_SEED)
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "coefficients"):
        return linear_attribution(rows, last, names, key)
    if isinstance(last, TreesModel) or hasattr(last, "toDebugString"):
        return tree_attribution(rows, last, names, background, key)
    return sampled_attribution(rows, model, names, key)


def sampled_attribution(
    encoded: DataFrame, model: Model, names: Sequence[str], key: str = ROLES.key,
    sample_size: int | None = None, permutations: int = 8, seed: int = RANDOM_SEED,
) -> DataFrame:
    """Permutation-sampled contributions on the probability scale.

    ``sample_size`` rows are explained (``None``: all). Each row is scored permutations x
    (features + 1) times; the steps of one row stay in one task and are combined there, so the
    shuffle carries one record per row and feature.
    """
    width = len(names)
    rng = random.Random(seed)
    rows = encoded.select(key, FEATURES)
    # One background row per permutation: a handful of vectors, fixed by the parameter.
    drawn = sample_rows(rows, permutations, key, seed + 1).collect()
    plans = []
    for i in range(permutations):
        order = list(range(width))
        rng.shuffle(order)
        plans.append((order, [float(v) for v in drawn[i % len(drawn)][FEATURES].toArray()]))
    plan = encoded.sparkSession.createDataFrame(plans, "features_in_order array<int>, background array<double>")
    plan = plan.withColumn(
        # position_of[j]: when feature j is switched on
        "position_of",
        F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda j: F.array_position("features_in_order", j.cast("int")).cast("int") - 1,
        ),
    )
    explained = rows if sample_size is None else sample_rows(rows, sample_size, key, seed)
    steps = (
        explained.withColumn("x", vector_to_array(FEATURES))
        .drop(FEATURES)
        .crossJoin(F.broadcast(plan))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    )
    mixed = F.transform(
        F.col("x"),
        lambda value, j: F.when(F.col("position_of")[j] < F.col("step"), value).otherwise(
            F.col("background")[j]
        ),
    )
    scored = model.transform(steps.withColumn(FEATURES, array_to_vector(mixed)))
    p = vector_to_array("probability")[1]
    order = F.col("features_in_order")
    # A step ends the switch of one feature (+p) and starts that of the next (-p).
    ends = F.struct(
        F.when(F.col("step") > 0, F.get(order, F.col("step") - 1)).alias("i"), p.alias("part")
    )
    starts = F.struct(
        F.when(F.col("step") < width, F.get(order, F.col("step"))).alias("i"), (-p).alias("part")
    )
    contributions = (
        scored.select(key, "x", F.inline(F.array(ends, starts)))
        .where(F.col("i").isNotNull())
        .groupBy(key, "i")
        .agg(
            (F.sum("part") / permutations).alias("phi"),
            F.first(F.get("x", F.col("i"))).alias("value"),
        )
    )
    base = _background_score(model, plan).collect()[0]["base"]
    return contributions.select(
        key, _names(names)[F.col("i")].alias("feature"), "value", "phi", F.lit(base).alias("base")
    )


def _background_score(model: Model, plan: DataFrame) -> DataFrame:
    """Mean prediction over the background rows: the base value."""
    scored = model.transform(plan.select(array_to_vector("background").alias(FEATURES)))
    return scored.agg(F.avg(vector_to_array("probability")[1]).alias("base"))


def attribution_importance(attributions: DataFrame) -> DataFrame:
    return (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("attribution_importance"))
        .orderBy(F.desc("attribution_importance"), "feature")
    )


def attribution_totals(importance: DataFrame) -> DataFrame:
    return importance.agg(
        F.sum("attribution_importance").alias("total_impact"),
        F.avg("attribution_importance").alias("average_impact"),
    )


def local_contributions(
    attributions: DataFrame, key: str = ROLES.key, top: int = 10
) -> DataFrame:
    """The ``top`` strongest contributions per customer with their direction."""
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), "feature")
    return (
        attributions.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .select(
            key, "place", "feature", "value", "phi", F.abs("phi").alias("abs_phi"),
            F.when(F.col("phi") > 0, "Increases Churn Risk")
            .otherwise("Decreases Churn Risk")
            .alias("direction"),
        )
    )


def waterfall(attributions: DataFrame, key: str = ROLES.key, max_display: int = 10) -> DataFrame:
    """Base value to prediction in steps: the strongest features, then the rest as one step.

    Windows are per customer and hold one row per feature.
    """
    strength = Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), "feature")
    ranked = attributions.withColumn("place", F.row_number().over(strength))
    shown = F.least(F.col("place"), F.lit(max_display))
    last = F.col("place") < max_display
    grouped = (
        ranked.groupBy(key, shown.alias("place"))
        .agg(
            F.count(F.lit(1)).alias("features"),
            F.min("feature").alias("feature"),
            F.first("value").alias("value"),
            F.sum("phi").alias("phi"),
            F.max("base").alias("base"),
        )
        .withColumn(
            "feature",
            F.when(last | (F.col("features") == 1), F.col("feature")).otherwise(
                F.concat(F.col("features").cast("string"), F.lit(" other features"))
            ),
        )
        .withColumn("value", F.when(F.col("features") == 1, F.col("value")))
    )
    so_far = (
        Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.col("base") + F.sum("phi").over(so_far)
    return grouped.select(
        key, "place", "feature", "value", "phi", "base", (end - F.col("phi")).alias("start"), end.alias("end")
    )


def interaction_ranking(
    attributions: DataFrame, feature: str, key: str = ROLES.key, bins: int = INTERACTION_BINS
) -> DataFrame:
    """All other features by how far their binned values explain what the feature's own value leaves open.

    ``feature, explained``: the variance of the contribution between bins of the other value, within bins of the own value.
    Bins are of equal width. Rows are joined by key and counted per pair of bins before the last shuffle.
    """
    ranges = attributions.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # One row a feature.
    placed = attributions.join(F.broadcast(ranges), "feature")
    share = F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    placed = placed.select(key, "feature", "phi", place.alias("bin"))
    own = placed.where(F.col("feature") == feature).select(key, F.col("phi").alias("own_phi"), F.col("bin").alias("own_bin"))
    others = placed.where(F.col("feature") != feature).select(key, "feature", "bin")
    cells = (
        others.join(own, key)
        .groupBy("feature", "own_bin", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("own_phi").alias("s"))
    )
    lines = cells.groupBy("feature", "own_bin").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between")
    )
    explained = F.sum(F.col("between") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")
    return lines.groupBy("feature").agg(explained.alias("explained")).orderBy(F.desc(F.round("explained", 9)), "feature")


def dependence(
    attributions: DataFrame, feature: str, interaction: str | None = None, key: str = ROLES.key
) -> DataFrame:
    """Feature value against contribution, with the value of a second feature when asked for.

    ``interaction="auto"`` takes the feature that ``interaction_ranking`` puts first and names it in a column.
    """
    chosen = None
    if interaction == "auto":
        first = interaction_ranking(attributions, feature, key).first()
        chosen = interaction = first["feature"] if first else None
    wanted = [feature] if interaction is None else [feature, interaction]
    is_main = F.col("feature") == feature
    rows = attributions.where(F.col("feature").isin(wanted)).groupBy(key)
    picked = [
        F.max(F.when(is_main, F.col("value"))).alias("value"),
        F.max(F.when(is_main, F.col("phi"))).alias("phi"),
    ]
    if interaction is not None:
        other = F.when(F.col("feature") == interaction, F.col("value"))
        picked.append(F.max(other).alias("interaction_value"))
    if chosen is not None:
        picked.append(F.lit(chosen).alias("interaction_feature"))
    return rows.agg(*picked)


def beeswarm(attributions: DataFrame, top: int = 20, key: str = ROLES.key) -> DataFrame:
    """All contributions of the ``top`` most important features."""
    leading = attribution_importance(attributions).select("feature").limit(top)
    # At most ``top`` names.
    return attributions.join(F.broadcast(leading), "feature", "left_semi").select(
        key, "feature", "value", "phi"
    )
