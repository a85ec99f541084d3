"""Effect estimation with confounders: strata, propensity scores, matching and refutation checks.

Everything is reduced to counts and means per stratum (or per distinct score) before anything is
compared, so no step pairs rows with rows, and a stratum of any size is one row after the
map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ebbline.config import RANDOM_SEED, ROLES
from ebbline.functions.distributions import normal_two_sided
from ebbline.functions.scalars import cut, double_array, outcome_value
from ebbline.operators.ordered import exact_quantiles, range_bucket, value_splits
from ebbline.operators.splitting import assign_share

Z_95 = 1.959963984540054  # fixed value: 97.5 % point of the normal distribution
ALPHA = 0.05
SCORE_BUCKETS = 1024
SALTS = 16


def _known(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def bin_confounders(
    df: DataFrame, confounders: Sequence[str] = ROLES.confounders, bins: int = 4
) -> tuple[DataFrame, list[str]]:
    """Strata columns: text confounders as they are, numeric ones cut at their exact quantiles."""
    numeric = [c for c in confounders if isinstance(df.schema[c].dataType, T.NumericType)]
    strata, added = [], {}
    edges = {}
    if numeric:
        probabilities = {f"q{i}": i / bins for i in range(1, bins)}
        for row in exact_quantiles(df, numeric, probabilities).collect():
            edges[row["column"]] = sorted({row[f"q{i}"] for i in range(1, bins)})
    for c in confounders:
        if c not in numeric:
            strata.append(c)
            continue
        borders = [float("-inf"), *edges.get(c, []), float("inf")]
        names = [str(i) for i in range(len(borders) - 1)]
        added[f"{c}_bin"] = cut(F.col(c).cast("double"), borders, names)
        strata.append(f"{c}_bin")
    return df.withColumns(added) if added else df, strata


def _verdict(df: DataFrame, keep: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Interval, p-value and verdict from ``effect`` and ``variance``."""
    error = F.sqrt("variance")
    p = normal_two_sided(F.try_divide(F.col("effect"), error))
    return df.select(
        *keep,
        F.col("effect").alias("Estimated_Effect"),
        (F.col("effect") - Z_95 * error).alias("CI_Lower"),
        (F.col("effect") + Z_95 * error).alias("CI_Upper"),
        p.alias("P_Value"),
        F.coalesce(p < ALPHA, F.lit(False)).alias("Significant"),
        *extra,
    )


def _stratum_cells(
    df: DataFrame, treatment: str, outcome: str, strata: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Size, mean and variance of both arms per stratum: one shuffle, combined ahead of it."""
    y = outcome_value(df, outcome).cast("double")
    arms = {"1": F.col(treatment) == 1, "0": F.col(treatment) == 0}
    return (
        _known(df, treatment, outcome, *strata)
        .groupBy(*by, *strata)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(arm).alias(f"n{a}") for a, arm in arms.items()],
            *[F.avg(F.when(arm, y)).alias(f"m{a}") for a, arm in arms.items()],
            *[F.var_samp(F.when(arm, y)).alias(f"v{a}") for a, arm in arms.items()],
        )
    )


def _squared_error(weight: Column, total: Column, arms: Sequence[tuple[str, str]]) -> Column:
    """Aggregate: variance of a weighted mean of differences, from columns (rows, variance) of each arm.

    An arm of one row has no variance of its own; it takes the pooled one of the other arms. Where no
    arm has two rows the result is null, so nothing is called significant.
    """
    square = weight.cast("double") * weight
    own = sum((F.coalesce(F.try_divide(F.col(v), F.col(n)), F.lit(0.0)) for n, v in arms), F.lit(0.0))
    single = sum(((F.col(n) == 1).cast("int") for n, _ in arms), F.lit(0))
    spread = sum((F.coalesce((F.col(n) - 1) * F.col(v), F.lit(0.0)) for n, v in arms), F.lit(0.0))
    freedom = sum((F.greatest(F.col(n) - 1, F.lit(0)) for n, _ in arms), F.lit(0))
    counted = weight.isNotNull()
    pooled = F.try_divide(F.sum(F.when(counted, spread)), F.sum(F.when(counted, freedom)))
    borrowed = F.sum(square * single)
    summed = F.sum(square * own) + F.when(borrowed > 0, pooled * borrowed).otherwise(0.0)
    return F.try_divide(summed, total.cast("double") * total)


def _combine_strata(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted effect over the strata that hold both arms."""
    overlap = (F.col("n1") > 0) & (F.col("n0") > 0)
    weight = F.when(overlap, F.col("n"))
    effect = F.col("m1") - F.col("m0")
    total = F.sum(weight)
    return cells.groupBy(*by).agg(
        F.try_divide(F.sum(weight * effect), total).alias("effect"),
        _squared_error(weight, total, [("n1", "v1"), ("n0", "v0")]).alias("variance"),
        F.count_if(overlap).alias("strata_used"),
        F.coalesce(total, F.lit(0)).alias("rows_used"),
        F.sum("n").alias("rows_total"),
    )


def stratified_effect(
    df: DataFrame, treatment: str, outcome: str, strata: Sequence[str]
) -> DataFrame:
    """Adjusted effect of a 0/1 treatment: stratum differences weighted by stratum size.

    Strata with one arm only have no difference; ``rows_used`` against ``rows_total`` shows how
    much of the table the estimate speaks for.
    """
    combined = _combine_strata(_stratum_cells(df, treatment, outcome, strata))
    return _verdict(combined, [], ["strata_used", "rows_used", "rows_total"])


def level_contrasts(
    df: DataFrame, treatment: str, outcome: str, reference: str, strata: Sequence[str] = ()
) -> DataFrame:
    """Effect of every level of a text treatment against the reference level.

    Without strata this is the difference in means; with strata the differences are taken inside
    each stratum and weighted by its rows of the two levels.
    """
    strata = list(strata)
    y = F.col(outcome).cast("double")
    cells = (
        _known(df, treatment, outcome, *strata)
        .groupBy(*strata, F.col(treatment).alias("level"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("m"),
            F.var_samp(y).alias("v"),
        )
    )
    base = cells.where(F.col("level") == reference).select(
        *strata, *[F.col(c).alias(f"ref_{c}") for c in ("n", "m", "v")]
    )
    others = cells.where(F.col("level") != reference)
    # Without strata the reference is a single row.
    paired = others.join(base, strata) if strata else others.crossJoin(F.broadcast(base))
    weight = F.col("n") + F.col("ref_n")
    total = F.sum(weight)
    combined = paired.groupBy("level").agg(
        F.try_divide(F.sum(weight * (F.col("m") - F.col("ref_m"))), total).alias("effect"),
        _squared_error(weight, total, [("n", "v"), ("ref_n", "ref_v")]).alias("variance"),
        total.alias("rows_used"),
    )
    named = combined.withColumns(
        {"Treatment": F.lit(treatment), "Level": F.col("level"), "Reference": F.lit(reference)}
    )
    return _verdict(named, ["Treatment", "Level", "Reference"], ["rows_used"])


def propensity_model(
    df: DataFrame, treatment: str, confounders: Sequence[str], regularization: float = 0.0
):
    """Fitted logistic model of a 0/1 treatment on the confounders."""
    numeric = [c for c in confounders if isinstance(df.schema[c].dataType, T.NumericType)]
    text = [c for c in confounders if c not in numeric]
    stages = []
    inputs = list(numeric)
    if text:
        indexed = [f"__{c}_index" for c in text]
        coded = [f"__{c}_code" for c in text]
        stages += [
            StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=coded),
        ]
        inputs += coded
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="__confounders", handleInvalid="skip"),
        LogisticRegression(
            featuresCol="__confounders", labelCol=treatment, regParam=regularization,
            probabilityCol="__propensity", rawPredictionCol="__raw", predictionCol="__decision",
        ),
    ]
    return Pipeline(stages=stages).fit(_known(df, treatment, *confounders))


def with_propensity(df: DataFrame, treatment: str, confounders: Sequence[str]) -> DataFrame:
    """Add ``propensity``: the modelled chance of being treated. Rows without confounders drop."""
    model = propensity_model(df, treatment, confounders)
    scored = model.transform(_known(df, treatment, *confounders))
    return scored.withColumn("propensity", vector_to_array("__propensity")[1]).drop(
        *[c for c in scored.columns if c.startswith("__")]
    )


def weighted_effect(
    df: DataFrame, treatment: str, outcome: str, propensity: str = "propensity", clip: float = 0.01
) -> DataFrame:
    """Inverse-propensity effect with normalised weights: one global aggregate."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    p = F.least(F.greatest(F.col(propensity), F.lit(clip)), F.lit(1 - clip))
    weighed = _known(df, treatment, outcome, propensity).select(
        y.alias("y"), (t / p).alias("w1"), ((1 - t) / (1 - p)).alias("w0")
    )
    sums = weighed.agg(
        F.count(F.lit(1)).alias("rows_used"),
        *[
            f
            for a in ("1", "0")
            for f in (
                F.sum(f"w{a}").alias(f"s{a}"),
                F.sum(F.col(f"w{a}") * F.col("y")).alias(f"sy{a}"),
                F.sum(F.col(f"w{a}") * F.col(f"w{a}")).alias(f"q{a}"),
                F.sum(F.col(f"w{a}") * F.col(f"w{a}") * F.col("y")).alias(f"qy{a}"),
                F.sum(F.col(f"w{a}") * F.col(f"w{a}") * F.col("y") * F.col("y")).alias(f"qyy{a}"),
            )
        ],
    )
    means = {a: F.try_divide(F.col(f"sy{a}"), F.col(f"s{a}")) for a in ("1", "0")}
    # Variance of a ratio of sums: sum of w^2 (y - mean)^2 over (sum of w)^2, per arm.
    variance = sum(
        F.try_divide(
            F.col(f"qyy{a}") - 2 * means[a] * F.col(f"qy{a}") + means[a] * means[a] * F.col(f"q{a}"),
            F.col(f"s{a}") * F.col(f"s{a}"),
        )
        for a in ("1", "0")
    )
    estimated = sums.select(
        (means["1"] - means["0"]).alias("effect"), variance.alias("variance"), "rows_used"
    )
    return _verdict(estimated, [], ["rows_used"])


def _merged_scores(df: DataFrame, treatment: str, outcome: str, propensity: str) -> DataFrame:
    """One row per distinct score: both arms, its range, its controls as ``here``, and the nearest controls
    beyond the range as ``lower`` and ``upper``.
    """
    cuts = value_splits(df, [propensity], SCORE_BUCKETS)[propensity]
    y = F.col(outcome).cast("double")
    treated, control = F.col(treatment) == 1, F.col(treatment) == 0
    scores = (
        _known(df, treatment, outcome, propensity)
        .groupBy(F.col(propensity).alias("score"))
        .agg(
            F.count_if(treated).alias("treated"),
            F.avg(F.when(treated, y)).alias("treated_mean"),
            F.coalesce(F.var_samp(F.when(treated, y)), F.lit(0.0)).alias("treated_variance"),
            F.count_if(control).alias("controls"),
            F.sum(F.when(control, y)).alias("control_sum"),
            F.var_samp(F.when(control, y)).alias("control_variance"),
        )
        .withColumn("bucket", range_bucket(F.col("score"), double_array(cuts), SCORE_BUCKETS))
        .withColumn(
            "here",
            F.when(F.col("controls") > 0, F.struct("score", "controls", "control_sum")),
        )
    )
    ranges = scores.groupBy("bucket").agg(F.min("here").alias("first"), F.max("here").alias("last"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    # At most 1024 rows in these two windows.
    borders = ranges.select(
        "bucket", F.max("last").over(before).alias("lower"), F.min("first").over(after).alias("upper")
    )
    return scores.join(borders, "bucket")


def _side(last: int, down: bool = False) -> WindowSpec:
    """Scores of a range from one end up to the current one."""
    order = F.desc("score") if down else F.col("score")
    return Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def nearest_controls(
    df: DataFrame, treatment: str, outcome: str, propensity: str = "propensity", caliper: float = 0.05
) -> DataFrame:
    """For every distinct treated score the nearest control score within the caliper.

    Controls are reused. All controls at the nearest distance count, on either side, so the result
    does not depend on row order. Rows with equal scores are merged first. Score ranges, cut where
    they split the rows evenly, are searched on their own; the nearest control beyond a range comes
    from a table with one row per range. ``used`` lists the control scores that count.
    """
    return _nearest(_merged_scores(df, treatment, outcome, propensity), caliper)


def _nearest(scores: DataFrame, caliper: float) -> DataFrame:
    candidates = (
        scores.withColumn("below", F.coalesce(F.max("here").over(_side(0)), F.col("lower")))
        .withColumn("above", F.coalesce(F.min("here").over(_side(0, down=True)), F.col("upper")))
        .where(F.col("treated") > 0)
    )
    gap_below = F.col("score") - F.col("below.score")
    gap_above = F.col("above.score") - F.col("score")
    distance = F.least(gap_below, gap_above)
    use_below = F.coalesce(gap_below == F.col("distance"), F.lit(False))
    # At distance 0 both sides are the same control score; count it once.
    use_above = F.coalesce(gap_above == F.col("distance"), F.lit(False)) & (
        ~use_below | (F.col("distance") > 0)
    )

    def used(field):
        return F.when(use_below, F.col(f"below.{field}")).otherwise(0) + F.when(
            use_above, F.col(f"above.{field}")
        ).otherwise(0)

    return (
        candidates.withColumn("distance", distance)
        .where(F.col("distance") <= caliper)
        .select(
            "score", "treated", "treated_mean", "treated_variance", "distance",
            F.when(use_below, F.col("below.score")).otherwise(F.col("above.score")).alias("control_score"),
            used("controls").alias("controls"),
            F.try_divide(used("control_sum"), used("controls")).alias("control_mean"),
            F.array_compact(
                F.array(
                    F.when(use_below, F.col("below.score")), F.when(use_above, F.col("above.score"))
                )
            ).alias("used"),
        )
    )


def _control_variances(scores: DataFrame) -> DataFrame:
    """Outcome variance at every control score.

    A score with one control takes it from its squared distance to the mean of the nearest other control score,
    divided by the variance that this distance has for a unit variance of the outcome.
    """
    sides = scores.withColumns(
        {
            "under": F.coalesce(F.max("here").over(_side(-1)), F.col("lower")),
            "over": F.coalesce(F.min("here").over(_side(-1, down=True)), F.col("upper")),
        }
    )
    nearer = F.col("score") - F.col("under.score") <= F.col("over.score") - F.col("score")
    other = F.when(F.col("over").isNull() | nearer, F.col("under")).otherwise(F.col("over"))
    gap = F.col("control_sum") - F.col("other.control_sum") / F.col("other.controls")
    neighbour = gap * gap / (1 + 1 / F.col("other.controls"))
    return (
        sides.where(F.col("controls") > 0)
        .withColumn("other", other)
        .select(
            F.col("score").alias("control_score"), F.col("controls").alias("control_rows"),
            F.when(F.col("controls") > 1, F.col("control_variance")).otherwise(neighbour).alias("control_variance"),
        )
    )


def matched_effect(
    df: DataFrame, treatment: str, outcome: str, propensity: str = "propensity", caliper: float = 0.05
) -> DataFrame:
    """Effect on the treated by nearest-score matching with replacement.

    The variance has two parts: the spread of treated outcomes around their matched mean and the effect, and for
    every control its outcome variance times its use, the square of its summed weights less the sum of their squares. A
    control that stands for many treated rows thus widens the interval. The variance is null if any use has no
    outcome variance, as with a single control row in the whole table.
    """
    scores = _merged_scores(df, treatment, outcome, propensity)
    pairs = _nearest(scores, caliper)
    gap = F.col("treated_mean") - F.col("control_mean")
    n = F.col("treated")
    sums = pairs.agg(
        F.sum(n).alias("rows_used"),
        F.sum(n * gap).alias("s"),
        F.sum(n * gap * gap).alias("ss"),
        F.sum((n - 1) * F.col("treated_variance")).alias("inner"),
        F.avg("distance").alias("mean_distance"),
    )
    uses = (
        pairs.select(
            F.explode("used").alias("control_score"),
            (n / F.col("controls")).alias("weight"),
            (n / F.col("controls") / F.col("controls")).alias("square"),
        )
        .groupBy("control_score")
        .agg(F.sum("weight").alias("weight"), F.sum("square").alias("square"))
        .join(_control_variances(scores), "control_score")
    )
    # A control used once by one row adds nothing beyond what the first part holds.
    excess = F.col("weight") * F.col("weight") - F.col("square")
    excess = F.when(excess > 1e-12 * F.col("square"), excess).otherwise(0.0)
    part = F.when(excess == 0, 0.0).otherwise(F.col("control_rows") * excess * F.col("control_variance"))
    reused = uses.agg(F.when(F.count_if(part.isNull()) == 0, F.sum(part)).alias("reused"))
    sums = sums.crossJoin(F.broadcast(reused))
    effect = F.try_divide(F.col("s"), F.col("rows_used"))
    spread = F.greatest(F.col("ss") - F.col("s") * effect, F.lit(0.0))
    variance = F.try_divide(spread + F.col("inner") + F.col("reused"), F.col("rows_used") * F.col("rows_used"))
    estimated = sums.select(
        effect.alias("effect"), variance.alias("variance"), "rows_used", "mean_distance"
    )
    return _verdict(estimated, [], ["rows_used", "mean_distance"])


def match_treated(
    df: DataFrame, key: str, treatment: str, outcome: str, propensity: str = "propensity",
    caliper: float = 0.05,
) -> DataFrame:
    """Every treated row with the score and mean outcome of its nearest controls.

    The join key is the score, and one score may belong to a third of all rows, so treated rows are
    spread over salts and the (one row per score) match table is repeated per salt.
    """
    matches = nearest_controls(df, treatment, outcome, propensity, caliper).select(
        F.col("score").alias("propensity"), "distance", "control_score", "controls", "control_mean"
    )
    salted = matches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    treated = _known(df, treatment, outcome, propensity).where(F.col(treatment) == 1)
    rows = treated.select(
        key, F.col(outcome).alias("outcome"), F.col(propensity).alias("propensity"),
        F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return rows.join(salted, ["propensity", "salt"]).drop("salt")


def analyze_treatment_effect(
    df: DataFrame,
    treatment: str,
    outcome: str,
    confounders: Sequence[str],
    methods: Sequence[str] = ("unadjusted", "stratified", "weighted", "matched"),
) -> DataFrame:
    """Effect of a 0/1 treatment by each method: estimate, interval, p-value and verdict."""
    columns = ["Estimated_Effect", "CI_Lower", "CI_Upper", "P_Value", "Significant"]
    parts = []
    scored = None
    if {"weighted", "matched"} & set(methods):
        scored = with_propensity(df, treatment, confounders)
    for method in methods:
        if method == "unadjusted":
            result = stratified_effect(df, treatment, outcome, [])
        elif method == "stratified":
            binned, strata = bin_confounders(df, confounders)
            result = stratified_effect(binned, treatment, outcome, strata)
        elif method == "weighted":
            result = weighted_effect(scored, treatment, outcome)
        elif method == "matched":
            result = matched_effect(scored, treatment, outcome)
        else:
            raise ValueError(f"unknown method {method}")
        parts.append(
            result.select(F.lit(treatment).alias("Treatment"), F.lit(method).alias("Method"), *columns)
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def positivity(df: DataFrame, treatment: str, strata: Sequence[str]) -> DataFrame:
    """Per stratum: rows, treatment levels that occur, and whether all levels occur."""
    cells = (
        _known(df, treatment, *strata)
        .groupBy(*strata, treatment)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = cells.agg(F.count_distinct(treatment).alias("all_levels"))
    per_stratum = cells.groupBy(*strata).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels_present")
    )
    return per_stratum.crossJoin(F.broadcast(levels)).withColumn(
        "positive", F.col("levels_present") == F.col("all_levels")
    )


def placebo_effect(
    df: DataFrame, treatment: str, outcome: str, strata: Sequence[str], key: str,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Refuter: the treatment is dealt out anew at random to as many rows as before.

    A sound effect shrinks to about 0. The new treatment is a hash comparison, not a shuffle.
    """
    known = _known(df, treatment, outcome, *strata)
    share = known.agg(F.avg(F.col(treatment).cast("double"))).first()[0] or 0.0
    dealt = known.withColumn(treatment, assign_share(known, share, key, seed))
    return stratified_effect(dealt, treatment, outcome, strata)


def subset_effects(
    df: DataFrame, treatment: str, outcome: str, strata: Sequence[str], key: str, subsets: int = 5,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Refuter: the estimate in each of several disjoint random subsets, from one aggregation."""
    number = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(subsets)).cast("int")
    cells = _stratum_cells(df.withColumn("subset", number), treatment, outcome, strata, ["subset"])
    return _verdict(_combine_strata(cells, ["subset"]), ["subset"], ["rows_used"])


def stability(effects: DataFrame, limit: float = 0.05) -> DataFrame:
    """Range of estimates across scenarios; below the limit counts as robust."""
    return effects.agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.min("Estimated_Effect").alias("lowest"),
        F.max("Estimated_Effect").alias("highest"),
    ).select(
        "*",
        (F.col("highest") - F.col("lowest")).alias("effect_range"),
        (F.col("highest") - F.col("lowest") < limit).alias("robust"),
    )


def confounder_sensitivity(
    df: DataFrame, treatment: str, outcome: str, strata: Sequence[str], key: str,
    strengths: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), seed: int = RANDOM_SEED,
) -> DataFrame:
    """Refuter: the estimate after adjusting for an invented common cause of given strength.

    The invented 0/1 confounder follows treatment and outcome with probability growing with the
    strength; at 0 it is noise. Rows are repeated per strength but combined before the shuffle.
    """
    known = _known(df, treatment, outcome, *strata)
    uniform = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    lean = (F.col(treatment).cast("double") + F.col(outcome).cast("double") - 1) / 2
    grid = F.array(*[F.lit(float(s)) for s in strengths])
    invented = (
        known.select(key, treatment, outcome, *strata)
        .withColumn("strength", F.explode(grid))
        .withColumn("__u", (uniform < 0.5 + F.col("strength") * lean).cast("int"))
    )
    cells = _stratum_cells(invented, treatment, outcome, [*strata, "__u"], ["strength"])
    return _verdict(_combine_strata(cells, ["strength"]), ["strength"], ["rows_used"])


def policy_scenarios(
    df: DataFrame, outcome: str, scenarios: DataFrame, effect_per_shift: float = 0.15,
    value_per_customer: float = 500.0,
) -> DataFrame:
    """What a shift of customers between contract types would do to churn, cost and value.

    ``scenarios`` has ``current_percent, target_percent, incentive_cost``; the customer table only
    contributes its churn rate and size (one row).
    """
    base = df.agg(F.avg(outcome).alias("baseline_churn"), F.count(F.lit(1)).alias("customers"))
    shift = (F.col("current_percent") - F.col("target_percent")) / 100
    return (
        scenarios.crossJoin(F.broadcast(base))
        .withColumn("new_churn", F.col("baseline_churn") * (1 - shift * effect_per_shift))
        .withColumn("customers_affected", F.col("customers") * shift)
        .withColumn("total_cost", F.col("customers_affected") * F.col("incentive_cost"))
        .withColumn("churn_reduction", F.col("baseline_churn") - F.col("new_churn"))
        .withColumn(
            "value_saved", F.col("churn_reduction") * F.col("customers") * value_per_customer
        )
        .withColumn(
            "roi",
            F.when(
                F.col("total_cost") > 0,
                F.try_divide(F.col("value_saved") - F.col("total_cost"), F.col("total_cost")),
            ),
        )
        .withColumn("recommended", F.col("value_saved") > F.col("total_cost"))
    )
