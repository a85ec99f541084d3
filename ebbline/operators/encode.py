"""Encoding of the customer table into a feature vector, as one saveable ``pyspark.ml`` pipeline.

Cleaning, fills and scaling are SQL projections with the fitted constants written into them, so
scoring is a narrow map over the input and accepts raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.config import ROLES, ColumnRoles
from ebbline.operators.clean import clean
from ebbline.operators.effects import anova_from_classes, select_k_best
from ebbline.operators.frequency import level_counts
from ebbline.operators.ordered import exact_medians, splits_of
from ebbline.operators.wide_levels import WideLevels, number_levels

FEATURES = "features"
MAX_LEVELS = 1000


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number_sql(name: str) -> str:
    """Raw numeric column as a double, null when it is no number; a missing total is 0."""
    number = f"nanvl(try_cast(trim(cast({_quoted(name)} as string)) as double), null)"
    return f"coalesce({number}, 0D)" if name == "TotalCharges" else number


def _fitted_constants(df: DataFrame, roles: ColumnRoles) -> dict[str, tuple[float, float, float]]:
    """Median, mean after filling and population deviation (1 when it is 0) per numeric column.

    Two passes: one aggregate, which also finds range borders, and the medians. Mean and deviation after filling follow from the moments of the known values and the median.
    """
    numbers = {c: F.expr(_number_sql(c)) for c in roles.numeric}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            f
            for c, x in numbers.items()
            for f in (
                F.count(x).alias(f"{c}:known"),
                F.avg(x).alias(f"{c}:mean"),
                F.var_pop(x).alias(f"{c}:variance"),
                splits_of(x).alias(f"{c}:splits"),
            )
        ],
    ).first()
    splits = {c: sorted(set(row[f"{c}:splits"] or [])) for c in numbers}
    medians = exact_medians(df.select(*[x.alias(c) for c, x in numbers.items()]), list(numbers), splits)
    constants = {}
    for c in numbers:
        n, known, median = row["rows"], row[f"{c}:known"], medians.get(c, 0.0)
        if not known:
            constants[c] = (median, median, 1.0)
            continue
        mean_known = row[f"{c}:mean"]
        mean = (known * mean_known + (n - known) * median) / n
        variance = (
            known * (row[f"{c}:variance"] + (mean_known - mean) ** 2)
            + (n - known) * (median - mean) ** 2
        ) / n
        constants[c] = (median, mean, variance**0.5 or 1.0)
    return constants


def _levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` of the filled text columns, from one pass over all."""
    filled = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in columns]
    )
    return level_counts(filled, columns)


def _level_table(df: DataFrame, columns_read: Sequence[str], most: int) -> DataFrame:
    """A small table in which every level of the text columns occurs.

    The bound keeps keys and free text out: the levels all travel to the driver.
    """
    bound = most * len(columns_read)
    rows = _levels(df, columns_read).limit(bound + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in columns_read}
    for r in rows:
        found[r["column"]].append(r["value"])
    wide = [c for c, levels in found.items() if len(levels) > most]
    if wide or len(rows) > bound:
        raise ValueError(f"too many levels to encode one by one, wide=True joins them by value: {', '.join(wide)}")
    columns = [found[c] or ["missing"] for c in columns_read]
    longest = max(map(len, columns))
    # Shorter columns repeat their last level; the indexer orders levels by text, not by count.
    cells = [tuple(levels[min(i, len(levels) - 1)] for levels in columns) for i in range(longest)]
    schema = ", ".join(f"{_quoted('txt_' + c)} string" for c in columns_read)
    return df.sparkSession.createDataFrame(cells, schema).coalesce(1)


def _wide_stages(df: DataFrame, columns: Sequence[str]) -> list:
    """Stages that number the levels of wide columns by a join and turn the numbers into vectors."""
    if not columns:
        return []
    table, sizes = number_levels(_levels(df, columns), columns)
    numbered = WideLevels(columns=list(columns), sizes=sizes)
    numbered.levels = table
    # The encoder needs the number of levels only: one row with the last number of each column.
    schema = ", ".join(f"{_quoted('idx_' + c)} double" for c in columns)
    last = df.sparkSession.createDataFrame([tuple(float(n - 1) for n in sizes)], schema)
    onehot = OneHotEncoder(
        inputCols=[f"idx_{c}" for c in columns],
        outputCols=[f"hot_{c}" for c in columns],
        handleInvalid="keep",
        dropLast=True,
    )
    return [numbered, onehot.fit(last)]


def fit_encoder(
    df: DataFrame, roles: ColumnRoles = ROLES, wide: bool = False, max_levels: int = MAX_LEVELS
) -> PipelineModel:
    """Fit on raw or cleaned rows; pass the train rows only, unless leakage is wanted.

    Numerics are filled with their median and scaled to mean 0 and population deviation 1. Texts
    become one column per level in alphabetical order; a missing text is the level 'missing' and
    an unknown level is all zeros.

    The levels of a column travel with the model as a list, up to max_levels of them; more are refused, as
    they mostly mean a key or free text among the features. With ``wide`` the levels of such columns are a
    table of the model instead, joined by value, of any size; vectors and their order are the same.
    """
    narrow = list(roles.categorical)
    if wide:
        counts = _levels(df, roles.categorical).groupBy("column").count().collect()
        many = {r["column"] for r in counts if r["count"] > max_levels}
        narrow = [c for c in roles.categorical if c not in many]
    constants = _fitted_constants(df, roles)
    numeric = [
        f"(coalesce({_number_sql(c)}, {median!r}D) - {mean!r}D) / {scale!r}D AS {_quoted('num_' + c)}"
        for c, (median, mean, scale) in constants.items()
    ]
    texts = [
        f"coalesce(cast({_quoted(c)} as string), 'missing') AS {_quoted('txt_' + c)}"
        for c in roles.categorical
    ]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(numeric + texts)} FROM __THIS__")
    stages = [prepare]
    if narrow:
        indexer = StringIndexer(
            inputCols=[f"txt_{c}" for c in narrow],
            outputCols=[f"idx_{c}" for c in narrow],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        )
        # 'keep' gives unknown levels the last index, and dropLast turns that index into zeros.
        onehot = OneHotEncoder(
            inputCols=[f"idx_{c}" for c in narrow],
            outputCols=[f"hot_{c}" for c in narrow],
            dropLast=True,
        )
        stages += [indexer.fit(_level_table(df, narrow, max_levels)), onehot]
    stages += _wide_stages(df, [c for c in roles.categorical if c not in narrow])
    assemble = VectorAssembler(
        inputCols=[f"num_{c}" for c in roles.numeric] + [f"hot_{c}" for c in roles.categorical],
        outputCol=FEATURES,
    )
    helpers = [f"num_{c}" for c in roles.numeric]
    helpers += [f"{p}_{c}" for c in roles.categorical for p in ("txt", "idx", "hot")]
    tidy = SQLTransformer(
        statement=f"SELECT * EXCEPT ({', '.join(map(_quoted, helpers))}) FROM __THIS__"
    )
    return Pipeline(stages=[*stages, assemble, tidy]).fit(df)


def _listed_levels(encoder: PipelineModel) -> dict[str, list[str]]:
    """Levels of the columns whose levels travel with the model."""
    return {
        name.removeprefix("txt_"): list(labels)
        for s in encoder.stages
        if isinstance(s, StringIndexerModel)
        for name, labels in zip(s.getInputCols(), s.labelsArray)
    }


def _wide_levels(encoder: PipelineModel) -> WideLevels | None:
    return next((s for s in encoder.stages if isinstance(s, WideLevels)), None)


def feature_names(encoder: PipelineModel, roles: ColumnRoles = ROLES) -> list[str]:
    """Names of the vector's entries: numerics, then ``column_level``.

    An encoder with wide columns has `feature_table` instead: its names are not gathered.
    """
    if _wide_levels(encoder):
        raise ValueError("the names of wide columns are a table: use feature_table")
    listed = _listed_levels(encoder)
    return list(roles.numeric) + [f"{c}_{level}" for c in roles.categorical for level in listed[c]]


def feature_table(encoder: PipelineModel, spark: SparkSession, roles: ColumnRoles = ROLES) -> DataFrame:
    """``position, feature`` of the vector's entries, for any number of levels."""
    listed, stage = _listed_levels(encoder), _wide_levels(encoder)
    sizes = stage.sized() if stage else {}
    rows, parts = list(enumerate(roles.numeric)), []
    start = len(rows)
    for c in roles.categorical:
        if c in sizes:
            position = (F.col("position") + F.lit(start)).alias("position")
            parts.append(stage.of_column(c).select(position, F.concat(F.lit(f"{c}_"), "value").alias("feature")))
            start += sizes[c]
        else:
            rows += [(start + i, f"{c}_{level}") for i, level in enumerate(listed[c])]
            start += len(listed[c])
    table = spark.createDataFrame(rows, "position bigint, feature string")
    return reduce(DataFrame.unionByName, parts, table)


def nonzero_features(encoded: DataFrame, key: str = ROLES.key) -> DataFrame:
    """One row per customer and entry of the vector that is not 0: ``position, value``."""
    vector = F.unwrap_udt(FEATURES)
    dense = F.transform(
        vector["values"], lambda x, i: F.struct(i.alias("position"), x.alias("value"))
    )
    sparse = F.transform(
        vector["indices"], lambda p, i: F.struct(p.alias("position"), F.get(vector["values"], i).alias("value"))
    )
    entries = F.when(vector["type"] == 0, sparse).otherwise(dense)
    rows = encoded.select(key, F.inline(F.filter(entries, lambda e: e["value"] != 0)))
    return rows.withColumn("position", F.col("position").cast("bigint"))


def source_column(feature: str, roles: ColumnRoles = ROLES) -> str:
    """The table column an encoded feature comes from."""
    if feature in roles.numeric:
        return feature
    owners = [c for c in roles.categorical if feature.startswith(f"{c}_")]
    return max(owners, key=len) if owners else feature


def encode(encoder: PipelineModel, df: DataFrame, roles: ColumnRoles = ROLES) -> DataFrame:
    """Key, 0/1 label (when present) and the feature vector."""
    coded = clean(encoder.transform(df), roles)
    label = [F.col(roles.target).alias("label")] if roles.target in df.columns else []
    return coded.select(roles.key, *label, FEATURES)


def long_features(encoded: DataFrame, names: Sequence[str], key: str = ROLES.key) -> DataFrame:
    """One row per customer and encoded feature."""
    texts = F.array(*[F.lit(n) for n in names])
    return encoded.select(
        key, F.posexplode(vector_to_array(FEATURES)).alias("i", "value")
    ).select(key, texts[F.col("i")].alias("feature"), "value")


def anova_of_vector(encoded: DataFrame, names: Sequence[str]) -> DataFrame:
    """F test of every vector entry against the label from one pass of vector summaries."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col(FEATURES))
    classes = encoded.groupBy("label").agg(summary.alias("s"))
    texts = F.array(*[F.lit(n) for n in names])
    rows = classes.select(
        "label",
        F.col("s.count").alias("n"),
        F.posexplode(
            F.arrays_zip(
                vector_to_array("s.mean").alias("mean"),
                vector_to_array("s.variance").alias("variance"),
            )
        ).alias("i", "cell"),
    )
    return anova_from_classes(
        rows.select(
            texts[F.col("i")].alias("feature"),
            "n",
            F.col("cell.mean").alias("mean"),
            # The summary has the sample variance; the test wants the population one.
            (F.col("cell.variance") * (F.col("n") - 1) / F.col("n")).alias("variance"),
        )
    )


def select_features(
    encoded: DataFrame, names: Sequence[str], k: int = 20
) -> tuple[DataFrame, list[str], DataFrame]:
    """Keep the k features with the highest F score; returns table, names kept, all scores."""
    scores = anova_of_vector(encoded, names)
    chosen = {r["feature"] for r in select_k_best(scores, k).collect()}
    kept = [n for n in names if n in chosen]
    slicer = VectorSlicer(
        inputCol=FEATURES, outputCol="selected", indices=[names.index(n) for n in kept]
    )
    return slicer.transform(encoded), kept, scores
