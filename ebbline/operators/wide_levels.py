"""Level numbers of text columns with any number of levels, as a saved table joined by value.

The levels never reach the driver. They are numbered in the order of their text without a global sort:
a bounded sample of levels gives range borders, ranges are counted, and rows are numbered inside ranges.
The borders only balance work: numbers do not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.session import shared_folder

#: Range borders per column: what the driver sees of its levels.
BORDERS = 256
LEVELS_SCHEMA = "column string, value string, position bigint"


def number_levels(levels: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """``column, value, position`` and the number of levels per column, for distinct ``column, value``.

    Positions count from 0 in the order of the value's bytes. The result is a table in the shared folder.
    """
    spark = levels.sparkSession
    path = shared_folder(spark)
    levels.select("column", "value").write.parquet(f"{path}/found")
    found = spark.read.schema("column string, value string").parquet(f"{path}/found")
    ranges = F.lit(0)
    for c in columns:
        own = found.where(F.col("column") == c).orderBy(F.xxhash64("value"), "value").limit(BORDERS)
        borders = F.array(*[F.lit(r["value"]) for r in own.collect()]).cast("array<string>")
        below = F.size(F.filter(borders, lambda b: b <= F.col("value")))
        ranges = F.when(F.col("column") == c, below).otherwise(ranges)
    ranged = found.withColumn("range", ranges)
    counts = ranged.groupBy("column", "range").agg(F.count(F.lit(1)).alias("n"))
    # A column has at most BORDERS + 1 ranges.
    earlier = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = starts.select("column", "range", "start", "n").collect()
    sizes = [sum(r["n"] for r in starts if r["column"] == c) for c in columns]
    start_table = spark.createDataFrame([tuple(r)[:3] for r in starts], "column string, range int, start bigint")
    inside = Window.partitionBy("column", "range").orderBy("value")
    numbered = ranged.withColumn("inside", F.row_number().over(inside) - 1)
    numbered = numbered.join(F.broadcast(start_table), ["column", "range"])
    numbered.select("column", "value", (F.col("start") + F.col("inside")).alias("position")).write.parquet(f"{path}/levels")
    return spark.read.schema(LEVELS_SCHEMA).parquet(f"{path}/levels"), sizes


class WideLevels(Model, MLWritable, MLReadable):
    """Adds ``idx_<column>`` for every ``txt_<column>``: the level's number, or the number of levels if it is unknown.

    Each column is one left join with its part of the level table. Spark broadcasts the part where its
    size allows and sorts otherwise; adaptive execution splits the rows of a hot level.
    """

    columns = Param(Params._dummy(), "columns", "text columns", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "levels per column", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, sizes: list[int] | None = None):
        super().__init__()
        self.levels: DataFrame | None = None
        self._set(**self._input_kwargs)

    def sized(self) -> dict[str, int]:
        return dict(zip(self.getOrDefault(self.columns), self.getOrDefault(self.sizes)))

    def of_column(self, column: str) -> DataFrame:
        """``value, position`` of one column."""
        return self.levels.where(F.col("column") == column).select("value", "position")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c, size in self.sized().items():
            level, found = f"level_{c}", f"idx_{c}"
            own = self.of_column(c).select(F.col("value").alias(level), F.col("position").cast("double").alias(found))
            dataset = dataset.join(own, dataset[f"`txt_{c}`"] == own[f"`{level}`"], "left").drop(level)
            dataset = dataset.withColumn(found, F.coalesce(F.col(f"`{found}`"), F.lit(float(size))))
        return dataset

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: WideLevels):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.levels.write.parquet(f"{path}/levels")


class _Reader(MLReader):
    def load(self, path: str) -> WideLevels:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = WideLevels()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.levels = self.sparkSession.read.schema(LEVELS_SCHEMA).parquet(f"{path}/levels")
        return stage
