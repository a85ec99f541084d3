"""Wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_columns(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per column: ``ids, name, value``; the columns must share a type.

    Same result as ``unpivot``. It is written as a generator because Spark does not recognise two
    equal plans with an unpivot in them, so a table used twice would be scanned and shuffled twice.
    """
    cells = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    return df.select(*ids, F.inline(F.array(*cells)))
