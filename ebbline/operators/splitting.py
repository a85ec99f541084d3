"""Seeded samples, train/test splits and folds that are exact to the row without a global sort.

Rows are ordered by a hash of their key. A split then is a comparison with border hashes: the
borders are found from hash-bucket counts (bounded size), which are refined by further hash bits until
the bucket of a border is small, plus the rows of that bucket. The split itself is a narrow projection of the full table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import FOLDS, RANDOM_SEED, ROLES, TEST_SHARE

HASH_BITS = 12
#: Rows of a border's bucket from which it is counted by further hash bits rather than ordered.
ROWS_PER_BUCKET = 100_000
MAX_CLASSES = 100


def _hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def _prefix(h: Column, bits: int) -> Column:
    """Top bits of the hash; the shift keeps the sign, so prefixes follow the hash order."""
    return F.shiftright(h, 64 - bits)


def _place(counts: dict[int, int], rank: int) -> tuple[int, int, int] | None:
    """Bucket that holds a rank, the rank inside it and its rows; None if there is no such rank."""
    if rank < 1:
        return None
    for bucket in sorted(counts):
        if rank <= counts[bucket]:
            return bucket, rank, counts[bucket]
        rank -= counts[bucket]
    return None


def _borders(
    df: DataFrame, key: str, seed: int, by: str, ranks_of: Callable[[int], Sequence[int]]
) -> dict:
    """For every class the ``(hash, key)`` found at the wanted ranks of the hash order.

    The driver sees bucket counts (classes x 4096 at most, then borders x 4096) and one row per border. A bucket
    with more rows than ``ROWS_PER_BUCKET`` is counted again by its next hash bits, until it has fewer or
    all its rows share one hash, which are those of one key but for chance.
    """
    hashed = df.select(F.col(by).alias("cls"), F.col(key).alias("key"), _hash(key, seed).alias("h"))
    hashed = hashed.where(F.col("cls").isNotNull())
    bound = MAX_CLASSES << HASH_BITS
    bits = HASH_BITS
    sizes_found = hashed.groupBy("cls", _prefix(F.col("h"), bits).alias("bucket")).count().limit(bound + 1).collect()
    if len(sizes_found) > bound:
        raise ValueError(f"{by} has too many classes to split by (more than {MAX_CLASSES})")
    counts: dict = {}
    for r in sizes_found:
        counts.setdefault(r["cls"], {})[r["bucket"]] = r["count"]
    found: dict = {}  # class and position in the list of ranks: bucket, place inside it, its rows
    for cls, sizes in counts.items():
        for i, rank in enumerate(ranks_of(sum(sizes.values()))):
            at = _place(sizes, rank)
            if at is not None:
                found[cls, i] = at
    if not found:
        return {}
    kind = df.schema[by].dataType.simpleString()
    while bits < 64 and any(n > ROWS_PER_BUCKET for _, _, n in found.values()):
        large = {(cls, at[0]) for (cls, _), at in found.items()}
        targets = df.sparkSession.createDataFrame(sorted(large), f"cls {kind}, bucket bigint")
        more = min(bits + HASH_BITS, 64)
        finer = (
            hashed.withColumn("bucket", _prefix(F.col("h"), bits))
            .join(F.broadcast(targets), ["cls", "bucket"], "left_semi")
            .groupBy("cls", "bucket", _prefix(F.col("h"), more).alias("finer"))
            .count()
            .collect()
        )
        within: dict = {}
        for r in finer:
            within.setdefault((r["cls"], r["bucket"]), {})[r["finer"]] = r["count"]
        found = {(cls, i): _place(within[cls, at[0]], at[1]) for (cls, i), at in found.items()}
        bits = more
    wanted = [(cls, i, bucket, place) for (cls, i), (bucket, place, _) in found.items()]
    hashed = hashed.withColumn("bucket", _prefix(F.col("h"), bits))
    spark = df.sparkSession
    schema = f"cls {kind}, i int, bucket bigint, place bigint"
    targets = spark.createDataFrame(wanted, schema)
    up_to_here = (
        Window.partitionBy("cls", "bucket").orderBy("h", "key")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Rows that share a key are merged, so a repeated key costs one row here. All rows of a key
    # fall on the same side of a border.
    rows = (
        hashed.join(F.broadcast(targets), ["cls", "bucket"], "left_semi")
        .groupBy("cls", "bucket", "h", "key")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("last", F.sum("copies").over(up_to_here))
        .join(F.broadcast(targets), ["cls", "bucket"])
        .where((F.col("place") <= F.col("last")) & (F.col("place") > F.col("last") - F.col("copies")))
        .select("cls", "i", "h", "key")
        .collect()
    )
    return {(r["cls"], r["i"]): (r["h"], r["key"]) for r in rows}


def _up_to(key: str, seed: int, border: tuple) -> Column:
    h = _hash(key, seed)
    return (h < border[0]) | ((h == border[0]) & (F.col(key) <= F.lit(border[1])))


def stratified_split(
    df: DataFrame,
    label: str = ROLES.target,
    key: str = ROLES.key,
    test_share: float = TEST_SHARE,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Add ``split`` (train/test): within every class exactly ``round(n * share)`` test rows."""
    borders = _borders(df, key, seed, label, lambda n: [round(n * test_share)])
    in_test = F.lit(False)
    for (cls, _), border in borders.items():
        in_test = in_test | ((F.col(label) == F.lit(cls)) & _up_to(key, seed, border))
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def stratified_folds(
    df: DataFrame,
    label: str = ROLES.target,
    key: str = ROLES.key,
    k: int = FOLDS,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Add ``fold`` (0..k-1): fold sizes differ by at most one row within every class."""
    borders = _borders(df, key, seed, label, lambda n: [n * i // k for i in range(1, k)])
    fold = F.lit(0)
    for (cls, _), border in borders.items():
        beyond = (F.col(label) == F.lit(cls)) & ~_up_to(key, seed, border)
        fold = fold + beyond.cast("int")
    # A border at rank 0 does not exist: every row of that class lies beyond it.
    for cls in {c for c, _ in borders}:
        absent = (k - 1) - sum(1 for c, _ in borders if c == cls)
        if absent:
            fold = fold + F.when(F.col(label) == F.lit(cls), absent).otherwise(0)
    return df.withColumn("fold", fold)


def hash_fraction_split(
    df: DataFrame, key: str = ROLES.key, test_share: float = TEST_SHARE, seed: int = RANDOM_SEED
) -> DataFrame:
    """Approximate split with no job at all: the share holds in expectation, not to the row."""
    place = F.pmod(_hash(key, seed), F.lit(1_000_000))
    is_test = place < int(test_share * 1_000_000)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def sample_rows(
    df: DataFrame, n: int, key: str = ROLES.key, seed: int = RANDOM_SEED
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run.

    ``orderBy`` + ``limit`` keeps n rows per task, so no full sort happens.
    """
    return df.orderBy(_hash(key, seed), F.col(key)).limit(n)


def assign_share(
    df: DataFrame, share: float, key: str = ROLES.key, seed: int = RANDOM_SEED
) -> Column:
    """0/1 column with exactly ``round(rows * share)`` ones, unrelated to the data."""
    whole = df.select(key, F.lit(1).alias("whole"))
    borders = _borders(whole, key, seed, "whole", lambda n: [round(n * share)])
    if not borders:
        return F.lit(0)
    return _up_to(key, seed, next(iter(borders.values()))).cast("int")
