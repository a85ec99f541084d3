"""Tables handed from one Spark job to the next through the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ebbline-llm-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch: a row here is a whole text or page.
BATCH_ROWS = 1_000


def text_batches(rows: DataFrame) -> DataFrame:
    """The same rows, for a Python stage over whole texts.

    Where the session sets no size of Arrow batches, Spark's 10,000 rows a batch become `BATCH_ROWS`:
    both sides of a task hold a batch in memory.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_ROWS))
    return rows


def new_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: lineage ends here, and its size is known to the optimizer.

    Joins with a stored table are broadcast by Spark when the table is below
    spark.sql.autoBroadcastJoinThreshold, and shuffled otherwise.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_judged(docs: DataFrame, id_col: str, text_hash: Column, judged: DataFrame) -> DataFrame:
    """docs without the rows that judged drops, with all their columns.

    judged: `id`, `hash`, `stays`, `repeats` for each id and text of a group of alike rows. Rows that do
    not stay are dropped; of `repeats` equal rows that stay one is kept.
    """
    judged = stored(judged.where("repeats > 1 OR NOT stays").select("id", "hash", "stays"), "judged")

    def mine(rows: DataFrame, table: DataFrame) -> Column:
        return rows["`" + id_col.replace("`", "``") + "`"].eqNullSafe(table["id"]) & (text_hash == table["hash"])

    kept = docs.join(judged, mine(docs, judged), "left_anti")
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return kept
    own_hash = fresh(docs, "text_hash")
    again = docs.withColumn(own_hash, text_hash)
    again = again.join(repeated, mine(again, repeated), "left_semi")
    return kept.unionByName(again.dropDuplicates([id_col, own_hash]).drop(own_hash))
