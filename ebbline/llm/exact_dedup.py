"""Exact copies by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at rows whose group in the step before has two rows or more, so the full text is
hashed for those alone. What is shuffled are lengths and hashes, combined ahead of the shuffle: a
group of copies that holds a third of all rows is one row per task. Rows are joined with the surviving
groups, one row a group; Spark broadcasts these while they are small and splits skewed partitions
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import drop_judged, stored

#: Bytes hashed in the second step.
PREFIX_BYTES = 64

ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


def _content(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def full_hash(text_col: str = "text") -> Column:
    """SHA-256 of the text in UTF-8 as lower-case hex; null counts as empty."""
    return F.sha2(_content(text_col), 256)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: `id`, `length`, `keep_id`, `group_size`, `kept`, and the carried columns.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays;
    a null id is smaller than any other. Repeated rows (same id and text) are counted and all marked
    alike, as nothing tells them apart. An empty table gives an empty result. Other columns of docs
    are not read, whatever their names. `carry` maps names to expressions over docs.
    """
    content = _content(text_col)
    length, prefix = F.octet_length(content), F.xxhash64(F.substring(content, 1, PREFIX_BYTES))
    carried = [c.alias(f"carry_{name}") for name, c in (carry or {}).items()]
    key = ["length", "prefix"]

    lengths = docs.select(length.alias("length")).groupBy("length").count().where("count > 1").select("length")
    lengths = stored(lengths, "lengths")
    heads = docs.select(length.alias("length"), prefix.alias("prefix"))
    # Copies of a text become one row a task before the join with the lengths.
    heads = heads.groupBy(key).count().where("count > 1").join(lengths, "length", "left_semi").select(key)
    heads = stored(heads, "heads")

    rows = docs.select(F.col(id_col).alias("id"), length.alias("length"), prefix.alias("prefix"), content.alias("content"), *carried)
    full = rows.join(heads, key, "left_semi").withColumn("full", F.sha2("content", 256)).drop("content")
    full = stored(full, "full")
    same = [*key, "full"]
    # Stored, so that the join reads both sides straight from files: Spark broadcasts the groups or splits a hot one.
    groups = stored(full.groupBy(same).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    copies = full.join(groups, same).drop("full", "prefix")
    alone = rows.drop("content").join(heads, key, "left_anti").drop("prefix")
    alone = alone.withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    found = copies.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    names = [F.col(f"carry_{name}").alias(name) for name in carry or {}]
    return found.select("id", "length", "keep_id", "group_size", "kept", *names)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row of each group of equal texts.

    Only groups of two rows and more are joined with docs. Of repeated rows that tie for the largest
    id, one stays.
    """
    text_hash = F.xxhash64(_content(text_col))
    found = copy_groups(docs, id_col, text_col, {"hash": text_hash}).where("group_size > 1")
    judged = found.groupBy("id", "hash").agg(F.max("kept").alias("stays"), F.count("*").alias("repeats"))
    return drop_judged(docs, id_col, text_hash, judged)
